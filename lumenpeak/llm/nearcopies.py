"""Links between near copies that lie beyond the radius of 64 fingerprint bits.

At a Jaccard similarity of 0.8 two SimHash fingerprints differ in some ten of 64 bits,
where a covering family would need far too many tables.  Here every text gets a row of
minima over its distinct five-word shingles; two texts that agree in all minima of a
band meet in a bucket.  A first pass links what lies next to each other: all rows are
sorted by bucket and by their further minima over range partitions, so that a bucket of
any size spreads over tasks, and every row meets the rows just before it, which are those
that agree with it longest; each band sorts by another order.  It only spares work: in
every bucket that still holds several classes all texts of different classes meet then,
in blocks that spread over tasks.  What meets is compared exactly, by the Jaccard
similarity of whole shingle sets; of very many pairs the best partners of a text come
first, then all others that are still in another class.  A pair that shares no band is missed; the README has the
measured recall.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import UPPER, measured, text_key
from lumenpeak.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

SHINGLE, SIMILARITY = 5, 0.8
# A pair of similarity 0.8 shares no band with a probability of 0.0018.
BANDS, ROWS = 16, 5
MINIMA = BANDS * ROWS
# Neighbours each row meets in the order of a band in the first pass.
NEXT = 2
# Rows of a block; two blocks of a bucket meet in one task.
BLOCK = 1024
# Minima that must agree before texts are compared: 5.6 deviations below 0.8.
AGREE = 44
# Best partners of a text, which are compared before all others.
FIRST = 2
MET = 200_000  # pairs that leave a task at once
PIECE = 1 << 13  # shingles whose minima are computed at once
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_draw = np.random.default_rng(20)
PLACES = _draw.integers(0, 1 << 64, SHINGLE, np.uint64, endpoint=False) | np.uint64(1)
TIMES = _draw.integers(0, 1 << 32, MINIMA, np.uint32, endpoint=False) | np.uint32(1)
PLUS = _draw.integers(0, 1 << 32, MINIMA, np.uint32, endpoint=False)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle,
    no words none."""
    h = xxhash.xxh64_intdigest
    words = [h(w) for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()]
    if not words:
        return np.empty(0, np.uint64)
    words = np.array(words, np.uint64)
    n = max(len(words) - SHINGLE + 1, 1)
    mixed = np.zeros(n, np.uint64)
    for place, times in enumerate(PLACES[:len(words)]):
        mixed += (words[place:place + n] ^ (words[place:place + n] >> np.uint64(29))) * times
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * PLACES[0])


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of ``MINIMA`` orders."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), PIECE):
        np.minimum(least, (short[at:at + PIECE][None] * TIMES[:, None] + PLUS[:, None]).min(1), out=least)
    return least


def signed(docs: DataFrame, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """doc_id, ``key`` (digest of the text), ``fp`` (fingerprint as a signed long), and
    the buckets and minima of every row, written once.  A text without words is in no bucket."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, buckets, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                fps.append(fingerprint(text))
                hashes = shingles(text)
                least = minima(hashes)
                sigs.append((least & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                buckets.append([xxhash.xxh64_intdigest(least[i:i + ROWS].tobytes(), i)
                                for i in range(0, MINIMA, ROWS)] if len(hashes) else [])
            flat = pa.array(np.array([x for row in buckets for x in row], np.uint64).view(np.int64))
            ends = np.r_[0, np.cumsum([len(row) for row in buckets])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.array(fps, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(sigs, pa.binary())],
                ["doc_id", "key", "fp", "buckets", "sig"])

    kind = dict(docs.dtypes)["doc_id"]
    read = docs.select("doc_id", text_key().alias("key"), "text")
    return written(read.mapInArrow(
        work, f"doc_id {kind}, key string, fp bigint, buckets array<bigint>, sig binary"), "signed")


def _met(rows: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Pairs of rows at most ``reach`` apart, of one bucket and two classes, and alike in
    enough minima."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, MINIMA)
    bucket, fp, root, key = (rows[c].to_numpy() for c in ("bucket", "fp", "root", "key"))
    found = []
    for gap in range(1, reach + 1):
        at = np.flatnonzero((bucket[gap:] == bucket[:-gap]) & (root[gap:] != root[:-gap]))
        agree = (sig[at] == sig[at + gap]).sum(1)
        at, agree = at[agree >= AGREE], agree[agree >= AGREE]
        found.append(pd.DataFrame({"key": key[at], "fp": fp[at], "other": key[at + gap], "fo": fp[at + gap],
                                   "alike": agree}))
    return pd.concat(found).assign(bucket=0, sig=b"", root=0)


def _neighbours(batches: Iterator[pd.DataFrame], reach: int) -> Iterator[pd.DataFrame]:
    """Pairs of rows that arrive in order, and the rows at both ends of the partition
    (without a partner), whose neighbours may lie in the next one."""
    columns = ["bucket", "sig", "root", "key", "fp", "other", "fo", "alike"]
    held, first = None, 0
    for rows in batches:
        if not len(rows):
            continue
        if first < reach:
            yield rows.head(reach - first).assign(other=None, fo=0, alike=0)[columns]
            first += len(rows)
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        yield _met(rows, reach)[columns]
        held = rows.tail(reach)
    if held is not None:
        yield held.assign(other=None, fo=0, alike=0)[columns]


def filed(rows: DataFrame) -> DataFrame:
    """(bucket, sig, key, fp) of every text in every bucket that it shares, its minima
    turned so that those of the next band come first."""
    texts = written(rows.where("size(buckets) > 0").groupBy("key").agg(
        F.first("fp").alias("fp"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig")), "texts")
    every = texts.select("key", "fp", "sig", F.posexplode("buckets").alias("band", "bucket"))
    _, shared = measured(
        every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    turned = F.concat(F.expr(f"substring(sig, {2 * ROWS} * (band + 1) + 1)"),
                      F.expr(f"substring(sig, 1, {2 * ROWS} * (band + 1))"))
    return written(every.join(shared, "bucket", "left_semi").select(
        "bucket", turned.alias("sig"), "key", "fp"), "filed")


def candidates(rows: DataFrame, reach: int = NEXT) -> DataFrame:
    """(a, fa, b, fb, alike): pairs of neighbours, each once, a < b, with their
    fingerprints and the minima in which they agree.  ``rows``: filed rows with the
    ``root`` of their class; texts of one class do not meet."""
    order = ["bucket", "sig", "key"]
    schema = "bucket bigint, sig binary, root bigint, key string, fp bigint, other string, fo bigint, alike int"

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _neighbours(it, reach)

    met = written(rows.select("bucket", "sig", "key", "fp", "root").repartitionByRange(*order).sortWithinPartitions(
        *order).mapInPandas(near, schema), "met")
    # at most 2 * reach rows a partition, in the same order
    ends = met.where("other IS NULL").select("bucket", "sig", "key", "fp", "root").distinct()
    across = ends.coalesce(1).sortWithinPartitions(*order).mapInPandas(near, schema)
    return _once(met.union(across).where("other IS NOT NULL"))


def _once(pairs: DataFrame) -> DataFrame:
    """(a, fa, b, fb, alike) of the pairs, each once, a < b."""
    swap = F.col("key") > F.col("other")
    pairs = pairs.select("alike", *[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name) for name, x, y in (
        ("a", "key", "other"), ("fa", "fp", "fo"), ("b", "other", "key"), ("fb", "fo", "fp"))])
    return written(pairs.groupBy("a", "b").agg(
        F.first("fa").alias("fa"), F.first("fb").alias("fb"), F.max("alike").alias("alike")), "near-pairs")


def _all_met(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs of rows of one group and two classes that are alike in enough minima; where
    two blocks meet, pairs of different blocks."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, MINIMA)
    bucket, i, j, block, fp, root, key = (
        rows[c].to_numpy() for c in ("bucket", "i", "j", "block", "fp", "root", "key"))
    group = np.r_[0, np.cumsum((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))]
    own, at, found, n = i == j, np.arange(len(rows)), [], 0
    for gap in range(1, len(rows)):
        at = at[:np.searchsorted(at, len(rows) - gap)]
        at = at[group[at] == group[at + gap]]
        if not len(at):
            break
        a = at[(root[at] != root[at + gap]) & (own[at] | (block[at] != block[at + gap]))]
        agree = (sig[a] == sig[a + gap]).sum(1)
        a, agree = a[agree >= AGREE], agree[agree >= AGREE]
        found.append(pd.DataFrame({"key": key[a], "fp": fp[a], "other": key[a + gap], "fo": fp[a + gap], "alike": agree}))
        n += len(a)
        if n > MET:
            yield pd.concat(found)
            found, n = [], 0
    if found:
        yield pd.concat(found)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of groups that arrive in order; holds one group and one batch."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        open_ = (rows["bucket"] == last["bucket"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])
        yield from _all_met(rows[~open_])
        held = rows[open_]
    if held is not None:
        yield from _all_met(held)


def meetings(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs as ``candidates`` gives them, but of all texts of different classes that share
    a bucket.

    A bucket is dealt into blocks of some ``block`` rows, and every two blocks meet in a
    group of their own, so a task holds two blocks however large the bucket is."""
    _, mixed = measured(rows.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").selectExpr(
        "bucket", f"(n - 1) div {block} + 1 AS blocks"), "mixed")
    dealt = rows.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn(
        "with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    order = ["bucket", "i", "j"]
    dealt = dealt.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block",
                         "sig", "key", "fp", "root").repartition(*order).sortWithinPartitions(*order)
    return _once(dealt.mapInPandas(_groups, "key string, fp bigint, other string, fo bigint, alike int"))


def _sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, hashes: the shingles of the texts that a pair names."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                hashes = pa.array([shingles(text).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([key]), hashes], ["key", "hashes"])

    _, named = measured(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "named")
    texts = docs.select(text_key().alias("key"), "text").join(named, "key", "left_semi")
    return written(texts.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(
        work, "key string, hashes array<bigint>"), "shingle-sets")


def alike(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Fingerprints (u, v) of the pairs whose shingle sets have that Jaccard similarity.

    Each side of a join has a shingle set once a text; the pairs of a text with very many
    partners stream past it."""
    sets = _sets(docs, pairs)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("ha", "hb")))
    union = F.size("ha") + F.size("hb") - F.col("common")
    return both.where(F.col("common") / union >= similarity).select(F.col("fa").alias("u"), F.col("fb").alias("v"))


def links(docs: DataFrame, rows: DataFrame, edges: DataFrame, similarity: float = SIMILARITY,
          few: int | None = None) -> DataFrame:
    """(u, v): enough links between fingerprints to connect what ``edges`` and the near
    copies found connect.  ``rows`` are the signed rows of ``docs``; more than ``few`` pairs
    (as many as rows) that meet after the first pass are compared best partners first."""
    places = filed(rows)
    first = _ranked(candidates(places.withColumn("root", F.col("fp")))).where("now")
    roots = components(edges.select("u", "v").union(alike(docs, first, similarity)))
    placed = written(places.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")), "placed")
    pairs, edges = meetings(placed), roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if pairs.count() <= max(rows.count() if few is None else few, 1):  # in proportion to the input: all at once
        return edges.union(alike(docs, pairs, similarity))
    pairs = _ranked(pairs)
    roots = components(edges.union(alike(docs, pairs.where("now"), similarity)))
    edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))

    def root_of(fp: str) -> DataFrame:
        return roots.select(F.col("node").alias(fp), F.col("root").alias(f"root_{fp}"))

    others = written(pairs.where("NOT now").join(root_of("fa"), "fa", "left").join(root_of("fb"), "fb", "left").where(
        "coalesce(root_fa, fa) <> coalesce(root_fb, fb)").select("a", "fa", "b", "fb"), "other-pairs")
    return edges.union(alike(docs, others, similarity))


def _ranked(pairs: DataFrame) -> DataFrame:
    """The pairs, and ``now``: one text is among the best partners of the other."""
    best = [F.row_number().over(Window.partitionBy(c).orderBy(F.desc("alike"), d)) <= FIRST
            for c, d in (("a", "b"), ("b", "a"))]
    return written(pairs.withColumn("now", best[0] | best[1]), "ranked-pairs")
