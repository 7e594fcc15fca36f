"""SimHash fingerprints and their links by covering locality-sensitive hashing.

Each of the 64 bits gets a random vector of radius + 1 bits.  For every non-zero
vector v of that length one table masks the fingerprints with the bits whose vector
has an odd product with v.  Two fingerprints that differ in at most ``radius`` bits
leave some v orthogonal to all differing bits, so they are equal under that mask:
31 tables find every pair within 4 bits, none is missed.

Fingerprints are linked, not documents: copies count once.  Inside a bucket the
links are kept as a forest, so a bucket of n gives at most n - 1 rows.  A bucket of
more than ``BUCKET`` fingerprints is not compared pair by pair: each fingerprint is
filed under all points within half the radius (two fingerprints within the radius
share one), which grows with n alone.
"""

from __future__ import annotations

import itertools
import random
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm import nearcopies
from lumenpeak.llm.common import UPPER, counted, joined, measured, text_key, unused
from lumenpeak.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

SHINGLE, RADIUS, HASH_SEED, MASK_SEED = 4, 4, 42, 20
# Largest bucket that one task compares pair by pair.
BUCKET = 16_384
PIECE = 1 << 18  # hashes whose bits are unpacked at once
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text; 0 without words."""
    line = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    h = xxhash.xxh64_intdigest
    hashes = [h(line[a:b], HASH_SEED) for a, b in zip(starts, ends[size - 1:])] or [h(line, HASH_SEED)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = np.array(hashes[at:at + PIECE], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def masks(radius: int = RADIUS, seed: int = MASK_SEED) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family over 64 bits."""
    rng = random.Random(seed)
    vectors = [rng.randrange(1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1)
            for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, ``key`` (digest of the text) and ``fp`` (as a signed long) of every
    row, written once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t, size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    read = docs.select("doc_id", text_key().alias("key"), "text")
    return written(read.mapInArrow(work, f"doc_id {kind}, key string, fp bigint"), "fingerprints")


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs within the radius connect: one sweep per found
    member, from the members found to those not found yet."""
    left, right = [], []
    open_ = np.unique(fps)
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            near = np.bitwise_count((open_ ^ x).view(np.uint64)) <= radius
            if near.any():
                found = open_[near]
                left.append(found)
                right.append(np.full(len(found), x))
                queue.extend(found.tolist())
                open_ = open_[~near]
    nothing = np.empty(0, np.int64)
    return np.concatenate([*left, nothing]), np.concatenate([*right, nothing])


def _compared(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of buckets that arrive in order; holds one bucket and one batch."""
    def links(t: np.ndarray, k: np.ndarray, f: np.ndarray) -> pd.DataFrame | None:
        edge = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        begin, stop = np.r_[0, edge], np.r_[edge, len(f)]
        us, vs = [], []
        two = stop - begin == 2
        a, b = f[begin[two]], f[begin[two] + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        us.append(a[near])
        vs.append(b[near])
        for i, j in zip(begin[stop - begin > 2].tolist(), stop[stop - begin > 2].tolist()):
            u, v = _forest(f[i:j], radius)
            us.append(u)
            vs.append(v)
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    t = k = f = np.empty(0, np.int64)
    for pdf in batches:
        if not len(pdf):
            continue
        t, k, f = (np.concatenate([old, pdf[c].to_numpy(np.int64)]) for old, c in ((t, "t"), (k, "k"), (f, "fp")))
        last = int(np.flatnonzero((t != t[-1]) | (k != k[-1]))[-1]) + 1 if (t[0], k[0]) != (t[-1], k[-1]) else 0
        if last:
            yield links(t[:last], k[:last], f[:last])
            t, k, f = t[last:], k[last:], f[last:]
    if len(f):
        yield links(t, k, f)


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between different fingerprints, enough of them to connect all
    that pairs within ``radius`` bits connect.  ``fps`` holds each fingerprint once."""
    if radius % 2:
        raise ValueError("the radius must be even")
    family = [_signed(m) for m in masks(radius)]
    filed = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in family])).alias("t", "mask")).select(
        F.col("t").cast("long").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    counts = filed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "buckets")
    large, full = measured(counts.where(F.col("n") > bucket).select("t", "k"), "large-buckets")
    usual = filed.join(full, ["t", "k"], "left_anti").repartition("t", "k").sortWithinPartitions("t", "k")
    found = usual.mapInPandas(lambda it: _compared(it, radius), "u bigint, v bigint")
    # large buckets: file under all points that differ in up to radius / 2 free bits
    flips = [0] + [sum(1 << b for b in bits) for n in range(1, radius // 2 + 1)
                   for bits in itertools.combinations(range(64), n)]
    points = F.lit([_signed(x) for x in flips])
    free = F.get(F.array(*[F.lit(m) for m in family]), F.col("t").cast("int"))
    spread = filed.join(full, ["t", "k"]).select(
        "t", "k", "fp", F.explode(points).alias("flip"), free.alias("mask")).where(
        F.col("flip").bitwiseAND(F.col("mask")) == 0).withColumn("z", F.col("fp").bitwiseXOR(F.col("flip")))
    star = spread.groupBy("t", "z").agg(F.min("fp").alias("u"))
    stars = spread.join(star, ["t", "z"]).where("fp <> u").select("u", F.col("fp").alias("v"))
    return found.union(stars) if large.count() else found


def _edges(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, first, n) of every fingerprint and the links (u, v) of near ones."""
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    return firsts, written(links(firsts.select("fp"), radius).distinct(), "links")


def _classed(rows: DataFrame, firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the root and the smallest doc_id (component_id) of their class."""
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted, watch = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), Observation()
    rooted = written(rooted.observe(watch, F.count("*").alias("fps"), F.sum("n").alias("rows")), "rooted")
    fps, total = watch.get["fps"], watch.get["rows"] or 0
    least, often = counted(rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), F.count("*").alias("n")), "roots", fps)
    ids = joined(rooted.withColumnRenamed("n", "copies"), least, "root", fps, often)
    ids, often = counted(ids.select("fp", "root", "component_id", F.col("copies").alias("n")), "class-ids", total)
    return joined(rows, ids, "fp", total, often)


def classes(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    NULL and empty texts have fingerprint zero and link like any other.  Rows repeat
    as they do in ``docs``; a NULL doc_id is never the smallest unless all are NULL.
    """
    rows = fingerprints(docs, size)
    return _classed(rows, *_edges(rows, radius)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS,
                 similarity: float = nearcopies.SIMILARITY) -> DataFrame:
    """One document of each class: that with the smallest doc_id (then the smallest
    text digest); of rows equal in id and text one stays.

    Classes hold what links within ``radius`` bits connect, and near copies beyond it whose
    five-word shingles have a Jaccard similarity of ``similarity`` or more (``nearcopies``).
    NULL and empty texts are one class; empty tables stay empty.
    """
    rows = nearcopies.signed(docs, lambda text: fingerprint(text, size))
    firsts, edges = _edges(rows, radius)
    edges = nearcopies.links(docs, rows, edges, similarity)
    # rows with their class's smallest id are few in any class; all others go
    ranked = written(_classed(rows.select("doc_id", "key", "fp"), firsts, edges).groupBy(
        "root", "component_id", "doc_id", "key").agg(F.count("*").alias("n")).withColumn(
        "first", F.col("doc_id").eqNullSafe(F.col("component_id"))), "ranked")
    firsts = ranked.where("first")
    kept = firsts.groupBy("root").agg(F.min("key").alias("stays"))
    judged = firsts.join(kept, "root").select("doc_id", "key", "n", (F.col("key") != F.col("stays")).alias("goes")).union(
        ranked.where("NOT first").select("doc_id", "key", "n", F.lit(True)))
    named, key = unused(docs, "judged_id"), unused(docs, "judged_text")
    judged = written(judged.where("goes OR n > 1").select(
        F.col("doc_id").alias(named), F.col("key").alias(key), "goes"), "judged")
    same = F.col("doc_id").eqNullSafe(F.col(named)) & (text_key() == F.col(key))
    _, leaving = measured(judged.select(named, key), "leaving")
    alone = docs.join(leaving, same, "left_anti")
    again, marked = measured(judged.where("NOT goes").select(named, key), "again")
    if not again.count():
        return alone
    return alone.union(docs.join(marked, same, "left_semi").dropDuplicates(["doc_id", "text"]))
