"""Ranked lexical search by the Best Position Algorithm.

The corpus is read once for the terms of the stated queries: every document becomes
one row of an index (its length, the query terms it holds and how often).  Counts over
all rows give the weights.  Then each task cuts its rows into shards of documents and
keeps, for every term of a shard, the list of its documents by falling impact.

A query reads its lists side by side.  Every document met is scored at once by direct
accesses to all other lists, which also marks its position in each of them as seen.
The best position of a list is the last of the seen ones that follow its head without a
gap; whatever has not been met stands behind it in every list, so the impacts just
behind the best positions add up to a bound on all scores still unknown.  Reading ends
when that bound is strictly below the k-th score, so that ties by id are right.

Shards are made of documents, not of terms: a term that every document holds costs
each shard one list, and only the best k of a shard leave it.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import terms

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

TOP = 50
SHARD = 1 << 15  # documents whose lists a task holds at once
CELLS = 1 << 22  # impacts of one query that are laid out at once
QUERY_TERMS = 200_000  # terms of the queries that are answered by one reading of the corpus
MERGES = 64  # groups that the shards' best are merged in first
# A term is a run of letters, digits and characters beyond ASCII; all else becomes a space.
FOLDED = bytes((b | 0x20) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
               for b in range(256))


def counted(text: str | None) -> tuple[int, Counter]:
    """Number of terms, and how often each occurs."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split(b" ")
    counts = Counter(found)
    return len(found) - counts.pop(b"", 0), counts


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of every document that has a term at all."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                n, counts = counted(text)
                held = {vocabulary[w]: c for w, c in counts.items() if w in vocabulary}
                sizes.append(n)
                ids.append(np.fromiter(held, np.int32, len(held)))
                tfs.append(np.fromiter(held.values(), np.int32, len(held)))
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.empty(0, np.int32)])))
                     for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    made = docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")
    return written(made.where("n > 0"), "lexical-index")


def weights(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term."""
    n, total = index.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(size, np.int64)
    for term, held in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[term] = held
    return n, total or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def best(lists: list[tuple[np.ndarray, np.ndarray]], size: int, top: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` highest sums over impact lists: (documents, scores), best first.

    A list is (documents, impacts) by falling impact over documents 0 to ``size`` - 1;
    equal scores go by document.  What scores below ``floor`` may be left out.
    """
    direct = np.zeros((len(lists), size), np.int64)
    for row, (docs, impacts) in zip(direct, lists):
        row[docs] = impacts
    seen, score = np.zeros(size, bool), np.zeros(size, np.int64)
    position, depth, step = [0] * len(lists), 0, top
    while True:
        met = np.unique(np.concatenate([docs[depth:depth + step] for docs, _ in lists]))
        new = met[~seen[met]]
        seen[new] = True
        score[new] = direct[:, new].sum(axis=0)
        depth, step = depth + step, 2 * step
        bound = 0
        for i, (docs, impacts) in enumerate(lists):
            gaps = ~seen[docs[position[i]:]]
            position[i] += int(gaps.argmax()) if gaps.any() else len(gaps)
            if position[i] < len(docs):
                bound += int(impacts[position[i]])
        known = np.flatnonzero(seen)
        kth = int(np.partition(score[known], -top)[-top]) if len(known) >= top else 0
        if bound == 0 or bound < max(kth, floor):
            break
    known = known[score[known] >= max(kth, floor, 1)]
    order = np.lexsort((known, -score[known]))[:top]
    return known[order], score[known[order]]


def _searched(queries: list[tuple[int, np.ndarray]], n_docs: int, total: int, weight: np.ndarray, top: int):
    """Task over rows of the index: the best of each shard for every query."""
    def shard(table: pa.Table, floors: dict) -> Iterator[pa.RecordBatch]:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending")]))  # NULL comes last
        counts = pc.list_value_length(table["terms"]).to_numpy()
        owner = np.repeat(np.arange(len(table)), counts)
        term, tf = (pc.list_flatten(table[c]).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        length = 50 + (50 * table["n"].to_numpy() * n_docs) // total
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[owner]))
        order = np.lexsort((owner, -impact, term))
        term, owner, impact = term[order], owner[order], impact[order]
        starts = np.searchsorted(term, np.arange(len(weight) + 1))
        found: list[list] = [[], [], []]
        for q, wanted in queries:
            wanted = wanted[(weight[wanted] > 0) & (starts[wanted + 1] > starts[wanted])]
            if not len(wanted):
                continue
            width = max(CELLS // len(wanted), 1)
            for low in range(0, len(table), width):
                lists = [(owner[a:z], impact[a:z]) for a, z in zip(starts[wanted], starts[wanted + 1])]
                if width < len(table):
                    keep = [(d >= low) & (d < low + width) for d, _ in lists]
                    lists = [(d[k] - low, v[k]) for (d, v), k in zip(lists, keep) if k.any()]
                    if not lists:
                        continue
                docs, scores = best(lists, min(width, len(table) - low), top, floors.get(q, 0))
                if len(docs) == top:
                    floors[q] = max(floors.get(q, 0), int(scores[-1]))
                found[0].append(np.full(len(docs), q))
                found[1].append(docs + low)
                found[2].append(scores)
        if found[0]:
            q, docs, scores = (np.concatenate(x) for x in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), table["doc_id"].take(pa.array(docs)).combine_chunks(), pa.array(scores)],
                ["q", "doc_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, floors = [], 0, {}
        for batch in batches:
            if rows and rows + len(batch) > SHARD:
                yield from shard(pa.Table.from_batches(held), floors)
                held, rows = [], 0
            held.append(batch)
            rows += len(batch)
        if rows:
            yield from shard(pa.Table.from_batches(held), floors)

    return work


def _first(df: DataFrame, keys: list[str], top: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every row of ``items``.

    Every row of ``items`` is a query and every row of ``docs`` a document, repeated ones
    too.  Equal scores go by rising doc_id, NULL last.  NULL and empty texts have no term:
    as documents they count nowhere, as queries they give no row.  Only scores above
    zero are given.  An empty table gives no rows.

    Queries travel to the tasks in blocks of some ``QUERY_TERMS`` terms; the corpus is
    read once for each block.
    """
    kind = dict(docs.dtypes)["doc_id"]
    asked = written(items.select(F.monotonically_increasing_id().alias("q"), "item_id",
                                 F.array_distinct(terms(F.col("text"))).alias("words")), "queries")
    n_terms = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-n_terms // QUERY_TERMS) or 1
    out = None
    for block in range(blocks):
        rows = asked.where((F.pmod(F.xxhash64("q"), F.lit(blocks)) == block) & (F.size("words") > 0)).select(
            "q", "words").collect()
        vocabulary: dict[bytes, int] = {}
        queries = [(q, np.array([vocabulary.setdefault(w.encode("utf-8", "surrogatepass"), len(vocabulary))
                                 for w in words], np.int64)) for q, words in rows]
        index = build_index(docs, vocabulary)
        n, total, weight = weights(index, len(vocabulary))
        found = index.mapInArrow(_searched(queries, n, total, weight, top), f"q bigint, doc_id {kind}, score bigint")
        out = found if out is None else out.union(found)
    merged = _first(out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))), ["q", "part"], top)
    return _first(merged.drop("rank"), ["q"], top).join(asked.select("q", "item_id"), "q").select(
        "item_id", "rank", "doc_id", "score")
