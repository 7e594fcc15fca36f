"""Trie of conversation prefixes as balanced parentheses.

Conversations become paths of turn digests.  Equal paths are one row, and the rows are
dealt in path order into shards.  A task streams a shard's paths and writes one opening
parenthesis where a node begins and one closing where its subtree ends.  Everything about
a subtree then follows from that sequence: ``findclose``, over a tree of least excesses of
blocks, tells where it ends; the rank of opening ones gives its range of nodes, the rank of
pairs "()" its leaves, and differences of cumulative arrays its conversations and savings.

Only nodes on a border between shards, the spines, have parts in several of them.  A part
counts what its own shard is the first to hold, so the parts of a node add up.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

LEADERS, HEADS = 100, 6  # conversations that share a leader, and lengths of a shared head
SHARD = 1 << 14  # paths of a shard
IDS = 1 << 12  # conversation ids that are joined into one text
DIGEST = 16
NOTHING = hashlib.sha256().hexdigest()


class Parens:
    """Balanced parentheses (1 opens, 0 closes) with ranks and ``findclose``."""

    def __init__(self, bits: np.ndarray, block: int = 64):
        self.bits, self.block = bits, block
        self.opened = np.cumsum(bits, dtype=np.int64)
        pairs = np.zeros(len(bits), np.int64)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaves = np.cumsum(pairs)
        self.excess = 2 * self.opened - np.arange(1, len(bits) + 1)
        n_blocks = 1 << max(-(-len(bits) // block) - 1, 0).bit_length()
        padded = np.full(n_blocks * block, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        self.padded = padded.reshape(n_blocks, block)
        # tree[1] is the root; the children of k are 2k and 2k + 1; blocks are the last level
        self.tree = np.empty(2 * n_blocks, np.int64)
        self.tree[n_blocks:] = self.padded.min(axis=1)
        level = n_blocks
        while level > 1:
            self.tree[level // 2:level] = self.tree[level:2 * level].reshape(-1, 2).min(axis=1)
            level //= 2
        self.n_blocks = n_blocks

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at ``opens`` are closed."""
        target = self.excess[opens] - 1
        close = np.full(len(opens), -1, np.int64)
        place = np.arange(self.block)
        for at in range(0, len(opens), 1 << 14):  # in the block itself, then in later ones
            part = slice(at, at + (1 << 14))
            rows = self.padded[opens[part] // self.block]
            hit = (rows <= target[part, None]) & (place > (opens[part] % self.block)[:, None])
            found = hit.any(axis=1)
            close[part] = np.where(found, opens[part] // self.block * self.block + hit.argmax(axis=1), -1)
        left = np.flatnonzero(close < 0)
        node, goal = opens[left] // self.block + self.n_blocks, target[left]
        while True:  # up, until the sibling to the right falls to the target
            climb = (node & 1 == 1) | (self.tree[np.minimum(node + 1, 2 * self.n_blocks - 1)] > goal)
            if not climb.any():
                break
            node = np.where(climb, node >> 1, node)
        node = node + 1
        while True:  # down, to the first block that does
            above = node < self.n_blocks
            if not above.any():
                break
            child = np.minimum(2 * node, 2 * self.n_blocks - 2)
            node = np.where(above, np.where(self.tree[child] <= goal, child, child + 1), node)
        for at in range(0, len(left), 1 << 14):
            part = slice(at, at + (1 << 14))
            block = node[part] - self.n_blocks
            close[left[part]] = block * self.block + (self.padded[block] <= goal[part, None]).argmax(axis=1)
        return close


def _common(a: bytes, b: bytes) -> int:
    """Digests that two paths begin with in common."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, np.uint64, 2 * n).reshape(n, 2) for p in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def _key(path: bytes, depth: int) -> str:
    return hashlib.md5(path[:DIGEST * depth]).hexdigest()


def encoded(paths: list[bytes], lens: list[np.ndarray], before: bytes | None, after: bytes | None):
    """The trie of one shard's paths (rising, each once) between its neighbours' paths.

    Returns its parentheses and, per node in the order of opening: depth, parent, length
    of the last text, whether this shard is the first to hold it, key on a spine; and the
    node where each path ends.
    """
    bits, depth, parent, length = [np.ones(1, np.int8)], [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(1, np.int64)]
    ends, stack, last, n = [], np.zeros(1, np.int64), b"", 1
    for path, sizes in zip(paths, lens):
        same = _common(last, path)
        new = len(path) // DIGEST - same
        nodes = np.arange(n, n + new)
        bits += [np.zeros(len(last) // DIGEST - same, np.int8), np.ones(new, np.int8)]
        depth.append(np.arange(same + 1, same + new + 1))
        parent.append(np.r_[stack[same], nodes[:-1]] if new else nodes)
        length.append(np.asarray(sizes[same:], np.int64))
        stack = np.r_[stack[:same + 1], nodes]
        ends.append(int(stack[-1]))
        last, n = path, n + new
    bits.append(np.zeros(len(last) // DIGEST + 1, np.int8))
    depth, parent, length = (np.concatenate(x) for x in (depth, parent, length))
    own, spine = np.ones(n, bool), {}
    if before is not None:  # the shared nodes are the first to open
        shared = _common(before, paths[0])
        own[:shared + 1] = False
        spine |= {d: (paths[0], d) for d in range(shared + 1)}
    if after is not None:
        spine |= {int(stack[d]): (last, d) for d in range(_common(after, last) + 1)}
    return np.concatenate(bits), depth, parent, length, own, spine, np.array(ends, np.int64)


def _nodes(rows: list[tuple], before: bytes | None, after: bytes | None) -> list[list]:
    """Columns of PARTS for one shard; ``rows`` are (path, lens, n, first, ends)."""
    paths = [r[0] for r in rows]
    bits, depth, parent, length, own, spine, ends = encoded(paths, [r[1] for r in rows], before, after)
    n = len(depth)
    trie = Parens(bits)
    opens = np.flatnonzero(bits)
    closes = trie.findclose(opens)
    stop = trie.opened[closes]  # nodes of a subtree: from its own number to before this one
    start = np.arange(n)

    def subtree(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values)]
        return total[stop] - total[start]

    ended = np.zeros(n, np.int64)
    ended[ends] = [r[2] for r in rows]
    n_convs = subtree(ended)
    saved = subtree(n_convs * length - own * length)
    n_leaves = trie.leaves[closes] - trie.leaves[opens] + (bits[np.minimum(opens + 1, len(bits) - 1)] == 0)
    if after is not None and after[:len(paths[-1])] == paths[-1]:  # goes on in the next shard
        tip = int(ends[-1])
        n_leaves -= (start <= tip) & (tip < stop)
    n_children = np.bincount(parent[1:][own[1:]], minlength=n) if n > 1 else np.zeros(n, np.int64)
    none = np.iinfo(np.int64).max
    least = np.full(n, none)
    least[ends] = [none if r[3] is None else r[3] for r in rows]
    by_depth = np.argsort(depth, kind="stable")[::-1]
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[:-1]:
        np.minimum.at(least, parent[level], least[level])
    digest = [None] * n
    for node, row in zip(ends.tolist(), rows):
        digest[node] = row[4]
    keys, parent_keys, parents = [None] * n, [None] * n, [None] * n
    for node, (path, d) in spine.items():
        keys[node] = _key(path, d)
    least = [None if x == none else x for x in least.tolist()]
    for node, above in enumerate(parent.tolist()):
        if above in spine:
            parent_keys[node] = keys[above]
        elif above >= 0:
            parents[node] = least[above]
    return [keys, parent_keys, depth, least, parents, n_convs, n_children, n_leaves, saved, digest]


PARTS = ("key string, parent_key string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard; a shard's rows arrive together, its neighbours' paths around them."""
    names = ["key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
             "saved_tokens", "ends_sha256"]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 7, pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        own = [r[2:] for r in rows if r[1] == 1]
        columns = _nodes(own, *(next((r[2] for r in rows if r[1] == k), None) for k in (0, 2)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("s", "kind", "path", "lens", "n", "first", "ends"))):
            if held and held[0][0] != row[0]:
                yield made(held)
                held = []
            held.append(row)
    if held:
        yield made(held)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, k (turns from 1), digest (of role and text), len (code points of the text)."""
    none = F.lit("")
    read = conversations.select("conv_id", "turn", F.coalesce("role", none).alias("role"),
                                F.coalesce("text", none).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(order).alias("k"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"),
        F.length("text").cast("long").alias("len"))


def head_of(conv_id: Column) -> Column:
    """Turns that a conversation takes from its leader; none without an id."""
    return F.coalesce(F.crc32(conv_id.cast("string")) % HEADS, F.lit(0))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests of its turns in order), lens: every conversation with the
    first turns of its leader in place of its own.  Turnless ones have an empty path."""
    h = head_of(F.col("conv_id"))
    own = turns.where(F.col("k") > h).select("conv_id", F.lit(1).alias("part"), "k", "digest", "len")
    convs = turns.where("k = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % LEADERS).alias("leader"))
    heads = turns.where(F.col("conv_id") % LEADERS == 0).where(F.col("k") < HEADS).withColumnRenamed("conv_id", "leader")
    taken = convs.where(h > 0).join(heads, "leader").where(F.col("k") <= h).select(
        "conv_id", F.lit(0).alias("part"), "k", "digest", "len")
    mark = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("k"), F.lit("").alias("digest"),
                        F.lit(0).cast("long").alias("len"))
    parts = F.sort_array(F.collect_list(F.struct("part", "k", "digest", "len")))
    return own.union(taken).union(mark).groupBy("conv_id").agg(parts.alias("parts")).select(
        "conv_id", F.unhex(F.concat_ws("", F.col("parts.digest"))).alias("path"),
        F.slice(F.col("parts.len"), F.lit(2), F.size("parts")).alias("lens"))


def ends_of(paths: DataFrame) -> DataFrame:
    """at (digest of a path), ends: SHA-256 of the ids of its conversations, rising.

    Ids are joined in blocks of an id range each, so that the one task that hashes a
    path's ids reads few rows however many conversations are equal."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = state = None
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist()):
                if key != at:
                    if state is not None:
                        out.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_pylist([{"at": a, "ends": e} for a, e in out], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"at": at, "ends": state.hexdigest()}], schema=schema)

    schema = pa.schema([("at", pa.string()), ("ends", pa.string())])
    blocks = paths.where("conv_id IS NOT NULL").groupBy(
        F.md5("path").alias("at"), F.floor(F.col("conv_id") / IDS).alias("block")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    return blocks.repartition("at").sortWithinPartitions("at", "block").mapInArrow(work, "at string, ends string")


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    of every node of the trie of rebuilt conversations, the root first in depth.

    Turns are ordered by turn, NULL first, equal ones by role and text; repeated rows are
    repeated turns.  NULL roles and texts are empty.  Rows without conv_id are one
    conversation of its own turns, whose id is left out of ``ends_sha256`` and is the
    smallest member only where it is the only one.  An empty table gives no rows.

    A conversation's turns are ordered in one task, and its path (24 bytes a turn) is one
    row; a task holds the paths of one shard.
    """
    paths = written(rebuilt(written(turns_of(conversations), "turns")), "paths")
    known = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.any_value("lens").alias("lens"))
    known = written(known.withColumn("at", F.md5("path")).join(ends_of(paths), "at", "left").select(
        "path", "lens", "n", "first", F.coalesce("ends", F.lit(NOTHING)).alias("ends")), "different-paths")
    shards = written(known.repartitionByRange(max(-(-known.count() // SHARD), 1), "path").withColumn(
        "s", F.spark_partition_id()), "path-shards")
    # the paths on either side of each border: two rows a shard
    edges = written(shards.groupBy("s").agg(F.min("path").alias("low"), F.max("path").alias("high")), "path-borders")
    order = sorted(r.s for r in edges.select("s").collect())
    beside = shards.sparkSession.createDataFrame(list(zip(order, order[1:])), "left int, right int")
    guests = beside.join(edges, F.col("left") == F.col("s")).select(
        F.col("right").alias("s"), F.lit(0).alias("kind"), F.col("high").alias("path")).union(
        beside.join(edges, F.col("right") == F.col("s")).select("left", F.lit(2), "low"))
    dealt = shards.withColumn("kind", F.lit(1)).unionByName(guests, allowMissingColumns=True)
    parts = written(dealt.repartition("s").sortWithinPartitions("s", "kind", "path").mapInArrow(_shards, PARTS), "trie-parts")
    # spines merge: their parts add up
    merged = parts.where("key IS NOT NULL").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"))
    merged, few = measured(merged, "spines")
    above = few.select(F.col("key").alias("above"), F.col("conv_id").alias("above_id"))
    rest = parts.where("key IS NULL")
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_key"]
    whole = rest.select(*columns, "parent_conv_id").union(merged.select(*columns, F.lit(None).cast("long")))
    joined = whole.where("parent_key IS NOT NULL").join(above, F.col("parent_key") == F.col("above"), "left").withColumn(
        "parent_conv_id", F.col("above_id")).drop("above", "above_id")
    return whole.where("parent_key IS NULL").unionByName(joined).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
