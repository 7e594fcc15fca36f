"""Connected components over an edge table, by large and small stars.

Every step is a minimum per node (combined before the shuffle) and an equi-join, where
nodes with very many edges are broadcast; no group is collected.  The minima and the
edges of each star are written to the shared folder: lost executors cost at most a star,
and every plan that the driver holds is one aggregation or one join, however many rounds run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import frequent, joined


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The edges (u > v), each once, written, and their number."""
    watch = Observation()
    return written(edges.where("u > v").distinct().observe(watch, F.count("*").alias("n")), name), watch.get["n"]


def _least(edges: DataFrame, total: int, name: str) -> tuple[DataFrame, bool, bool]:
    """(u, m, n): smallest neighbour ``m`` of every ``u`` among its ``n`` edges, itself
    included; whether a node has edges enough to be told apart in joins, and whether one
    has two smaller neighbours, or smaller and larger ones."""
    watch, smaller = Observation(), F.count_if(F.col("v") < F.col("u"))
    least = edges.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"), smaller.alias("smaller"))
    is_open = (F.col("smaller") > 1) | ((F.col("smaller") > 0) & (F.col("smaller") < F.col("n")))
    table = written(least.observe(watch, F.max(frequent(total).cast("int")).alias("often"),
                                  F.max(is_open.cast("int")).alias("open")).drop("smaller"), name)
    return table, bool(watch.get["often"]), bool(watch.get["open"])


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node reachable.

    ``edges`` has columns (u, v) in any order; loops and repeats do no harm.  A graph
    without edges gives no rows.
    """
    edges, total = _counted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
    for _ in range(rounds):
        # large star: every node tells its larger neighbours its smallest one
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, often, is_open = _least(both, total, f"{name}-least")
        if not is_open:  # every tree is a star about its smallest node
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        told = joined(both.where("v > u"), least, "u", total, often)
        edges, total = _counted(told.select(F.col("v").alias("u"), F.col("m").alias("v")), name)
        # small star: every node tells its smaller neighbours, and itself, the smallest of them
        least, often, _ = _least(edges, total, f"{name}-least")
        told = joined(edges, least, "u", total, often).where("v <> m")
        edges, total = _counted(told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))), name)
    raise RuntimeError("components did not settle")
