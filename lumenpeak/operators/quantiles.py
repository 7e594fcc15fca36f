"""Exact quantiles of large groups without gathering any group.

The order statistic is bracketed: each pass counts the values per group in
equal-width slots of the current bracket (map tasks do the counting) and keeps
the slot that holds the wanted rank, until that slot holds one value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1024


def order_statistics(df: DataFrame, key: str, value: str,
                     ranks: dict[object, list[int]]) -> dict[tuple[object, int], float]:
    """{(key, rank): value} for 0-based ranks; keys and ranks are few and given.

    Only the brackets (one small row per wanted rank) visit the driver.  Values that
    are not finite are left out.
    """
    df = df.where(F.abs(value) < F.lit(float("inf")))
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, want INT, lo DOUBLE, hi DOUBLE, rank BIGINT"
    spans = df.where(F.col(key).isin(*ranks)).groupBy(key).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"))
    open_, found = [], {}
    for r in spans.collect():
        for want in ranks[r[key]]:
            open_.append((r[key], want, r["lo"], r["hi"], want))
    while open_:
        for k, want, lo, hi, _ in (b for b in open_ if b[2] == b[3]):
            found[(k, want)] = lo
        open_ = [b for b in open_ if b[2] != b[3]]
        if not open_:
            break
        brackets = spark.createDataFrame(open_, schema)
        x = F.col(value)
        # halved, so that the width of a bracket stays finite
        share = F.try_divide(x / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        slot = F.least(F.floor(share * SLOTS), F.lit(SLOTS - 1))
        inside = df.select(key, value).join(F.broadcast(brackets), key).where(
            (x >= F.col("lo")) & (x <= F.col("hi"))).withColumn("slot", slot)
        slots = inside.groupBy(key, "want", "rank", "slot").agg(
            F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        w = Window.partitionBy(key, "want").orderBy("slot")
        holder = slots.withColumn("upto", F.sum("n").over(
            w.rowsBetween(Window.unboundedPreceding, 0))).where(
            (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        before = {(b[0], b[1]): b[2:4] for b in open_}
        open_ = [(r[key], r["want"], r["lo"], r["hi"], r["rank"] - (r["upto"] - r["n"]))
                 for r in holder.collect()]
        # neighbouring floats that no slot tells apart end the search
        open_ = [b if b[2:4] != before[b[:2]] else (*b[:3], b[2], b[4]) for b in open_]
    return found


def medians(df: DataFrame, key: str, value: str) -> dict[object, float]:
    """Exact median per key (mean of the middle two); for few keys of any size."""
    known = df.where(F.abs(value) < F.lit(float("inf")))
    sized = known.groupBy(key).agg(F.count("*").alias("n")).collect()
    ranks = {r[key]: sorted({(r["n"] - 1) // 2, r["n"] // 2}) for r in sized}
    if not ranks:
        return {}
    values = order_statistics(known, key, value, ranks)
    return {k: math.fsum(values[(k, i)] for i in wanted) / len(wanted)
            for k, wanted in ranks.items()}
