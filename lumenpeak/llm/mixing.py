"""Mix sources to target weights by capped water-filling.

A source may be repeated at most ``epochs`` times.  Sources that the weighted share
would push beyond that are clamped there and the rest is shared again by weight.
In order of (size / weight) the clamped sources come first, so one running sum finds
where clamping ends; it runs over one row per source.

Repetitions are seeded: a source is taken whole floor(target / size) times and, for
the fractional repetition, up to the document where the running size in seeded order
reaches what is left (nearest document).  The running sum is split: sizes are added
per (source, bucket of the order key), and only the bucket with the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import WORD

EPOCHS, SHARE, SEED = 2, 1.5, "mix-1"
# Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)


def lot(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Order key of a document within its source: the same in every run.

    Rows equal in id and text draw the same lot and share its fate.
    """
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")),
                             F.coalesce(text, F.lit(""))))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lots(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key: all that mixing reads of a document, written once."""
    return written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                               lot(F.col("doc_id"), F.col("text")).alias("key")), "lots")


def targets(drawn: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target.  Rows are one per source from the first step on.

    NULL is a source of its own and comes last; an empty source has target 0.
    """
    per = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]),
                                    (F.row_number().over(by_name) - 1) % len(weights)))
    by_need = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.select(
        "*", (F.lit(share) * F.sum("source_size").over(everything)).alias("total"),
        (F.lit(float(epochs)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("full"),
        F.sum("w").over(after).alias("rest"))
    cap = F.lit(float(epochs)) * F.col("source_size")
    level = (F.col("total") - F.col("full")) / F.col("rest")
    per = per.withColumn("clamped", cap <= level * F.col("w"))
    # levels fall beyond the first source that is not clamped, so its level is the largest
    first = F.max(F.when(~F.col("clamped"), level)).over(everything)
    return per.select("source", "source_size",
                      F.when(F.col("clamped"), cap).otherwise(first * F.col("w")).alias("target"))


def plan(drawn: DataFrame, aims: DataFrame, digits: int = 3) -> DataFrame:
    """source, source_size, target, whole, cut: a document is taken ``whole`` times
    and once more if its key is at most ``cut`` (NULL: never)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("whole", whole.cast("int")).withColumn(
        "extra", F.col("target") - F.col("whole") * F.col("source_size"))
    bucket = F.substring("key", 1, digits)
    sums = drawn.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("bucket")
    same = F.col("a.source").eqNullSafe(F.col("s.source"))
    at = sums.withColumn("upto", F.sum("size").over(upto)).alias("s").join(aims.alias("a"), same).where(
        "extra > 0 AND upto >= extra").groupBy("s.source").agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "extra")).alias("at"))
    inside = drawn.alias("d").join(at.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))
                                   & (F.substring("d.key", 1, digits) == F.col("c.at.bucket"))).select(
        "d.source", "key", "size", "at")
    keyed = inside.groupBy("source", "key", "at").agg(F.sum("size").alias("size"))
    reached = F.col("at.before") + F.sum("size").over(Window.partitionBy("source").orderBy("key"))
    # the cut is the last key whose middle is not beyond what is left
    cuts = keyed.withColumn("reached", reached).groupBy("source", "at").agg(
        F.max(F.when(2 * F.col("reached") - F.col("size") <= 2 * F.col("at.extra"), F.col("key"))).alias("cut"))
    # no such key: all keys of the buckets before are taken
    cuts = cuts.select("source", F.coalesce("cut", F.col("at.bucket")).alias("cut"))
    return aims.alias("a").join(cuts.alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")), "left").select(
        "a.source", "source_size", "target", "whole", "cut")


def times() -> Column:
    return F.col("whole") + F.coalesce((F.col("key") <= F.col("cut")).cast("int"), F.lit(0))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    drawn = lots(docs)
    plans = written(plan(drawn, targets(drawn)), "mix")
    return drawn.alias("d").join(plans.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times()).cast("long").alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    drawn = lots(docs)
    plans = written(plan(drawn, targets(drawn)), "mix").withColumnRenamed("source", "__source")
    keyed = docs.select(F.struct("*").alias("__row"), lot(F.col("doc_id"), F.col("text")).alias("key"))
    return keyed.join(plans, F.col("__row.source").eqNullSafe(F.col("__source"))).where(
        times() > 0).select("__row", F.explode(F.sequence(F.lit(1), times()))).select("__row.*")
