"""Writers, and the shape of each output table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.constants import REDSHIFT_TOLERANCE
from lumenpeak.operators.halo import CHUNK
from lumenpeak.operators.pixels import first_per_key

ALTERNATIVES = 15


def write_candidates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def catalogue(df: DataFrame, prob_cut: float = 0.0) -> DataFrame:
    """Best candidate of each object with enough probability."""
    return df.where(~F.col("DUPLICATED") & (F.col("PROB") >= float(prob_cut)))


def write_catalogue(df: DataFrame, path: str, prob_cut: float = 0.0) -> None:
    catalogue(df, prob_cut).write.mode("overwrite").parquet(path)


def write_spectra(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Array-form spectra, one folder per plate if partitioned; empty plates have none.

    With a partition column a plate's rows are spread by SPECID over the tasks,
    so a plate of any size is written in parallel.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def to_spectra(pixels: DataFrame, *keep: str, chunk: int = CHUNK) -> DataFrame:
    """Pixels -> array form, arrays in pixel order.

    A spectrum of more than ``chunk`` pixels becomes several rows, told apart by
    ``start``, the position of the first pixel; no row holds more than ``chunk``.
    """
    packed = F.sort_array(F.collect_list(F.struct("pix", "wave", "flux", "ivar")))
    rows = (pixels.withColumn("start", F.expr(f"pix div {chunk} * {chunk}"))
            .groupBy("SPECID", *keep, "start").agg(packed.alias("__p")))
    return rows.select("SPECID", *keep, "start", *[
        F.col(f"__p.{c}").alias(c) for c in ("wave", "flux", "ivar")])


def priors(df: DataFrame, prob_cut: float = 0.0,
           sigma: float = REDSHIFT_TOLERANCE) -> DataFrame:
    """Gaussian redshift prior of each catalogue object."""
    return catalogue(df, prob_cut).select(
        F.col("APS_ID").alias("TARGETID"), F.lit("gaussian").alias("FUNCTION"),
        F.col("Z_TRY").alias("Z"), F.lit(float(sigma)).alias("SIGMA"))


def quasar_ids(df: DataFrame, refined: DataFrame, order: Sequence[str],
               prob_cut: float = 0.0, prefix: str = "") -> DataFrame:
    """Catalogue objects with the first refined redshift of their APS_ID."""
    best = first_per_key(refined, ["APS_ID"], order).select("APS_ID", F.col("Z").alias("__z"))
    return catalogue(df, prob_cut).join(best, "APS_ID").select(
        "CNAME", "TARGID", F.lit("QSO").alias("TARGCLASS"), F.col("PROB").alias(f"{prefix}PROB"),
        F.col("__z").alias(f"{prefix}Z"))


def alternatives(df: DataFrame, tie: Sequence[str], prob_cut: float = 0.0,
                 count: int = ALTERNATIVES, prefix: str = "") -> DataFrame:
    """Up to ``count`` (PROB, Z_TRY) per catalogue CNAME, most probable first, NULL padded.

    The rank filter lets Spark keep only ``count`` rows per name before the shuffle.
    """
    w = Window.partitionBy("CNAME").orderBy(F.col("PROB").desc_nulls_last(), *tie)
    top = (df.select("CNAME", "PROB", "Z_TRY", *tie)
           .withColumn("rank", F.row_number().over(w)).where(f"rank <= {count}"))
    named = catalogue(df, prob_cut).select("CNAME").distinct()
    lists = top.join(named, "CNAME", "left_semi").groupBy("CNAME").agg(
        F.map_from_entries(F.collect_list(
            F.struct("rank", F.struct("PROB", "Z_TRY")))).alias("__m"))

    def padded(field: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(count)),
                           lambda i: F.try_element_at("__m", i)[field])

    return lists.select("CNAME", padded("PROB").alias(f"{prefix}PROB"),
                        padded("Z_TRY").alias(f"{prefix}Z"))


def reduced(df: DataFrame) -> DataFrame:
    """Identifier, redshift and confidence of the best candidates."""
    return df.where(~F.col("DUPLICATED")).select(
        "TARGETID", F.col("Z_TRY").alias("Z_SQ"), F.col("PROB").alias("Z_SQ_CONF"))
