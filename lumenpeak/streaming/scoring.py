"""Score arriving candidate rows with a batch model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenpeak.functions.columns import nan_to_null
from lumenpeak.operators import forest as E
from lumenpeak.plans.jobs import Model, classify


def classify_stream(candidates: DataFrame, model: Model, output: str, checkpoint: str,
                    **trigger) -> StreamingQuery:
    """Append each micro-batch, classified, to ``output``.

    A batch replaces its own folder when it is repeated, so none is written twice.
    DUPLICATED holds within a micro-batch; ``classified_so_far`` sets it over all.
    """

    def write(batch: DataFrame, number: int) -> None:
        classify(nan_to_null(batch), model).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (candidates.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def classified_so_far(spark: SparkSession, output: str, model: Model) -> DataFrame:
    """All written batches, DUPLICATED chosen over all of them as one batch job would."""
    rows = spark.read.parquet(output).drop("batch", "DUPLICATED")
    side = E.split_side("all" not in model.forests)
    branch = F.when(side.isNull(), 2).when(side == "low", 1).otherwise(0)
    tie = ("branch", "peak_pix", "try_order", *[c for c in ("SPECTRUM",) if c in rows.columns])
    return E.with_duplicates(rows.withColumn("branch", branch), tie).drop("branch")
