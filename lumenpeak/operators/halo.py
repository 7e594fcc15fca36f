"""Windows over pixels, cut into bounded pieces.

A window over a whole spectrum puts that spectrum into one task.  Here the
window key is (SPECID, chunk) with ``chunk = pix div CHUNK``, and every pixel is
also handed to the neighbouring chunks that look at it ("halo").  A frame of at
most ``before``/``after`` pixels around a home pixel is then complete inside its
chunk, so results are exact while no window group exceeds
``CHUNK + before + after`` rows, however long the spectrum is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 4096


def with_halo(pixels: DataFrame, before: int, after: int, chunk: int = CHUNK,
              keys: Sequence[str] = ("SPECID",)) -> DataFrame:
    """Add ``chunk`` and ``home``; pixels near a chunk edge appear more than once.

    ``before``/``after``: how many pixels ahead of / behind a home pixel its
    frames reach.  Keep only ``home`` rows after the window.
    """
    first = F.greatest(F.lit(0), F.expr(f"(pix - {after}) div {chunk}"))
    last = F.expr(f"(pix + {before}) div {chunk}")
    copies = F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))
    return (pixels.withColumn("chunk", F.explode(copies))
            .withColumn("home", F.expr(f"pix div {chunk}") == F.col("chunk")))


def chunk_window(keys: Sequence[str] = ("SPECID",)) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy("pix")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
              out: str = "pix") -> DataFrame:
    """0-based position of each row within ``keys`` ordered by ``order``.

    ``block`` must not decrease along ``order``.  Rows are numbered per
    (keys, block) and shifted by the number of rows in earlier blocks, so a key
    that owns most of the table is still numbered in many tasks; only the block
    counts of one key meet in a task.
    """
    keys = list(keys)
    df = df.withColumn("__block", block)
    counts = df.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = counts.select(
        *keys, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    numbered = df.withColumn(
        "__row", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order)))
    return (numbered.join(shifts, [*keys, "__block"])
            .withColumn(out, F.col("__shift") + F.col("__row") - 1)
            .drop("__block", "__row", "__shift"))
