"""The emission line table, as a DataFrame and as literal columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpeak.functions.constants import LINE_COLUMNS, LINES, TRY_LINES

LINES_SCHEMA = "line_index INT, LINE STRING, " + ", ".join(
    f"{c} DOUBLE" for c in LINE_COLUMNS[1:])


def lines_frame(spark: SparkSession, lines: Sequence[tuple] = LINES) -> DataFrame:
    """Line table with its declared position."""
    return spark.createDataFrame(
        [(i, *line) for i, line in enumerate(lines)], LINES_SCHEMA)


def line_position(lines: Sequence[tuple] = LINES) -> dict[str, int]:
    """Name -> position, with -1 for the row of a spectrum without peaks."""
    return {**{line[0]: i for i, line in enumerate(lines)}, "none": -1}


def check_try_lines(try_lines: Sequence[str], lines: Sequence[tuple]) -> None:
    unknown = [name for name in try_lines if name not in line_position(lines)]
    if unknown:
        raise ValueError(f"try lines {unknown} are not in the line table")


def try_line_structs(try_lines: Sequence[str] = TRY_LINES,
                     lines: Sequence[tuple] = LINES) -> Column:
    """Array literal of (try_order, line name, position, rest wavelength).

    Exploding a literal adds the try-lines to each peak without a join.
    """
    check_try_lines(try_lines, lines)
    where = line_position(lines)
    return F.array(*[
        F.struct(F.lit(order).alias("try_order"), F.lit(name).alias("ASSUMED_LINE"),
                 F.lit(where[name]).alias("assumed_index"),
                 F.lit(lines[where[name]][1]).alias("rest_wave"))
        for order, name in enumerate(try_lines)
    ])


def band_structs(lines: Sequence[tuple] = LINES) -> Column:
    """Array literal of (line_index, band, lo, hi) rest-frame intervals."""
    bands = []
    for index, line in enumerate(lines):
        for band, (lo, hi) in enumerate(((2, 3), (4, 5), (6, 7))):
            bands.append(F.struct(F.lit(index).alias("line_index"),
                                  F.lit(band).alias("band"),
                                  F.lit(float(line[lo])).alias("rest_lo"),
                                  F.lit(float(line[hi])).alias("rest_hi")))
    return F.array(*bands)
