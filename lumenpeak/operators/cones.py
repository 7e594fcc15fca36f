"""Targets inside a table of sky cones, by zones in place of one predicate per cone.

The sky is cut into declination bands and each band into cells of about the same width
on the sphere; a cone is filed under the cells that it reaches, at the first level whose cells
are as wide as its radius, so it has few cells at any radius.  A target looks into
one cell a level, and the exact separation decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.operators.pixels import separation

# Cells are 2 ** level degrees wide, in steps of 2 ** STEP; seven levels bound the number of joins.
LOWEST, HIGHEST, STEP = -12, 6, 3
# Filed cones (six numbers each) that travel to every task; beyond it cells are shuffled.
BROADCAST_ROWS = 500_000
SALT = 32
MARGIN = 1e-9  # degrees, against rounding at the edge of a cell


def _cells(band: Column, size: float) -> Column:
    """Cells of a band: its widest circle over the cell width."""
    low, high = band * size - 90.0, (band + 1) * size - 90.0
    widest = F.when(low * high <= 0, F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(widest)) / size)).cast("long")


def _band(dec: Column, size: float) -> Column:
    last = int(180 // size)
    return F.least(F.lit(last), F.greatest(F.lit(0), F.floor((dec + 90.0) / size))).cast("long")


def _filed(cones: DataFrame, size: float) -> DataFrame:
    """Each cone once per cell that it reaches."""
    reach = F.col("__radius") + MARGIN
    bands = cones.withColumn("__band", F.explode(F.sequence(
        _band(F.col("__dec0") - reach, size), _band(F.col("__dec0") + reach, size))))
    polar = F.abs("__dec0") + reach >= 90.0
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(
        F.sin(F.radians(reach)) / F.cos(F.radians("__dec0"))))) + MARGIN
    n = _cells(F.col("__band"), size)
    first = F.floor((F.col("__ra0") - half) / 360.0 * n)
    last = F.least(F.floor((F.col("__ra0") + half) / 360.0 * n), first + n - 1)
    return bands.withColumn("__at", F.explode(F.sequence(first, last))).withColumn(
        "__cell", F.pmod("__at", n)).drop("__at")


def _kept(targets: DataFrame, cones: DataFrame, size: float, how: str) -> DataFrame:
    filed = written(_filed(cones, size), "cones")
    band = _band(F.col("DEC"), size)
    n = _cells(band, size)
    cell = F.pmod(F.floor(F.pmod(F.col("RA"), F.lit(360.0)) / 360.0 * n), n)
    meets = [band == F.col("__band"), cell == F.col("__cell")]
    if filed.count() <= BROADCAST_ROWS:
        filed = F.broadcast(filed)
    else:  # a crowded cell is dealt over many tasks, its cones are copied to each
        filed = filed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        meets.append(F.pmod(F.xxhash64(*[F.col(c) for c in targets.columns]), F.lit(SALT)) == F.col("__salt"))
    meets.append(separation(F.col("RA"), F.col("DEC"), F.col("__ra0"), F.col("__dec0")) <= F.col("__radius"))
    return targets.join(filed, meets, how)


def in_cones(targets: DataFrame, cones: DataFrame, inside: bool = True) -> DataFrame:
    """Targets (RA, DEC in degrees) inside any cone of the table (RA, DEC, RADIUS in
    degrees, border included), or outside all of them.

    Rows stay as they are, repeats too.  A target without a position is in no cone; a cone
    without a value, with NaN or a negative radius holds nothing; an empty table of cones
    holds no target.
    """
    cones = cones.select(*[F.col(c).cast("double").alias(name) for c, name in (
        ("RA", "__ra0"), ("DEC", "__dec0"), ("RADIUS", "__radius"))]).where(
        "__radius >= 0 AND NOT isnan(__radius) AND NOT isnan(__ra0) AND NOT isnan(__dec0)").distinct()
    level = F.ceil(F.log2(F.greatest("__radius", F.lit(2.0 ** LOWEST))) / STEP) * STEP
    cones = written(cones.withColumn("__level", F.least(level, F.lit(HIGHEST)).cast("int")), "cone-levels")
    levels = [r[0] for r in cones.select("__level").distinct().collect()]  # at most seven
    found, rest = [], targets
    for k in sorted(levels, reverse=True):
        of_level = cones.where(F.col("__level") == k).drop("__level")
        if inside:
            found.append(_kept(rest, of_level, 2.0 ** k, "left_semi"))
        rest = _kept(rest, of_level, 2.0 ** k, "left_anti")
    if not inside:
        return rest
    out = targets.where("false")
    for part in found:
        out = out.union(part)
    return out
