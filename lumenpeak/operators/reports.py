"""Data behind the figures: precision, histograms, comparisons, confusion, lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpeak.functions.columns import literal_array, ratio
from lumenpeak.functions.constants import (GALAXY, LIGHT_SPEED, LINES, QUASAR, SPLIT_REDSHIFT,
                                           STAR, VELOCITY_EDGES)
from lumenpeak.functions.shared import written
from lumenpeak.operators.quantiles import medians


def magnitude_bin(bins: Sequence[float], magnitude: str = "R_MAG") -> Column:
    """Index of the bin with lo < magnitude <= hi, NULL outside."""
    m = F.col(magnitude)
    return reduce(lambda c, i: c.when((m > float(bins[i])) & (m <= float(bins[i + 1])), i),
                  range(len(bins) - 1), F.when(F.lit(False), F.lit(None).cast("int")))


def _edge(bins: Sequence[float], index: str, shift: int = 0) -> Column:
    return F.element_at(literal_array(bins), F.col(index) + 1 + shift)


def velocity(df: DataFrame) -> DataFrame:
    """Redshift error as a velocity in km/s."""
    return df.withColumn("DELTA_V", F.try_divide("DELTA_Z", 1 + F.col("Z_TRUE")) * LIGHT_SPEED)


def correct_in_bins(df: DataFrame, bins: Sequence[float], magnitude: str = "R_MAG") -> DataFrame:
    return velocity(df.where("IS_CORRECT")).withColumn(
        "mag_bin", magnitude_bin(bins, magnitude)).where("mag_bin IS NOT NULL")


def redshift_precision(df: DataFrame, bins: Sequence[float],
                       magnitude: str = "R_MAG") -> DataFrame:
    """Mean, sample deviation, 100 * NMAD and number of correct rows per magnitude bin."""
    # written once: the medians pass over these rows several times
    rows = written(correct_in_bins(df, bins, magnitude).select(
        "mag_bin", "DELTA_V", F.abs("DELTA_V").alias("speed")), "precision")
    middle = medians(rows, "mag_bin", "speed")
    stats = rows.groupBy("mag_bin").agg(
        F.avg("DELTA_V").alias("mean_dv"), F.stddev_samp("DELTA_V").alias("sigma_dv"),
        F.count("*").alias("n"))
    nmad = reduce(lambda c, k: c.when(F.col("mag_bin") == k,
                                      middle[k] / LIGHT_SPEED * 1.48 * 100),
                  middle, F.when(F.lit(False), F.lit(None).cast("double")))
    return stats.select(_edge(bins, "mag_bin").alias("mag_lo"),
                        _edge(bins, "mag_bin", 1).alias("mag_hi"),
                        "mean_dv", "sigma_dv", nmad.alias("nmad100"), "n")


def histogram(df: DataFrame, value: str, edges: Sequence[float], by: Sequence[str] = (),
              density: bool = True) -> DataFrame:
    """Counts per bin [edge_i, edge_i+1), the last one closed; equal-width edges.

    With ``density`` also count / (inside count * width).  Bins are small in
    number, so all shuffled rows are pre-counted ones.
    """
    edges = [float(e) for e in edges]
    n = len(edges) - 1
    width = (edges[-1] - edges[0]) / n
    grid = literal_array(edges)
    x = F.col(value)
    guess = F.least(F.floor((x - edges[0]) / width), F.lit(n - 1)).cast("int")
    # floating division may be one bin off at an edge: compare with the edges
    exact = (F.when(x < F.element_at(grid, F.col("__g") + 1), F.col("__g") - 1)
             .when((x >= F.element_at(grid, F.col("__g") + 2)) & (F.col("__g") < n - 1),
                   F.col("__g") + 1).otherwise(F.col("__g")))
    counted = (df.where((x >= edges[0]) & (x <= edges[-1])).withColumn("__g", guess)
               .withColumn("bin", exact).groupBy(*by, "bin").agg(F.count("*").alias("n")))
    out = counted.withColumns({"bin_lo": F.element_at(grid, F.col("bin") + 1),
                               "bin_hi": F.element_at(grid, F.col("bin") + 2)})
    if density:
        from pyspark.sql import Window

        inside = F.sum("n").over(Window.partitionBy(*by))
        out = out.withColumn("density", ratio(F.col("n"), inside * F.lit(width)))
    return out


def velocity_histogram(df: DataFrame, bins: Sequence[float],
                       edges: Sequence[float] = VELOCITY_EDGES) -> DataFrame:
    """Density of the velocity error of correct rows per magnitude bin."""
    return histogram(correct_in_bins(df, bins), "DELTA_V", edges, ["mag_bin"]).withColumns({
        "mag_lo": _edge(bins, "mag_bin"), "mag_hi": _edge(bins, "mag_bin", 1)}).drop("mag_bin")


def _column_edges() -> list[float]:
    return [-1.0 + 5.0 * i / 100 for i in range(101)]


def column_histogram(df: DataFrame, column: str, density: bool = True,
                     by_correct: bool = False) -> DataFrame:
    """100 bins over [-1, 4], of all rows or split by IS_CORRECT."""
    return histogram(df, column, _column_edges(), ["IS_CORRECT"] if by_correct else [], density)


def ratio_histograms(df: DataFrame, density: bool = True, by_correct: bool = False) -> DataFrame:
    """The column histogram of every column with RATIO in its name."""
    columns = [c for c in df.columns if "RATIO" in c]
    keep = ["IS_CORRECT"] if by_correct else []
    long = df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("__v")).select(*keep, "__v.*")
    return histogram(long, "value", _column_edges(), [*keep, "column"], density)


def compare_runs(runs: DataFrame, control: str) -> DataFrame:
    """Metric of each run minus the control's, per case and magnitude cut."""
    metrics = ("f1_score", "purity", "completeness")
    base = runs.where(F.col("run") == control).select(
        "case", "mag_cut", *[F.col(m).alias(f"control_{m}") for m in metrics])
    return (runs.where("case <> 'all z'").join(base, ["case", "mag_cut"])
            .select("run", "case", "mag_cut", *metrics,
                    *[(F.col(m) - F.col(f"control_{m}")).alias(f"diff_{m}") for m in metrics]))


def confusion_points(df: DataFrame, bins: Sequence[float], prob_low: float = 0.0,
                     prob_high: float = 0.0, magnitude: str = "R_MAG") -> DataFrame:
    """(mag_lo, mag_hi, kind, Z_TRUE, Z_TRY): correct rows, and selected rows by class.

    Selected: PROB above the threshold of the row's redshift side.  A row can be
    both 'correct' and of its class.
    """
    selected = F.coalesce(F.when(F.col("Z_TRY") >= SPLIT_REDSHIFT, F.col("PROB") > prob_high)
                          .when(F.col("Z_TRY") < SPLIT_REDSHIFT, F.col("PROB") > prob_low),
                          F.lit(False))
    kind = F.when(selected & (F.col("CLASS_PERSON") == QUASAR), "qso").when(
        selected & (F.col("CLASS_PERSON") == GALAXY), "galaxy").when(
        selected & (F.col("CLASS_PERSON") == STAR), "star")
    kinds = F.array_compact(F.array(F.when(F.col("IS_CORRECT"), "correct"), kind))
    return (df.withColumn("mag_bin", magnitude_bin(bins, magnitude))
            .where("mag_bin IS NOT NULL")
            .select(_edge(bins, "mag_bin").alias("mag_lo"),
                    _edge(bins, "mag_bin", 1).alias("mag_hi"),
                    F.explode(kinds).alias("kind"), "Z_TRUE", "Z_TRY"))


def line_pairs(lines: Sequence[tuple] = LINES,
               exclude: Sequence[tuple[str, str]] = ()) -> list[tuple[str, str, float]]:
    """(real, assumed, wave ratio) of all ordered pairs of different lines."""
    return [(a[0], b[0], a[1] / b[1]) for a in lines for b in lines
            if a[0] != b[0] and (a[0], b[0]) not in set(exclude)]


def confusion_tracks(redshifts: DataFrame, lines: Sequence[tuple] = LINES,
                     exclude: Sequence[tuple[str, str]] = (), z: str = "z") -> DataFrame:
    """Redshift read off when a line at z is taken for another one."""
    pairs = F.array(*[F.struct(F.lit(a).alias("real"), F.lit(b).alias("assumed"),
                               F.lit(r).alias("r")) for a, b, r in line_pairs(lines, exclude)])
    return redshifts.select(F.col(z).alias("z"), F.explode(pairs).alias("__p")).select(
        "z", "__p.real", "__p.assumed",
        (F.col("__p.r") * (1 + F.col("z")) - 1).alias("z_assumed"))


def observed_lines(spectra: DataFrame, lines: Sequence[tuple] = LINES) -> DataFrame:
    """Lines of quasars and galaxies that fall inside the spectrum.

    ``spectra``: SPECID, CLASS_PERSON, Z_TRUE, min_wave, max_wave.
    """
    every = F.array(*[F.struct(F.lit(line[0]).alias("LINE"), F.lit(float(line[1])).alias("w"))
                      for line in lines])
    return (spectra.where(F.col("CLASS_PERSON").isin(QUASAR, GALAXY))
            .withColumn("__l", F.explode(every))
            .withColumn("wave_observed", F.col("__l.w") * (1 + F.col("Z_TRUE")))
            .where("min_wave < wave_observed AND wave_observed < max_wave")
            .select("SPECID", "__l.LINE", "wave_observed"))
