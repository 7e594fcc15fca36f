"""Repeated exposures, bands and spectrograph arms combined into one spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.columns import ratio
from lumenpeak.functions.shared import written
from lumenpeak.operators.halo import CHUNK, chunk_window, positions, with_halo
from lumenpeak.operators.pixels import first_per_key

EXPOSURE_KEY = ("SPECID", "band", "pix")


def mask_exposures(pixels: DataFrame) -> DataFrame:
    """ivar = 0 where the pixel mask is set."""
    return pixels.withColumn("ivar", F.when(F.col("mask"), 0.0).otherwise(F.col("ivar")))


def combine_exposures(pixels: DataFrame) -> DataFrame:
    """ivar-weighted mean flux and summed ivar per pixel; 0 where no ivar is left."""
    summed = pixels.groupBy(*EXPOSURE_KEY).agg(
        F.min("wave").alias("wave"), F.sum(F.col("flux") * F.col("ivar")).alias("weighted"),
        F.sum("ivar").alias("ivar"))
    return summed.select(*EXPOSURE_KEY, "wave", F.coalesce(
        ratio(F.col("weighted"), F.col("ivar")), F.lit(0.0)).alias("flux"), "ivar")


def first_exposure(pixels: DataFrame) -> DataFrame:
    """Only the first exposure of each pixel."""
    return first_per_key(pixels, EXPOSURE_KEY, ["exposure"]).select(
        *EXPOSURE_KEY, "wave", "flux", "ivar")


def combine_bands(pixels: DataFrame, points: int = 4000, chunk: int = CHUNK) -> DataFrame:
    """Resample all bands of a spectrum to one linear grid and add them up.

    The grid runs from the smallest to the largest wavelength in ``points`` steps.
    A source pixel reaches half way to its neighbours in the band; each grid cell
    receives ivar and ivar*flux in proportion to the overlap.  Pixels are spread
    only over the cells they touch.
    """
    span = pixels.groupBy("SPECID").agg(F.min("wave").alias("lo"), F.max("wave").alias("hi"))
    w = chunk_window(("SPECID", "band"))
    before, after = F.lag("wave").over(w), F.lead("wave").over(w)
    edged = with_halo(pixels, 1, 1, chunk).withColumns({"before": before, "after": after})
    wave = F.col("wave")
    low = F.coalesce((F.col("before") + wave) / 2.0, wave - (F.col("after") - wave) / 2.0)
    high = F.coalesce((F.col("after") + wave) / 2.0, wave + (wave - F.col("before")) / 2.0)
    cells = (edged.where("home").withColumns({"left": low, "right": high})
             .join(span, "SPECID")
             .withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1))
             .where("step > 0"))
    first = F.greatest(F.floor((F.col("left") - F.col("lo")) / F.col("step") + 0.5), F.lit(0))
    last = F.least(F.floor((F.col("right") - F.col("lo")) / F.col("step") + 0.5),
                   F.lit(points - 1))
    spread = cells.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    center = F.col("lo") + F.col("k") * F.col("step")
    overlap = F.greatest(F.lit(0.0), F.least(F.col("right"), center + F.col("step") / 2.0)
                         - F.greatest(F.col("left"), center - F.col("step") / 2.0))
    weight = overlap / F.col("step")
    resampled = spread.withColumn("weight", weight).groupBy("SPECID", "k").agg(
        F.sum(F.col("ivar") * F.col("weight")).alias("ivar"),
        F.sum(F.col("flux") * F.col("ivar") * F.col("weight")).alias("weighted"))
    grid = span.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return (grid.join(resampled, ["SPECID", "k"], "left").select(
        "SPECID", F.col("k").cast("bigint").alias("pix"),
        (F.col("lo") + F.col("k") * ((F.col("hi") - F.col("lo")) / (points - 1))).alias("wave"),
        F.coalesce(ratio(F.col("weighted"), F.col("ivar")), F.lit(0.0)).alias("flux"),
        F.coalesce("ivar", F.lit(0.0)).alias("ivar")))


def correct_sensitivity(pixels: DataFrame, propagate: bool = False) -> DataFrame:
    """flux * sens and ivar * sens (or ivar / sens^2 with ``propagate``)."""
    ivar = (ratio(F.col("ivar"), F.col("sens") * F.col("sens")) if propagate
            else F.col("ivar") * F.col("sens"))
    return pixels.withColumn("flux", F.col("flux") * F.col("sens")).withColumn("ivar", ivar)


def trim_edges(pixels: DataFrame) -> DataFrame:
    """Keep each arm from its second to its next-to-last pixel with signal.

    An arm with fewer than two such pixels is dropped.  Pixels are read for both ends and
    once more for the cut, so they are written first, not made three times; the result is
    written too, as gaps and their edges read it again.
    """
    key, pixels = ["SPECID", "arm"], written(pixels, "arms")
    signal = pixels.where("flux <> 0 AND ivar <> 0").select(*key, "wave")

    def second(order, pick):
        w = Window.partitionBy(*key).orderBy(order)
        return (signal.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
                .groupBy(*key).agg(pick, F.count("*").alias("n")).where("n = 2").drop("n"))

    lo = second(F.col("wave").asc(), F.max("wave").alias("lo"))
    hi = second(F.col("wave").desc(), F.min("wave").alias("hi"))
    bounds = written(lo.join(hi, key), "arm-ends")
    return written(pixels.join(bounds, key).where("wave >= lo AND wave <= hi").drop("lo", "hi"), "trimmed")


def find_gaps(pixels: DataFrame, margin: int = 4) -> DataFrame:
    """Extent of the dead pixels (flux and ivar zero) of each arm, widened.

    Returns (SPECID, arm, start_pix, end_pix): ``margin`` steps of the regular
    wavelength axis beyond the first and last dead pixel.
    """
    dead = pixels.where("flux = 0 AND ivar = 0")
    return dead.groupBy("SPECID", "arm").agg(
        (F.min("pix") - margin).alias("start_pix"), (F.max("pix") + margin).alias("end_pix"))


def fill_gaps(pixels: DataFrame, gaps: DataFrame) -> DataFrame:
    """Linear interpolation of the flux strictly inside each arm's gap.

    Arms without a gap, or whose gap edge is not a pixel, are left as they are.  Gaps and
    edges have few rows per arm; written, their size lets Spark leave the pixels where they lie.
    """
    key, gaps = ["SPECID", "arm"], written(gaps, "gaps")

    ends = gaps.select(*key, F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(position).alias("pix"))
        for side, position in (("a", "start_pix"), ("b", "end_pix"))])).alias("end")).select(*key, "end.*")
    found = written(pixels.join(ends, [*key, "pix"]).select(*key, "side", "wave", "flux"), "gap-edges")

    def edge(side: str) -> DataFrame:
        return found.where(F.col("side") == side).select(
            *key, F.col("wave").alias(f"{side}_wave"), F.col("flux").alias(f"{side}_flux"))

    edges = edge("a").join(edge("b"), key)
    slope = ratio(F.col("a_flux") - F.col("b_flux"), F.col("a_wave") - F.col("b_wave"))
    inside = (F.col("wave") > F.col("a_wave")) & (F.col("wave") < F.col("b_wave"))
    filled = F.when(inside, slope * (F.col("wave") - F.col("a_wave")) + F.col("a_flux"))
    return (pixels.join(edges, key, "left")
            .withColumn("flux", F.coalesce(filled, F.col("flux")))
            .drop("a_wave", "a_flux", "b_wave", "b_flux"))


def combine_arms(pixels: DataFrame) -> DataFrame:
    """Mean flux and ivar of the arms at each wavelength."""
    return pixels.groupBy("SPECID", "wave").agg(F.avg("flux").alias("flux"),
                                                F.avg("ivar").alias("ivar"))


def numbered_pixels(pixels: DataFrame, step: float = 4096.0) -> DataFrame:
    """Add ``pix`` = position along the wavelength, after combining or dropping pixels.

    Positions read their rows twice, so these are written, not combined twice."""
    return positions(written(pixels, "unnumbered"), ["SPECID"], ["wave"], F.floor(F.col("wave") / F.lit(step)))


def arm_spectra(pixels: DataFrame) -> DataFrame:
    """Two-arm pixels (with ``sens``) -> one numbered spectrum per target."""
    arms = trim_edges(correct_sensitivity(pixels))
    return numbered_pixels(combine_arms(fill_gaps(arms, find_gaps(arms))))


def exposure_spectra(pixels: DataFrame, single: bool = False, points: int = 4000) -> DataFrame:
    """Multi-exposure, multi-band pixels (with ``mask``) -> one spectrum per target."""
    masked = mask_exposures(pixels)
    one = first_exposure(masked) if single else combine_exposures(masked)
    return combine_bands(one, points)
