"""Smoothing, local maxima and their significance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpeak.functions.columns import literal_array, total
from lumenpeak.functions.constants import PEAK_MIN_SIGNIFICANCE, PEAK_WIDTH
from lumenpeak.operators.halo import CHUNK, chunk_window, with_halo

# Kernels up to this length are summed by a compiled expression; longer ones are
# convolved per chunk on Arrow batches.
MAX_WRITTEN_TAPS = 41


def smoothing_kernel(width: float) -> list[float]:
    """Unit-sum Gaussian of the given width in pixels, ``ceil(8*width)`` taps, odd."""
    size = math.ceil(8 * width)
    half = size // 2
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / width) ** 2)
    return [float(t) for t in taps / taps.sum()]


def frame_sizes(width: float) -> tuple[int, int]:
    """(full, half) window of the significance, in pixels."""
    full = int(2.355 * width) if width > 0 else 2
    return full, full // 2


def _gathered(pieces: DataFrame, taps: list[float]) -> DataFrame:
    """Weighted sum of neighbours: pixels off the edge count as zero flux, pixels
    without flux are left out and the remaining weights rescaled.

    One moving frame gathers the neighbours of a pixel; the sum over them is
    written out term by term, so it is compiled and its order is fixed.
    """
    half = len(taps) // 2
    frame = chunk_window().rowsBetween(-half, half)
    # flux that is not finite is missing, as in the convolution of long kernels
    known = F.coalesce(F.when(F.abs("flux") < F.lit(float("inf")), F.col("flux")), F.lit(float("nan")))
    pieces = pieces.withColumns({"__near": F.collect_list(known).over(frame),
                                 "__first": F.first("pix").over(frame)})
    # at an edge the frame is shorter: __skip leading neighbours are off the edge
    pieces = pieces.withColumn(
        "__skip", (F.col("__first") - F.col("pix") + half).cast("int")).withColumn(
        "__clean", ~F.array_contains("__near", float("nan")))

    def near(k: int) -> Column:
        return F.coalesce(F.get("__near", F.lit(k) - F.col("__skip")), F.lit(0.0))

    whole = total([near(k) * F.lit(t) for k, t in enumerate(taps)])
    # rarely needed, so kept out of the compiled path
    weights = F.zip_with("__near", F.slice(literal_array(taps), F.col("__skip") + 1,
                                           F.size("__near")),
                         lambda x, t: F.struct(F.nanvl(x, F.lit(0.0)).alias("x"),
                                               F.when(F.isnan(x), t).otherwise(0.0).alias("lost"),
                                               t.alias("t")))
    some = F.aggregate(weights, F.lit(0.0), lambda a, e: a + e["x"] * e["t"])
    seen = 1.0 - F.aggregate(weights, F.lit(0.0), lambda a, e: a + e["lost"])
    return pieces.withColumn("smoothed", F.when(F.col("__clean"), whole).otherwise(
        F.try_divide(some, seen))).drop("__near", "__first", "__skip", "__clean")


def _convolved(chunks: DataFrame, taps: list[float]) -> DataFrame:
    kernel = np.array(taps)

    def convolve(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("pix")
        flux = piece["flux"].to_numpy(float)
        bad = ~np.isfinite(flux)
        same = slice(len(kernel) // 2, len(kernel) // 2 + len(flux))
        smooth = np.convolve(np.where(bad, 0.0, flux), kernel)[same]
        if bad.any():
            weight = 1.0 - np.convolve(bad.astype(float), kernel)[same]
            smooth = np.divide(smooth, weight, out=np.full_like(smooth, np.nan), where=weight > 0)
        return piece.assign(smoothed=smooth)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.groupBy("SPECID", "chunk").applyInPandas(convolve, f"{schema}, smoothed DOUBLE")


def smooth(pixels: DataFrame, width: float, chunk: int = CHUNK) -> DataFrame:
    """Add ``smoothed``: flux convolved with a Gaussian; width <= 0 copies the flux."""
    if width <= 0:
        return pixels.withColumn("smoothed", F.col("flux"))
    taps = smoothing_kernel(width)
    half = len(taps) // 2
    pieces = with_halo(pixels, half, half, chunk)
    return _smoothed_pieces(pieces, width).where("home").drop("chunk", "home")


def _smoothed_pieces(pieces: DataFrame, width: float) -> DataFrame:
    if width <= 0:
        return pieces.withColumn("smoothed", F.col("flux"))
    taps = smoothing_kernel(width)
    if len(taps) <= MAX_WRITTEN_TAPS:
        return _gathered(pieces, taps)
    return _convolved(pieces, taps)


def local_maxima(pixels: DataFrame, width: float = PEAK_WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Pixels whose smoothed flux is above both neighbours; the ends never are."""
    half = len(smoothing_kernel(width)) // 2 if width > 0 else 0
    pieces = _smoothed_pieces(with_halo(pixels, half + 1, half + 1, chunk), width)
    return _maxima(pieces).where("home AND is_max").drop("chunk", "home", "is_max")


def _maxima(pieces: DataFrame) -> DataFrame:
    w = chunk_window()
    return pieces.withColumn("is_max", (F.col("smoothed") > F.lag("smoothed").over(w))
                             & (F.col("smoothed") > F.lead("smoothed").over(w)))


def find_peaks(pixels: DataFrame, width: float = PEAK_WIDTH,
               min_significance: float | None = PEAK_MIN_SIGNIFICANCE,
               chunk: int = CHUNK) -> DataFrame:
    """Significant peaks of the smoothed flux: (SPECID, pix, wave, significance).

    ``pixels``: (SPECID, pix, wave, flux, ivar), pix counting from 0 without
    holes.  Significance compares the mean flux around the peak with the mean of
    both sides, in units of the frame's error; it is missing (and the peak
    dropped) where the frame leaves the spectrum, misses a flux or has no ivar.
    """
    full, half = frame_sizes(width)
    reach = max(full, (len(smoothing_kernel(width)) // 2 if width > 0 else 0) + 1)
    columns = pixels.select("SPECID", "pix", "wave", "flux", "ivar")
    pieces = _maxima(_smoothed_pieces(with_halo(columns, reach, reach, chunk), width))
    w = chunk_window()
    framed = pieces.withColumns({
        "peak": F.avg("flux").over(w.rowsBetween(-half, half - 1)),
        "blue": F.avg("flux").over(w.rowsBetween(-full, -half - 1)),
        "red": F.avg("flux").over(w.rowsBetween(half, full - 1)),
        "weight": F.sum("ivar").over(w.rowsBetween(-full, full - 1)),
        "seen": F.count("flux").over(w.rowsBetween(-full, full - 1)),
    })
    significance = (F.col("peak") - (F.col("blue") + F.col("red")) / 2.0) * F.sqrt("weight")
    peaks = (framed.where(F.col("home") & F.col("is_max") & (F.col("seen") == 2 * full)
                          & (F.col("weight") != 0.0))
             .select("SPECID", "pix", "wave", significance.alias("significance")))
    if min_significance is None:
        return peaks
    return peaks.where(F.col("significance") >= float(min_significance))
