"""Peaks above a fitted continuum: power law and broken power law.

Both fits clip outliers and refit until they settle.  A spectrum of at most CHUNK
pixels is packed into one row and fitted there, all rounds at once; only longer ones
go through rounds over the pixel table.  In these the clipping state of a pixel follows from the fits made so far (it stays while no accepted fit flagged
it), so what passes from round to round is one small row per spectrum; the
pixels are only scanned, aggregated where they lie, and never rewritten.
Spectra that have settled drop out of later rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenpeak.functions.columns import bound, ratio
from lumenpeak.functions.constants import POWER_LAW_MIN_SIGNIFICANCE
from lumenpeak.functions.shared import written, written_round
from lumenpeak.operators.halo import CHUNK
from lumenpeak.operators.packedfits import broken_power_law_of, fitter, power_law_of

# Logarithms of wavelength are taken relative to this, to keep the sums well
# conditioned; it cancels in the results.
LOG_ORIGIN = 8.5

# Steps of least squares in flux that follow the start of each broken fit.
FLUX_STEPS = 2

_CLIPS = "ARRAY<STRUCT<amplitude: DOUBLE, power_index: DOUBLE>>"


def power_law(wave: Column) -> Column:
    return F.col("amplitude") * F.pow(wave, -F.col("power_index"))


def _kept(model: str, min_significance: float) -> Column:
    """No accepted fit flagged the pixel; an undefined significance flags it.

    ``model`` is the SQL of the model flux of the clip ``f``.
    """
    return F.expr(f"forall(clips, f -> coalesce(abs(flux - ({model})) * sqrt(ivar) < "
                  f"{float(min_significance)!r}D, false))")


_POWER_LAW = "f.amplitude * pow(wave, -f.power_index)"


def _finite(sql: str) -> str:
    return f"({sql} IS NOT NULL AND NOT isnan({sql}) AND abs({sql}) <> double('infinity'))"


def _closed_form(sums: DataFrame) -> DataFrame:
    """Weighted straight line through (log wave, log flux) from its five sums."""
    sums = bound(sums, slope="try_divide(sxy * sw - sx * sy, sxx * sw - sx * sx)")
    sums = bound(sums, raw=f"exp(try_divide(sy - slope * sx, sw) - slope * {LOG_ORIGIN}D)")
    sums = bound(sums, usable=f"n >= 3 AND raw > 0 AND {_finite('raw')} AND {_finite('slope')}")
    sums = bound(sums, tried="CASE WHEN n < 3 THEN mean_flux WHEN usable THEN raw "
                             "ELSE mean_used END",
                 tried_index="CASE WHEN usable THEN -slope ELSE 0D END")
    return bound(sums, fit_failed="coalesce(tried <= 0, true)",
                 fit_amplitude="CASE WHEN coalesce(tried <= 0, true) THEN mean_flux ELSE tried END",
                 fit_index="CASE WHEN coalesce(tried <= 0, true) THEN 0D ELSE tried_index END")


def _power_law_sums(pixels: DataFrame, min_significance: float) -> DataFrame:
    """Per spectrum: sums of the weighted regression over the kept pixels.

    The least squares multiplies both sides by ivar, hence weights ivar squared.
    """
    usable = f"flux > 0 AND ivar > 0 AND {_finite('flux')} AND {_finite('ivar')}"
    kept = pixels.withColumn("use", F.expr(usable) & _kept(_POWER_LAW, min_significance))
    terms = kept.selectExpr(
        "SPECID", "flux", "use", "CASE WHEN use THEN ivar * ivar END AS w",
        f"CASE WHEN use THEN ln(wave) - {LOG_ORIGIN}D END AS x",
        "CASE WHEN use THEN ln(flux) END AS y")
    return terms.groupBy("SPECID").agg(*[F.expr(e) for e in (
        "count(w) AS n", "sum(w) AS sw", "sum(w * x) AS sx", "sum(w * y) AS sy",
        "sum(w * x * x) AS sxx", "sum(w * x * y) AS sxy", "avg(flux) AS mean_flux",
        "avg(CASE WHEN use THEN flux END) AS mean_used")])


def _by_length(pixels: DataFrame, one: Callable, schema: str, rounds: Callable,
               chunk: int) -> DataFrame:
    """Fits of the spectra of at most ``chunk`` pixels, each in its row by ``one``, and
    of the longer ones by ``rounds``."""
    pixels = pixels.select("SPECID", "pix", "wave", F.nanvl("flux", F.lit(None)).alias("flux"), "ivar")
    sizes = pixels.groupBy("SPECID").agg(F.count("*").alias("n"))
    long = written(sizes.where(F.col("n") > chunk).select("SPECID"), "long-spectra")
    some = not long.isEmpty()
    short = pixels.join(long, "SPECID", "left_anti") if some else pixels
    # a list skips NULL, so that all three arrays are packed as one
    packed = short.groupBy("SPECID").agg(F.collect_list(F.struct("wave", "flux", "ivar")).alias("p")).select(
        "SPECID", *[F.col(f"p.{c}").alias(c) for c in ("wave", "flux", "ivar")])
    schema = f"SPECID {dict(pixels.dtypes)['SPECID']}, {schema}"
    fits = packed.mapInArrow(fitter(one, to_arrow_schema(StructType.fromDDL(schema))), schema)
    fits = written(fits, "fits")
    return fits.unionByName(rounds(pixels.join(long, "SPECID", "left_semi"))) if some else fits


def fit_power_law(pixels: DataFrame, min_significance: float = POWER_LAW_MIN_SIGNIFICANCE,
                  chunk: int = CHUNK) -> DataFrame:
    """Iterative sigma-clipped power law per spectrum.

    Returns (SPECID, amplitude, power_index, clips, failed): ``clips`` are the
    accepted fits in order, ``failed`` says that the last accepted fit is the flat
    fallback, whose significances are zero.  A pixel is clipped if any accepted
    fit found it at or above ``min_significance``.  Rounds go on until every
    spectrum reproduces its own fit.
    """
    return _by_length(
        pixels, lambda *arrays: power_law_of(*arrays, min_significance, LOG_ORIGIN),
        f"amplitude DOUBLE, power_index DOUBLE, clips {_CLIPS}, failed BOOLEAN",
        lambda long: _power_law_rounds(long, min_significance), chunk)


def _power_law_rounds(pixels: DataFrame, min_significance: float) -> DataFrame:
    state, done = None, []
    while True:
        if state is None:
            # every spectrum starts without a clip and with the fit (0, 0)
            source = pixels.selectExpr("*", f"CAST(array() AS {_CLIPS}) AS clips")
            previous = _power_law_sums(source, min_significance).selectExpr(
                "*", "0D AS amplitude", "0D AS power_index", "true AS failed",
                f"CAST(array() AS {_CLIPS}) AS clips")
        else:
            source = pixels.join(state.select("SPECID", "clips"), "SPECID")
            previous = state.drop("settled").join(_power_law_sums(source, min_significance),
                                                  "SPECID")
        fitted = bound(_closed_form(previous), settled="""coalesce(
            abs(amplitude - fit_amplitude) <= 1e-8D + 1e-5D * abs(fit_amplitude)
            AND abs(power_index - fit_index) <= 1e-8D + 1e-5D * abs(fit_index),
            fit_amplitude IS NULL)""")
        stepped = fitted.selectExpr(
            "SPECID",
            """CASE WHEN settled OR fit_failed THEN clips ELSE array_append(clips, named_struct(
               'amplitude', fit_amplitude, 'power_index', fit_index)) END AS clips""",
            "CASE WHEN settled THEN amplitude ELSE fit_amplitude END AS amplitude",
            "CASE WHEN settled THEN power_index ELSE fit_index END AS power_index",
            "CASE WHEN settled THEN failed ELSE fit_failed END AS failed", "settled")
        settled, state, left = written_round(stepped, "power-law-round", "settled")
        done.append(settled)
        if not left:
            break
    return reduce(DataFrame.unionByName, done).select(
        "SPECID", "amplitude", "power_index", "clips", "failed")


def power_law_pixels(pixels: DataFrame, fits: DataFrame,
                     min_significance: float = POWER_LAW_MIN_SIGNIFICANCE) -> DataFrame:
    """Clipped pixels above the final fit, with their significance."""
    joined = pixels.join(fits, "SPECID")
    model = power_law(F.col("wave"))
    significance = F.when(F.col("failed"), 0.0).otherwise(
        F.abs(F.col("flux") - model) * F.sqrt("ivar"))
    return (joined.where(~_kept(_POWER_LAW, min_significance) & (F.col("flux") > model))
            .select("SPECID", "pix", significance.alias("significance")))


def compress_runs(peaks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each run of consecutive pixels becomes one peak.

    Its position is the significance-weighted mean pixel rounded half to even, its
    significance the sum.  Runs are found inside chunks; only runs that touch a
    chunk edge, at most two per chunk, are then joined across chunks.
    """
    chunked = peaks.withColumn("chunk", F.expr(f"pix div {chunk}"))
    within = Window.partitionBy("SPECID", "chunk").orderBy("pix")
    runs = (chunked.withColumn("run", F.col("pix") - F.row_number().over(within))
            .groupBy("SPECID", "chunk", "run")
            .agg(F.min("pix").alias("first"), F.max("pix").alias("last"),
                 F.sum("significance").alias("weight"),
                 F.sum(F.col("pix") * F.col("significance")).alias("moment")))
    edge = (F.expr(f"first % {chunk} = 0") | F.expr(f"last % {chunk} = {chunk - 1}"))
    across = Window.partitionBy("SPECID").orderBy("first")
    opens = F.when(F.col("first") == F.lag("last").over(across) + 1, 0).otherwise(1)
    joined = (runs.where(edge).withColumn("opens", opens)
              .withColumn("run", F.sum("opens").over(
                  across.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("SPECID", "run")
              .agg(F.min("first").alias("first"), F.max("last").alias("last"),
                   F.sum("weight").alias("weight"), F.sum("moment").alias("moment")))
    columns = ["SPECID", "first", "last", "weight", "moment"]
    every = runs.where(~edge).select(columns).unionByName(joined.select(columns))
    center = F.when(F.col("first") == F.col("last"), F.col("first")).otherwise(
        F.bround(ratio(F.col("moment"), F.col("weight"))).cast("bigint"))
    return (every.select("SPECID", center.alias("pix"), F.col("weight").alias("significance"))
            .where("pix IS NOT NULL"))


def with_wave(peaks: DataFrame, pixels: DataFrame) -> DataFrame:
    """Wavelength of each peak position."""
    return peaks.join(pixels.select("SPECID", "pix", "wave"), ["SPECID", "pix"]).select(
        "SPECID", "pix", "wave", "significance")


def find_power_law_peaks(pixels: DataFrame,
                         min_significance: float = POWER_LAW_MIN_SIGNIFICANCE,
                         chunk: int = CHUNK) -> DataFrame:
    fits = fit_power_law(pixels, min_significance, chunk)
    peaks = compress_runs(power_law_pixels(pixels, fits, min_significance), chunk)
    return with_wave(peaks, pixels)


# --- broken power law -------------------------------------------------------


def broken_power_law(wave: Column) -> Column:
    scaled = wave / F.col("break_wave")
    return F.col("amplitude") * F.when(
        wave < F.col("break_wave"), F.pow(scaled, -F.col("blue_index"))
    ).otherwise(F.pow(scaled, -F.col("red_index")))


_BROKEN_POWER_LAW = ("f.amplitude * CASE WHEN wave < f.break_wave "
                     "THEN pow(wave / f.break_wave, -f.blue_index) "
                     "ELSE pow(wave / f.break_wave, -f.red_index) END")
_BROKEN_FIT = "amplitude: DOUBLE, blue_index: DOUBLE, red_index: DOUBLE, break_wave: DOUBLE"
_BROKEN_CLIP = f"ARRAY<STRUCT<{_BROKEN_FIT}>>"
# Pixels the broken power law starts from.
_STARTS = f"coalesce(ivar > 0 AND flux >= 0, false) AND {_finite('flux')} AND {_finite('ivar')}"
_FIT = ("amplitude", "blue_index", "red_index", "break_wave")
_SUMS = {"n": "1D", "sw": "w", "sx": "w * x", "sxx": "w * x * x", "sz": "w * z", "sxz": "w * x * z",
         "szz": "w * z * z"}


def _two_lines(points: DataFrame, chunk: int) -> DataFrame:
    """(SPECID, fit): the continuous pair of lines through (x, z) with the least misfit.

    Sums before a point run inside its chunk and are shifted by those of earlier
    chunks.  Every point is a split: it begins the right part.  The best pair of a
    split meets in the gap before the point, or at the point; both are closed forms.
    ``pix`` must number the pixels in order of wavelength.
    """
    points = points.selectExpr("SPECID", f"pix div {chunk} AS chunk", "pix", "x",
                               *[f"{sql} AS {name}" for name, sql in _SUMS.items()])
    chunks = points.groupBy("SPECID", "chunk").agg(
        *[F.sum(c).alias(f"c_{c}") for c in _SUMS], F.max("x").alias("c_x"))
    earlier = Window.partitionBy("SPECID").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("SPECID")
    shifts = chunks.select(
        "SPECID", "chunk", *[F.coalesce(F.sum(f"c_{c}").over(earlier), F.lit(0.0)).alias(f"b_{c}") for c in _SUMS],
        *[F.sum(f"c_{c}").over(whole).alias(f"t_{c}") for c in _SUMS], F.max("c_x").over(earlier).alias("b_x"))
    inside = Window.partitionBy("SPECID", "chunk").orderBy("pix")
    running = points.select(
        "SPECID", "chunk", "x", F.lag("x").over(inside).alias("p_x"),
        *[F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"i_{c}")
          for c in _SUMS])
    sides = running.join(shifts, ["SPECID", "chunk"]).select(
        "SPECID", "x", F.coalesce("p_x", "b_x").alias("p_x"), *[F.col(f"t_{c}") for c in _SUMS],
        *[(F.col(f"i_{c}") + F.col(f"b_{c}")).alias(f"l_{c}") for c in _SUMS])
    sides = bound(sides.where("l_n >= 2 AND t_n - l_n >= 2"), **{f"r_{c}": f"t_{c} - l_{c}" for c in _SUMS})
    each = {name + s: sql.replace("?", s) for s in "lr" for name, sql in (
        ("slope_", "try_divide(?_sw * ?_sxz - ?_sx * ?_sz, ?_sw * ?_sxx - ?_sx * ?_sx)"),
        ("p_", "?_sx - x * ?_sw"), ("pp_", "?_sxx - 2 * x * ?_sx + x * x * ?_sw"), ("pz_", "?_sxz - x * ?_sz"))}
    sides = bound(sides, **each)
    sides = bound(sides, **{f"level_{s}": f"try_divide({s}_sz - slope_{s} * {s}_sx, {s}_sw)" for s in "lr"},
                  level="""try_divide(
        t_sz - try_divide(p_l * pz_l, pp_l) - try_divide(p_r * pz_r, pp_r),
        t_sw - try_divide(p_l * p_l, pp_l) - try_divide(p_r * p_r, pp_r))""")
    sides = bound(sides, meet="try_divide(level_l - level_r, slope_r - slope_l)",
                  blue="try_divide(pz_l - level * p_l, pp_l)", red="try_divide(pz_r - level * p_r, pp_r)")
    sides = bound(sides, free="""CASE WHEN meet > p_x AND meet <= x THEN l_szz - level_l * l_sz - slope_l * l_sxz
        + r_szz - level_r * r_sz - slope_r * r_sxz END""",
                  held="t_szz - level * t_sz - blue * pz_l - red * pz_r")
    # all free meetings go before meetings at a point of the same misfit
    pair = "named_struct('misfit', {}, 'kind', {}, 'level', {}, 'blue', {}, 'red', {}, 'at', {})".format
    pairs = sides.selectExpr("SPECID", "x", "inline(array(" + pair(
        "free", 0, "level_l + slope_l * meet", "slope_l", "slope_r", "meet") + ", " + pair(
        "held", 1, "level", "blue", "red", "x") + "))")
    pairs = pairs.where(_finite("misfit"))
    return pairs.groupBy("SPECID").agg(F.min_by(
        F.struct(F.exp("level").alias("amplitude"), (-F.col("blue")).alias("blue_index"),
                 (-F.col("red")).alias("red_index"), F.exp(F.col("at") + LOG_ORIGIN).alias("break_wave")),
        F.struct("misfit", "kind", "x")).alias("fit"))


def _refit(kept: DataFrame, chunk: int) -> DataFrame:
    """(SPECID, fit): least squares in flux over the kept pixels from their column
    ``fit``, or from a fit in the logarithm of the flux where that is NULL."""
    x = f"ln(wave) - {LOG_ORIGIN}D AS x"
    fits = written(kept.groupBy("SPECID").agg(F.any_value("fit").alias("fit")), "broken-starts")
    bare = kept.where("fit IS NULL AND flux > 0").selectExpr(
        "SPECID", "pix", x, "ln(flux) AS z", "ivar * flux * flux AS w")
    if not fits.where("fit IS NULL").isEmpty():
        begun = _two_lines(bare, chunk)
        fits = written(fits.where("fit IS NOT NULL").union(begun), "broken-starts")
    pixels = kept.drop("fit")
    model = _BROKEN_POWER_LAW.replace("f.", "fit.")
    for _ in range(FLUX_STEPS):
        modelled = pixels.join(fits, "SPECID").selectExpr("*", f"{model} AS model")
        tried = written(_two_lines(modelled.selectExpr(
            "SPECID", "pix", x, "ln(model) + (flux - model) / model AS z", "ivar * model * model AS w"), chunk),
            "broken-steps")
        both = modelled.join(tried.withColumnRenamed("fit", "next"), "SPECID")
        ahead = _BROKEN_POWER_LAW.replace("f.", "next.")
        gains = both.groupBy("SPECID").agg(
            F.sum(F.expr("ivar * pow(flux - model, 2)")).alias("now"),
            F.sum(F.expr(f"ivar * pow(flux - {ahead}, 2)")).alias("then"), F.any_value("next").alias("next"))
        fits = written(fits.join(gains.where("then < now").select("SPECID", "next"), "SPECID", "left").select(
            "SPECID", F.coalesce("next", "fit").alias("fit")), "broken-fits")
    return fits


def fit_broken_power_law(pixels: DataFrame, min_significance: float = POWER_LAW_MIN_SIGNIFICANCE,
                         chunk: int = CHUNK, once: bool = False) -> DataFrame:
    """Clip and refit while chi squared over the kept pixels keeps falling.

    Returns (SPECID, amplitude, blue_index, red_index, break_wave, clips).  The break
    lies anywhere between two pixels of the spectrum, found exactly; ``once`` gives the
    first fit, of all pixels.
    """
    return _by_length(
        pixels, lambda *arrays: broken_power_law_of(*arrays, min_significance, LOG_ORIGIN, FLUX_STEPS, once),
        f"{', '.join(f'{c} DOUBLE' for c in _FIT)}, clips {_BROKEN_CLIP}",
        lambda long: _broken_rounds(long, min_significance, chunk, once), chunk)


def _broken_rounds(pixels: DataFrame, min_significance: float, chunk: int, once: bool) -> DataFrame:
    def kept_by(state: DataFrame) -> DataFrame:
        return pixels.join(state.select("SPECID", "clips"), "SPECID").where(_STARTS).where(
            _kept(_BROKEN_POWER_LAW, min_significance))

    first = pixels.where(_STARTS).withColumn("fit", F.lit(None).cast(f"struct<{_BROKEN_FIT}>"))
    state = written(_refit(first, chunk).select(
        "SPECID", F.array("fit").alias("clips"), F.lit(None).cast("double").alias("best_chi2")), "broken-state")
    done = [state.select("SPECID", "clips")] if once else []
    while not once:
        newest = _BROKEN_POWER_LAW.replace("f.", "last.")
        kept = kept_by(state).withColumn("last", F.expr("try_element_at(clips, -1)"))
        chi2 = kept.groupBy("SPECID").agg(F.sum(F.expr(f"pow(flux - {newest}, 2) * ivar")).alias("new_chi2"))
        # chi2 of the newest fit is known only now; it must beat the one before
        near = F.abs(F.col("new_chi2") - F.col("best_chi2")) <= 1e-8 + 1e-5 * F.abs("best_chi2")
        better = F.col("best_chi2").isNull() | F.coalesce(
            ~near & (F.col("new_chi2") < F.col("best_chi2")), F.lit(False))
        judged = state.join(chi2, "SPECID", "left").select(
            "SPECID", F.when(better, F.col("clips")).otherwise(F.slice("clips", F.lit(1), F.size("clips") - 1)).alias("clips"),
            F.when(better, F.coalesce("new_chi2", F.lit(0.0))).otherwise(F.col("best_chi2")).alias("best_chi2"),
            (~better | F.col("new_chi2").isNull()).alias("settled"))
        settled, state, left = written_round(judged, "broken-power-law-round", "settled")
        done.append(settled.select("SPECID", "clips"))
        if not left:
            break
        again = _refit(kept_by(state).withColumn("fit", F.expr("try_element_at(clips, -1)")).drop("clips"), chunk)
        state = written(state.join(again, "SPECID").select(
            "SPECID", F.array_append("clips", F.col("fit")).alias("clips"), "best_chi2"), "broken-state")
    fits = reduce(DataFrame.unionByName, done)
    last = F.element_at("clips", F.lit(-1))
    return fits.where(F.size("clips") > 0).select(
        "SPECID", *[last[c].alias(c) for c in _FIT], "clips")


def broken_power_law_pixels(pixels: DataFrame, fits: DataFrame,
                            min_significance: float = POWER_LAW_MIN_SIGNIFICANCE) -> DataFrame:
    """Clipped pixels above the final fit; |difference| * sqrt(ivar)."""
    joined = pixels.join(fits, "SPECID")
    model = broken_power_law(F.col("wave"))
    kept = F.expr(_STARTS) & _kept(_BROKEN_POWER_LAW, min_significance)
    return (joined.where(~kept & (F.col("flux") > model))
            .select("SPECID", "pix",
                    (F.abs(F.col("flux") - model) * F.sqrt("ivar")).alias("significance")))


def find_broken_power_law_peaks(pixels: DataFrame,
                                min_significance: float = POWER_LAW_MIN_SIGNIFICANCE,
                                chunk: int = CHUNK) -> DataFrame:
    """Peaks above the broken power law; where no break has two pixels on both sides,
    above the plain one, so that no spectrum is left out."""
    fits = fit_broken_power_law(pixels, min_significance, chunk)
    above = broken_power_law_pixels(pixels, fits, min_significance)
    bare = pixels.join(fits.select("SPECID"), "SPECID", "left_anti")
    if not bare.isEmpty():
        plain = power_law_pixels(bare, fit_power_law(bare, min_significance, chunk), min_significance)
        above = above.unionByName(plain.select(above.columns))
    return with_wave(compress_runs(above, chunk), pixels)
