"""Per-pixel preprocessing: masks, noise, rebinning, selection, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.columns import any_of
from lumenpeak.functions.constants import (BOSS_TARGET1_BITS, EBOSS_TARGET0_BITS, REBIN_CENTER,
                                           SKY_MARGIN, TRAY_FILTERS, TRAY_MAX_WAVE, TRAY_WAVES)
from lumenpeak.operators.halo import CHUNK, positions

SKY_LINES, SKY_SALT = 200_000, 32


def to_pixels(spectra: DataFrame, *keep: str) -> DataFrame:
    """Array form -> one row per pixel, with its position.

    Rows of a long spectrum carry the position of their first pixel in ``start``.
    """
    start = F.col("start") if "start" in spectra.columns else F.lit(0)
    zipped = F.arrays_zip("wave", "flux", "ivar")
    return (spectra.select("SPECID", *keep, start.cast("bigint").alias("start"),
                           F.posexplode(zipped).alias("pix", "__p"))
            .select("SPECID", *keep, (F.col("start") + F.col("pix")).alias("pix"),
                    F.col("__p.wave").cast("double").alias("wave"),
                    F.col("__p.flux").cast("double").alias("flux"),
                    F.col("__p.ivar").cast("double").alias("ivar")))


def log_wave(column: str = "loglam") -> Column:
    """Wavelength from its decimal logarithm."""
    return F.pow(F.lit(10.0), F.col(column))


def mask_sky(pixels: DataFrame, sky: DataFrame, margin: float = SKY_MARGIN) -> DataFrame:
    """ivar = 0 where |log10(wave / sky wave)| <= margin for any sky wavelength.

    Sky wavelengths are spread over the log bins they reach and gathered per bin,
    so each pixel meets one small list found by an equi join.  All spectra share the bins:
    up to SKY_LINES wavelengths, each in at most two bins, are broadcast, so pixels stay
    where they are; with more, a bin's pixels are dealt over SKY_SALT tasks.
    """
    width = max(10 * margin, 1e-4)
    lines = sky.select("wave").distinct()
    spread = lines.withColumn("__bin", F.explode(F.sequence(
        F.floor((F.log10("wave") - 2 * margin) / width),
        F.floor((F.log10("wave") + 2 * margin) / width))))
    per_bin = spread.groupBy("__bin").agg(F.collect_set("wave").alias("__sky"))
    binned = pixels.withColumn("__bin", F.floor(F.log10("wave") / width))
    hit = F.coalesce(F.exists("__sky", lambda line: F.abs(
        F.log10(F.col("wave") / line)) <= margin), F.lit(False))
    if lines.limit(SKY_LINES + 1).count() <= SKY_LINES:
        met = binned.join(F.broadcast(per_bin), "__bin", "left")
    else:
        salted = per_bin.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SKY_SALT - 1))))
        met = binned.withColumn("__salt", F.pmod(F.xxhash64("SPECID", "wave"), F.lit(SKY_SALT)).cast("int")).join(
            salted, ["__bin", "__salt"], "left")
    return (met.withColumn("ivar", F.when(hit, 0.0).otherwise(F.col("ivar")))
            .drop("__bin", "__salt", "__sky"))


def mask_ranges(pixels: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """ivar = 0 inside any of the wavelength ranges, both ends included."""
    hit = any_of([F.col("wave").between(float(lo), float(hi)) for lo, hi in ranges])
    return pixels.withColumn("ivar", F.when(hit, 0.0).otherwise(F.col("ivar")))


def forbidden_ranges(bounds: Sequence[float]) -> list[tuple[float, float]]:
    """Flat list lo, hi, lo, hi, ... -> pairs."""
    if len(bounds) % 2:
        raise ValueError("forbidden wavelengths need an even number of values")
    return list(zip(bounds[::2], bounds[1::2]))


def add_noise(pixels: DataFrame, amount: float, seed: int = 0) -> DataFrame:
    """Worsen the data: ivar / amount, flux + (amount-1) * sigma * N(0,1).

    Pixels with zero ivar get no noise.  The draw is a function of (SPECID, pix,
    seed), so a recomputed task repeats it.
    """
    if amount <= 1:
        return pixels
    mantissa = 2.0**52

    def uniform(tag: int) -> Column:
        bits = F.xxhash64("SPECID", "pix", F.lit(seed), F.lit(tag)).bitwiseAND((1 << 52) - 1)
        return (bits.cast("double") + 0.5) / mantissa

    normal = F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(F.lit(6.283185307179586) * uniform(2))
    sigma = F.coalesce(F.try_divide(F.lit(1.0), F.sqrt("ivar")), F.lit(0.0))
    return (pixels.withColumn("flux", F.col("flux") + (amount - 1.0) * sigma * normal)
            .withColumn("ivar", F.col("ivar") / float(amount)))


def rebin(pixels: DataFrame, width: float, extend: float = 0.0) -> DataFrame:
    """Average flux and summed ivar on centres 4000 +- k*width, 0/0 where empty.

    A pixel belongs to every bin with centre - w/2 - extend <= wave < centre + w/2
    + extend.  Filled bins meet one row per CHUNK bins of a spectrum's grid, and each bin
    adds the empty ones up to the next; so empty bins need no join, no shuffle and no place
    in an aggregation, and no task makes the grid of all spectra.
    """
    half, w = width / 2.0, float(width)
    wave = F.col("wave")
    low = F.floor((wave - REBIN_CENTER - half - extend) / w)
    high = F.floor((wave - REBIN_CENTER + half + extend) / w) + 1
    center = F.lit(REBIN_CENTER) + F.col("k") * F.lit(w)

    def chunk_of(k: Column) -> Column:
        return F.floor(k / F.lit(CHUNK))

    members = (pixels.withColumn("k", F.explode(F.sequence(low, high)))
               .where((wave >= center - half - extend) & (wave < center + half + extend))
               .groupBy("SPECID", "k").agg(F.avg("flux").alias("flux"), F.sum("ivar").alias("ivar"))
               .select("SPECID", chunk_of(F.col("k")).alias("chunk"), "k", "flux", "ivar",
                       F.lit(None).cast("bigint").alias("end")))
    span = pixels.groupBy("SPECID").agg(F.min("wave").alias("lo"), F.max("wave").alias("hi")).select(
        "SPECID", F.least(F.floor((F.col("lo") - w - REBIN_CENTER) / w) + 1, F.lit(0)).alias("first"),
        F.greatest(F.ceil((F.col("hi") + w - REBIN_CENTER) / w) - 1, F.lit(0)).alias("last"))
    missing = F.lit(None).cast("double")
    grid = span.withColumn("chunk", F.explode(F.sequence(chunk_of(F.col("first")), chunk_of(F.col("last"))))).select(
        "SPECID", "chunk", F.greatest(F.col("first"), F.col("chunk") * CHUNK).alias("k"),
        missing.alias("flux"), missing.alias("ivar"),
        F.least(F.col("last"), F.col("chunk") * CHUNK + (CHUNK - 1)).alias("end"))
    along = Window.partitionBy("SPECID", "chunk").orderBy("k", F.col("end").asc_nulls_first())
    # bins before the grid's first one see no end; a filled first bin comes before its grid row
    shifted = F.lag(F.struct("k", "flux", "ivar")).over(along)
    filled = members.unionByName(grid).withColumns({
        "until": F.max("end").over(along), "next": F.lead("k").over(along), "before": shifted})
    same = F.col("end").isNotNull() & (F.col("before.k") == F.col("k"))
    filled = filled.select("SPECID", "k", "until", "next", *[
        F.when(same, F.col(f"before.{c}")).otherwise(F.col(c)).alias(c) for c in ("flux", "ivar")]).where(
        "k <= until").withColumn("at", F.explode(F.sequence("k", F.coalesce(
            F.least(F.col("next") - 1, F.col("until")), F.col("until")))))
    own = F.col("at") == F.col("k")
    return filled.select("SPECID", F.col("at").alias("k"), F.when(own, F.col("flux")).alias("flux"),
                         F.when(own, F.col("ivar")).alias("ivar")).select(
        "SPECID", "k", center.alias("wave"),
        F.coalesce("flux", F.lit(0.0)).alias("flux"), F.coalesce("ivar", F.lit(0.0)).alias("ivar"))


def drop_tray_filters(pixels: DataFrame, layout: str = "standard") -> DataFrame:
    """Drop the pixels of the filter trays that are not observed."""
    return pixels.where(~F.col("wave").isin(*TRAY_WAVES[layout])
                        & (F.col("wave") < TRAY_MAX_WAVE))


def drop_empty(pixels: DataFrame) -> DataFrame:
    """Drop spectra whose flux is one constant."""
    varied = (pixels.groupBy("SPECID").agg(F.min("flux").alias("lo"), F.max("flux").alias("hi"))
              .where("lo < hi").select("SPECID"))
    return pixels.join(varied, "SPECID", "left_semi")


def keep_active_fibres(targets: DataFrame, status: str = "fib_status") -> DataFrame:
    return targets.where(F.upper(status) == "A")


def keep_confident(catalogue: DataFrame) -> DataFrame:
    """Confident visual inspection and at least one quasar target bit."""
    boss, eboss = (sum(1 << b for b in bits) for bits in (BOSS_TARGET1_BITS, EBOSS_TARGET0_BITS))
    targeted = ((F.col("BOSS_TARGET1").cast("bigint").bitwiseAND(F.lit(boss)) > 0)
                | (F.col("EBOSS_TARGET0").cast("bigint").bitwiseAND(F.lit(eboss)) > 0))
    return catalogue.where((F.col("Z_CONF_PERSON") == 3) & targeted)


def photometric_ivar(objects: DataFrame) -> DataFrame:
    """FLUX, RELERR and flag arrays -> (SPECID, idx, flux, ivar).

    ivar = 1 / (flux*relerr)^2, zero where a flag is raised; SPECID joins the tile
    and object numbers as text.
    """
    zipped = F.arrays_zip("FLUX", "RELERR", "FLAGS", "MASK_FLAGS")
    error = F.col("__p.FLUX").cast("double") * F.col("__p.RELERR").cast("double")
    flagged = (F.col("__p.FLAGS") > 0) | (F.col("__p.MASK_FLAGS") > 0)
    rest = [c for c in objects.columns
            if c not in ("FLUX", "RELERR", "FLAGS", "MASK_FLAGS", "TILE_ID", "NUMBER")]
    return (objects.withColumn("SPECID", F.concat(F.col("TILE_ID").cast("string"),
                                                  F.col("NUMBER").cast("string")).cast("bigint"))
            .select("SPECID", *rest, F.posexplode(zipped).alias("idx", "__p"))
            .select("SPECID", *rest, "idx", F.col("__p.FLUX").cast("double").alias("flux"),
                    F.when(flagged, 0.0).otherwise(
                        F.try_divide(F.lit(1.0), error * error)).alias("ivar")))


def select_filters(filters: DataFrame, trays_only: bool = False) -> DataFrame:
    """(idx, name, wave) of the filters used: named J..., or the two-tray set."""
    chosen = (F.col("idx").isin(*TRAY_FILTERS) if trays_only
              else F.col("name").startswith("J"))
    return filters.where(chosen).select("idx", "name", "wave")


def photometric_pixels(objects: DataFrame, filters: DataFrame) -> DataFrame:
    """Photometric objects as pixels, numbered along the chosen filters."""
    numbered = positions(filters.select("idx", "wave").withColumn("set", F.lit(0)), ["set"],
                         ["idx"], F.expr(f"idx div {CHUNK}")).drop("set")
    return photometric_ivar(objects).join(numbered, "idx").drop("idx")


def attach_first_match(left: DataFrame, right: DataFrame, on: str, order: Sequence[str],
                       columns: Sequence[str]) -> DataFrame:
    """Left join to the first right row per key; NULL where there is none."""
    return left.join(first_per_key(right, [on], order).select(on, *columns), on, "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key.  Spark keeps one row per key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def catalogue_spectra(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue rows with their spectrum, matched on plate, date and fibre."""
    return catalogue.drop("LOADED").join(files, ["PLATE", "MJD", "FIBERID"])


def missing_inputs(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue entries whose spectrum is not there."""
    return catalogue.join(files, ["PLATE", "MJD", "FIBERID"], "left_anti")


def separation(ra: Column, dec: Column, ra0: float, dec0: float) -> Column:
    """Angular distance in degrees (haversine)."""
    dra, ddec = F.radians(ra - F.lit(ra0)) / 2.0, F.radians(dec - F.lit(dec0)) / 2.0
    h = F.pow(F.sin(ddec), 2.0) + F.cos(F.radians(dec)) * F.cos(
        F.radians(F.lit(dec0))) * F.pow(F.sin(dra), 2.0)
    return F.degrees(2.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def select_targets(targets: DataFrame, ids: Sequence | None = None,
                   surveys: Sequence[str] | None = None, classes: Sequence[str] | None = None,
                   exclude_ids: Sequence | None = None,
                   area: tuple[float, float, float] | None = None,
                   exclude_areas: Sequence[tuple[float, float, float]] = ()) -> DataFrame:
    """Keep / drop targets by id, survey, class and (RA, DEC, radius) cones."""
    if ids is not None:
        targets = targets.where(F.col("APS_ID").isin(*ids))
    if surveys is not None:
        targets = targets.where(F.col("TARGSRVY").isin(*surveys))
    if classes is not None:
        targets = targets.where(F.col("TARGCLASS").isin(*classes))
    if exclude_ids:
        targets = targets.where(~F.col("APS_ID").isin(*exclude_ids))

    def inside(cone) -> Column:
        return separation(F.col("RA"), F.col("DEC"), cone[0], cone[1]) <= cone[2]

    if area is not None:
        targets = targets.where(inside(area))
    for cone in exclude_areas:
        targets = targets.where(~inside(cone))
    return targets


def select_wave_ranges(pixels: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Keep each arm's pixels inside its wavelength range; other arms are untouched."""
    keep = ~F.col("arm").isin(*ranges)
    for arm, (lo, hi) in ranges.items():
        keep = keep | ((F.col("arm") == arm) & F.col("wave").between(float(lo), float(hi)))
    return pixels.where(keep)


def metadata(df: DataFrame, names: Sequence[str], key: str = "SPECID") -> DataFrame:
    """Named metadata columns, upper-cased; NULL where the input lacks one."""
    have = {c.upper(): c for c in df.columns}
    return df.select(F.col(have[key]).alias(key), *[
        (F.col(have[n.upper()]) if n.upper() in have else F.lit(None).cast("double"))
        .alias(n.upper()) for n in names])


def with_wave_axis(pixels: DataFrame, start: str = "crval", step: str = "cd") -> DataFrame:
    """wave = start + pix * step."""
    return pixels.withColumn("wave", F.col(start) + F.col("pix") * F.col(step))


def wave_axis(headers: DataFrame, *keys: str) -> DataFrame:
    """(keys, crval, cd, n) -> one row per pixel of the axis."""
    axis = headers.select(*keys, "crval", "cd", F.explode(
        F.sequence(F.lit(0), F.col("n") - 1)).alias("pix"))
    return with_wave_axis(axis).select(*keys, F.col("pix").cast("bigint").alias("pix"), "wave")
