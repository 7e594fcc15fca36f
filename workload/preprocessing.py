"""Preprocessing queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpeak.operators import cones as C
from lumenpeak.operators import exposures as X
from lumenpeak.operators import pixels as P
from workload.views import (PIXELS, num, pixels, query, rounded, rounded_sql, table, with_ctes)

PER_SPECTRUM_SQL = """SELECT SPECID, count(*) AS n, sum(wave) AS wave, sum(flux) AS flux,
  sum(ivar) AS ivar FROM {0} GROUP BY SPECID"""


def per_spectrum(df, *by):
    return rounded(df.groupBy("SPECID", *by).agg(
        F.count("*").alias("n"), F.sum("wave").alias("wave"), F.sum("flux").alias("flux"),
        F.sum("ivar").alias("ivar")))


def per_spectrum_sql(ctes, source):
    return rounded_sql(ctes + PER_SPECTRUM_SQL.format(source), "wave", "flux", "ivar")


def sky(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select((3650.0 + 240.0 * k + k % 3).alias("wave"))


@query("c1_sky_mask", rounded_sql(with_ctes(PIXELS, """sky AS (
  SELECT 3650.0e0 + 240.0e0 * n_nationkey + n_nationkey % 3 AS sw FROM nation)""") + """
SELECT SPECID, pix, wave, flux, CASE WHEN EXISTS (
    SELECT 1 FROM sky WHERE abs(log10(wave / sw)) <= 1.5e-4) THEN 0.0e0 ELSE ivar END AS ivar
FROM pixels""", "ivar"))
def c1(spark, sf):
    return rounded(P.mask_sky(pixels(spark, sf), sky(spark, sf)).select(
        "SPECID", "pix", "wave", "flux", "ivar"), "ivar")


@query("c2_forbidden_ranges", per_spectrum_sql(with_ctes(PIXELS, """m AS (
  SELECT SPECID, wave, flux, CASE WHEN wave BETWEEN 4000 AND 4200 OR wave BETWEEN 7005 AND 7300
    THEN 0.0e0 ELSE ivar END AS ivar FROM pixels)"""), "m"))
def c2(spark, sf):
    ranges = P.forbidden_ranges([4000.0, 4200.0, 7005.0, 7300.0])
    return per_spectrum(P.mask_ranges(pixels(spark, sf), ranges))


@query("c3_added_noise", rounded_sql(with_ctes(PIXELS) + """
SELECT SPECID, count(*) AS n, sum(ivar) / 3.0e0 AS ivar, true AS centred, true AS scaled
FROM pixels GROUP BY SPECID""", "ivar"))
def c3(spark, sf):
    """The drawn noise, in units of its width, has mean near 0 and deviation near 1."""
    original = pixels(spark, sf).withColumn("clean", F.col("flux")).withColumn(
        "sigma", 1.0 / F.sqrt("ivar"))
    noisy = P.add_noise(original, 3.0, seed=11)
    unit = (F.col("flux") - F.col("clean")) / (2.0 * F.col("sigma"))
    return rounded(noisy.groupBy("SPECID").agg(
        F.count("*").alias("n"), F.sum("ivar").alias("ivar"),
        (F.abs(F.avg(unit)) < 6.0 / F.sqrt(F.count("*"))).alias("centred"),
        (F.abs(F.stddev_samp(unit) - 1.0) < 6.0 / F.sqrt(F.count("*"))).alias("scaled")))


def rebin_sql(width: float, extend: float) -> str:
    w, h, e = num(width), num(width / 2), num(extend)
    return with_ctes(PIXELS, f"""grid AS (SELECT SPECID, unnest(range(
      least(floor((min(wave) - {w} - 4000) / {w})::BIGINT + 1, 0),
      greatest(ceil((max(wave) + {w} - 4000) / {w})::BIGINT - 1, 0) + 1)) AS k
  FROM pixels GROUP BY SPECID)""", f"""binned AS (
  SELECT g.SPECID, g.k, 4000.0e0 + g.k * {w} AS wave, coalesce(avg(flux), 0) AS flux,
         coalesce(sum(ivar), 0) AS ivar
  FROM grid g LEFT JOIN pixels p ON p.SPECID = g.SPECID
   AND p.wave >= 4000.0e0 + g.k * {w} - {h} - {e} AND p.wave < 4000.0e0 + g.k * {w} + {h} + {e}
  GROUP BY ALL)""")


@query("c4_rebinned", rounded_sql(rebin_sql(100.0, 30.0) + """
SELECT SPECID, k, wave, flux, ivar FROM binned""", "flux", "ivar"))
def c4(spark, sf):
    return rounded(P.rebin(pixels(spark, sf), 100.0, 30.0))


@query("c4_rebinned_fine", rounded_sql(rebin_sql(7.0, 0.0) + """
SELECT SPECID, k, wave, flux, ivar FROM binned""", "flux", "ivar"))
def c4_fine(spark, sf):
    """Bins narrower than the pixel step: some stay empty."""
    return rounded(P.rebin(pixels(spark, sf), 7.0))


def _tray_sql(waves: str) -> str:
    return per_spectrum_sql(rebin_sql(100.0, 0.0) + f", kept AS (SELECT * FROM binned WHERE "
                            f"wave NOT IN ({waves}) AND wave < 7300)\n", "kept")


@query("c5_tray_filters", _tray_sql("3900, 4000, 4300, 4400, 4700, 4800, 5100, 5200"))
def c5(spark, sf):
    return per_spectrum(P.drop_tray_filters(P.rebin(pixels(spark, sf), 100.0)))


@query("c5_tray_filters_alternative", _tray_sql("3800, 4000, 4200, 4400, 4600, 4800, 5000, 5200"))
def c5_alternative(spark, sf):
    return per_spectrum(P.drop_tray_filters(P.rebin(pixels(spark, sf), 100.0), "alternative"))


# --- exposures and bands ----------------------------------------------------

EXPOSURES = """exposures AS (
  SELECT SPECID, ['b', 'r', 'z'][pix % 3 + 1] AS band, (pix // 3) // 32 AS exposure,
         (pix // 3) % 32 AS pix, 4000.0e0 + 250.0e0 * (pix % 3) + 10.0e0 * ((pix // 3) % 32) AS wave,
         flux, ivar, (pix % 11 = 0 OR (pix // 3) % 32 = 5) AS mask FROM pixels)"""
MASKED = """masked AS (SELECT * REPLACE (CASE WHEN mask THEN 0.0e0 ELSE ivar END AS ivar)
  FROM exposures)"""
COMBINED = """combined AS (
  SELECT SPECID, band, pix, min(wave) AS wave,
         CASE WHEN sum(ivar) = 0 THEN 0.0e0 ELSE sum(flux * ivar) / sum(ivar) END AS flux,
         sum(ivar) AS ivar FROM masked GROUP BY SPECID, band, pix)"""


def exposures(spark, sf):
    pix = F.col("pix")
    place = F.expr("pix div 3 % 32")
    bands = F.array(*[F.lit(b) for b in "brz"])
    return pixels(spark, sf).select(
        "SPECID", F.element_at(bands, (pix % 3 + 1).cast("int")).alias("band"),
        F.expr("pix div 3 div 32").alias("exposure"), place.alias("pix"),
        (4000.0 + 250.0 * (pix % 3) + 10.0 * place).alias("wave"), "flux", "ivar",
        ((pix % 11 == 0) | (place == 5)).alias("mask"))


@query("c7_exposure_mask", rounded_sql(with_ctes(PIXELS, EXPOSURES, MASKED) + """
SELECT SPECID, band, exposure, pix, flux, ivar FROM masked""", "ivar"))
def c7(spark, sf):
    return rounded(X.mask_exposures(exposures(spark, sf)).select(
        "SPECID", "band", "exposure", "pix", "flux", "ivar"), "ivar")


@query("c8_combined_exposures", rounded_sql(with_ctes(PIXELS, EXPOSURES, MASKED, COMBINED) + """
SELECT * FROM combined""", "flux", "ivar"))
def c8(spark, sf):
    return rounded(X.combine_exposures(X.mask_exposures(exposures(spark, sf))))


@query("c9_first_exposure", rounded_sql(with_ctes(PIXELS, EXPOSURES, MASKED) + """
SELECT SPECID, band, pix, wave, flux, ivar FROM (SELECT *, row_number() OVER (
  PARTITION BY SPECID, band, pix ORDER BY exposure) AS r FROM masked) WHERE r = 1""", "ivar"))
def c9(spark, sf):
    return rounded(X.first_exposure(X.mask_exposures(exposures(spark, sf))), "ivar")


POINTS = 150


BAND_CTES = (
    PIXELS, EXPOSURES, MASKED, COMBINED,
    "span AS (SELECT SPECID, min(wave) AS lo, max(wave) AS hi FROM combined GROUP BY SPECID)",
    """near AS (SELECT *, lag(wave) OVER w AS b, lead(wave) OVER w AS a FROM combined
  WINDOW w AS (PARTITION BY SPECID, band ORDER BY pix))""",
    """edges AS (SELECT SPECID, flux, ivar, coalesce((b + wave) / 2, wave - (a - wave) / 2) AS l,
    coalesce((a + wave) / 2, wave + (wave - b) / 2) AS r FROM near)""",
    f"""grid AS (SELECT SPECID, k, lo + k * ((hi - lo) / {POINTS - 1}) AS wave,
    (hi - lo) / {POINTS - 1} AS step FROM span, range({POINTS}) t(k))""",
    """parts AS (SELECT g.SPECID, k, flux, ivar,
    greatest(0, least(r, wave + step / 2) - greatest(l, wave - step / 2)) / step AS f
  FROM grid g JOIN edges e ON g.SPECID = e.SPECID AND e.l < wave + step AND e.r > wave - step)""",
    """total AS (SELECT SPECID, k, sum(ivar * f) AS ivar, sum(flux * ivar * f) AS fi
  FROM parts GROUP BY ALL)""")
BANDS = """
SELECT g.SPECID, g.k AS pix, g.wave, CASE WHEN coalesce(ivar, 0) = 0 THEN 0.0e0
  ELSE fi / ivar END AS flux, coalesce(ivar, 0) AS ivar
FROM grid g LEFT JOIN total t ON g.SPECID = t.SPECID AND g.k = t.k"""


@query("c10_combined_bands", rounded_sql(with_ctes(*BAND_CTES) + BANDS, "wave", "flux", "ivar"))
def c10(spark, sf):
    combined = X.combine_exposures(X.mask_exposures(exposures(spark, sf)))
    return rounded(X.combine_bands(combined, POINTS))


# --- two-arm spectra --------------------------------------------------------

ARMS = """arms AS (
  SELECT SPECID, arm, pix, wave, 1.0e0 + (pix % 5) * 0.1e0 AS sens,
         CASE WHEN dead THEN 0.0e0 ELSE flux END AS flux,
         CASE WHEN dead THEN 0.0e0 ELSE ivar END AS ivar
  FROM (SELECT *, (arm = 'blue' AND (pix < 3 OR pix BETWEEN 100 AND 105))
               OR (arm = 'red' AND (pix < 302 OR pix BETWEEN 400 AND 408 OR pix >= 520)) AS dead
        FROM (SELECT *, 'blue' AS arm FROM pixels WHERE pix < 330 UNION ALL
              SELECT *, 'red' AS arm FROM pixels WHERE pix >= 300)))"""
CORRECTED = """corrected AS (SELECT * REPLACE (flux * sens AS flux, ivar * sens AS ivar)
  FROM arms)"""
TRIMMED = """ends AS (SELECT SPECID, arm, max(wave) FILTER (up = 2) AS lo,
    max(wave) FILTER (down = 2) AS hi
  FROM (SELECT *, row_number() OVER (PARTITION BY SPECID, arm ORDER BY wave) AS up,
          row_number() OVER (PARTITION BY SPECID, arm ORDER BY wave DESC) AS down
        FROM corrected WHERE flux <> 0 AND ivar <> 0) GROUP BY SPECID, arm),
trimmed AS (SELECT c.* FROM corrected c JOIN ends USING (SPECID, arm)
  WHERE wave BETWEEN lo AND hi)"""
GAPS = """gaps AS (SELECT SPECID, arm, min(pix) - 4 AS start_pix, max(pix) + 4 AS end_pix
  FROM trimmed WHERE flux = 0 AND ivar = 0 GROUP BY SPECID, arm)"""
FILLED = """filled AS (SELECT t.* REPLACE (CASE WHEN t.wave > a.wave AND t.wave < b.wave
    THEN (a.flux - b.flux) / (a.wave - b.wave) * (t.wave - a.wave) + a.flux
    ELSE t.flux END AS flux)
  FROM trimmed t LEFT JOIN gaps g USING (SPECID, arm)
  LEFT JOIN trimmed a ON a.SPECID = g.SPECID AND a.arm = g.arm AND a.pix = g.start_pix
  LEFT JOIN trimmed b ON b.SPECID = g.SPECID AND b.arm = g.arm AND b.pix = g.end_pix)"""
ARM_CTES = (PIXELS, ARMS, CORRECTED, TRIMMED, GAPS, FILLED)


def arms(spark, sf):
    both = pixels(spark, sf).withColumn("arm", F.explode(F.array_compact(F.array(
        F.when(F.col("pix") < 330, "blue"), F.when(F.col("pix") >= 300, "red")))))
    dead = F.expr("(arm = 'blue' AND (pix < 3 OR pix BETWEEN 100 AND 105)) OR (arm = 'red' AND "
                  "(pix < 302 OR pix BETWEEN 400 AND 408 OR pix >= 520))")
    return both.withColumns({
        "sens": 1.0 + (F.col("pix") % 5) * 0.1,
        "flux": F.when(dead, 0.0).otherwise(F.col("flux")),
        "ivar": F.when(dead, 0.0).otherwise(F.col("ivar"))})


def trimmed(spark, sf):
    return X.trim_edges(X.correct_sensitivity(arms(spark, sf)))


@query("c11_sensitivity", per_spectrum_sql(with_ctes(*ARM_CTES[:3]), "corrected"))
def c11(spark, sf):
    return per_spectrum(X.correct_sensitivity(arms(spark, sf)))


@query("c12_trimmed_edges", per_spectrum_sql(with_ctes(*ARM_CTES[:4]), "trimmed"))
def c12(spark, sf):
    return per_spectrum(trimmed(spark, sf))


@query("c13_gaps", with_ctes(*ARM_CTES[:5]) + "SELECT * FROM gaps")
def c13(spark, sf):
    return X.find_gaps(trimmed(spark, sf))


@query("c14_filled_gaps", rounded_sql(with_ctes(*ARM_CTES) + """
SELECT SPECID, arm, pix, flux FROM filled""", "flux"))
def c14(spark, sf):
    source = trimmed(spark, sf)
    return rounded(X.fill_gaps(source, X.find_gaps(source)).select(
        "SPECID", "arm", "pix", "flux"))


@query("c15_combined_arms", rounded_sql(with_ctes(*ARM_CTES) + """
SELECT SPECID, row_number() OVER (PARTITION BY SPECID ORDER BY wave) - 1 AS pix, wave, flux, ivar
FROM (SELECT SPECID, wave, avg(flux) AS flux, avg(ivar) AS ivar FROM filled
      GROUP BY SPECID, wave)""", "flux", "ivar"))
def c15(spark, sf):
    return rounded(X.arm_spectra(arms(spark, sf)).select(
        "SPECID", "pix", "wave", "flux", "ivar"))


@query("c16_empty_spectra", with_ctes(PIXELS) + """
SELECT SPECID, count(*) AS n FROM (SELECT SPECID,
  CASE WHEN SPECID % 5 = 0 THEN 1.0e0 ELSE flux END AS flux FROM pixels)
GROUP BY SPECID HAVING count(DISTINCT flux) > 1""")
def c16(spark, sf):
    flat = pixels(spark, sf).withColumn(
        "flux", F.when(F.col("SPECID") % 5 == 0, 1.0).otherwise(F.col("flux")))
    return P.drop_empty(flat).groupBy("SPECID").agg(F.count("*").alias("n"))


# --- catalogue side ---------------------------------------------------------


@query("c17_fibre_status", """SELECT c_custkey AS APS_ID, lower(c_mktsegment[1]) AS fib_status
FROM customer WHERE upper(lower(c_mktsegment[1])) = 'A'""")
def c17(spark, sf):
    targets = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("APS_ID"),
        F.lower(F.substring("c_mktsegment", 1, 1)).alias("fib_status"))
    return P.keep_active_fibres(targets)


@query("c18_confident_targets", f"""WITH c AS (SELECT o_orderkey AS SPECID,
    CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 3 END AS Z_CONF_PERSON,
    CASE WHEN o_orderkey % 5 = 0 THEN {1 << 40} WHEN o_orderkey % 7 = 0 THEN {1 << 12}
      ELSE {1 << 5} END AS t1,
    CASE WHEN o_orderkey % 3 = 0 THEN {1 << 22} WHEN o_orderkey % 2 = 0 THEN {1 << 19}
      ELSE 0 END AS t0 FROM orders)
SELECT SPECID FROM c WHERE Z_CONF_PERSON = 3 AND (
  {' OR '.join(f't1 & {1 << b} > 0' for b in P.BOSS_TARGET1_BITS)} OR
  {' OR '.join(f't0 & {1 << b} > 0' for b in P.EBOSS_TARGET0_BITS)})""")
def c18(spark, sf):
    k = F.col("o_orderkey")
    catalogue = table(spark, sf, "orders").select(
        k.alias("SPECID"), F.when(k % 4 == 0, 2).otherwise(3).alias("Z_CONF_PERSON"),
        F.when(k % 5 == 0, F.lit(1 << 40)).when(k % 7 == 0, F.lit(1 << 12))
        .otherwise(F.lit(1 << 5)).alias("BOSS_TARGET1"),
        F.when(k % 3 == 0, F.lit(1 << 22)).when(k % 2 == 0, F.lit(1 << 19))
        .otherwise(F.lit(0)).alias("EBOSS_TARGET0"))
    return P.keep_confident(catalogue).select("SPECID")


def photometry(spark, sf):
    """Fluxes with relative errors and flags, one object per embedding."""
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("TILE_ID"), F.col("vec_id").alias("NUMBER"),
        values.alias("FLUX"),
        F.transform(values, lambda v, i: 0.05 + 0.01 * (i % 4)).alias("RELERR"),
        F.transform(values, lambda v, i: F.when(i % 9 == 0, 1).otherwise(0)).alias("FLAGS"),
        F.transform(values, lambda v, i: F.when(i % 13 == 5, 4).otherwise(0)).alias("MASK_FLAGS"))


PHOTOMETRY = """phot AS (
  SELECT (label::VARCHAR || vec_id::VARCHAR)::BIGINT AS SPECID, i AS idx,
    embedding[i + 1]::DOUBLE AS flux,
    CASE WHEN i % 9 = 0 OR i % 13 = 5 THEN 0.0e0 WHEN embedding[i + 1] = 0 THEN NULL
      ELSE 1.0e0 / ((embedding[i + 1]::DOUBLE * (0.05e0 + 0.01e0 * (i % 4)))
                    * (embedding[i + 1]::DOUBLE * (0.05e0 + 0.01e0 * (i % 4)))) END AS ivar
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"""


@query("c19_photometric_ivar", with_ctes(PHOTOMETRY) + """
SELECT SPECID, idx, (round(flux, 6) + 0.0)::DOUBLE AS flux,
  (round(ln(nullif(ivar, 0)), 6) + 0.0)::DOUBLE AS log_ivar FROM phot""")
def c19(spark, sf):
    return rounded(P.photometric_ivar(photometry(spark, sf)).select(
        "SPECID", F.col("idx").cast("bigint").alias("idx"), "flux",
        F.ln(F.nullif("ivar", F.lit(0.0))).alias("log_ivar")))


@query("c20_first_match", """SELECT c_custkey, c_name, o_totalprice AS GMAG, o_orderkey AS first_id
FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1) o
ON o_custkey = c_custkey""")
def c20(spark, sf):
    magnitudes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("GMAG"),
        F.col("o_orderkey").alias("first_id"))
    return P.attach_first_match(table(spark, sf, "customer").select("c_custkey", "c_name"),
                                magnitudes, "c_custkey", ["first_id"], ["GMAG", "first_id"])


@query("c21_first_row_per_target", """SELECT o_custkey AS TARGETID, o_orderkey, o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
WHERE r = 1""")
def c21(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("TARGETID"), "o_orderkey",
                                             "o_totalprice")
    return P.first_per_key(rows, ["TARGETID"], ["o_orderkey"])


def catalogue_and_files(spark, sf):
    def keys(c):
        return [(c % 100).alias("PLATE"), (c % 1000).alias("MJD"), c.alias("FIBERID")]

    catalogue = table(spark, sf, "orders").select(
        *keys(F.col("o_orderkey")), F.col("o_custkey").alias("SPECID"),
        F.lit(True).alias("LOADED"))
    files = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("flux")).select(*keys(F.col("l_orderkey")), "flux")
    return catalogue, files


FILES = """files AS (SELECT l_orderkey AS FIBERID, sum(l_quantity) AS flux FROM lineitem
  GROUP BY l_orderkey)"""


@query("c22_catalogue_spectra", with_ctes(FILES) + """
SELECT o_orderkey % 100 AS PLATE, o_orderkey % 1000 AS MJD, FIBERID, o_custkey AS SPECID, flux
FROM orders JOIN files ON FIBERID = o_orderkey""")
def c22(spark, sf):
    return P.catalogue_spectra(*catalogue_and_files(spark, sf))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "MACHINERY")


@query("c23_target_selection", """SELECT APS_ID FROM (
  SELECT c_custkey AS APS_ID, c_mktsegment AS s, (c_custkey * 37 % 3600) / 10.0e0 AS RA,
         (c_custkey * 13 % 1800) / 10.0e0 - 90.0e0 AS DEC,
         ['QSO', 'STAR', 'GALAXY'][c_custkey % 3 + 1] AS c FROM customer)
WHERE s IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND c IN ('QSO', 'GALAXY')
  AND APS_ID NOT IN (3, 5, 8)
  AND 2 * asin(sqrt(sin(radians(DEC - 10) / 2) ** 2 + cos(radians(DEC)) * cos(radians(10))
      * sin(radians(RA - 180) / 2) ** 2)) <= radians(75.05)
  AND NOT 2 * asin(sqrt(sin(radians(DEC + 5) / 2) ** 2 + cos(radians(DEC)) * cos(radians(-5))
      * sin(radians(RA - 170) / 2) ** 2)) <= radians(20.05)""")
def c23(spark, sf):
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(c) for c in ("QSO", "STAR", "GALAXY")])
    targets = table(spark, sf, "customer").select(
        k.alias("APS_ID"), F.col("c_mktsegment").alias("TARGSRVY"),
        ((k * 37 % 3600) / 10.0).alias("RA"), ((k * 13 % 1800) / 10.0 - 90.0).alias("DEC"),
        F.element_at(kinds, (k % 3 + 1).cast("int")).alias("TARGCLASS"))
    return P.select_targets(targets, surveys=SEGMENTS, classes=("QSO", "GALAXY"),
                            exclude_ids=(3, 5, 8), area=(180.0, 10.0, 75.05),
                            exclude_areas=[(170.0, -5.0, 20.05)]).select("APS_ID")


CONES_SQL = """WITH targets AS (
  SELECT c_custkey AS APS_ID, (c_custkey * 37 % 3600) / 10.0e0 AS RA,
         (c_custkey * 13 % 1800) / 10.0e0 - 90.0e0 AS DEC FROM customer),
cones AS (
  SELECT (s_suppkey * 71 % 3600) / 10.0e0 AS ra0, (s_suppkey * 29 % 1790) / 10.0e0 - 89.5e0 AS dec0,
         0.137e0 + (s_suppkey % 40) / 8.0e0 AS radius FROM supplier)
SELECT APS_ID FROM targets WHERE {0} EXISTS (SELECT 1 FROM cones
  WHERE abs(DEC - dec0) <= radius + 0.001 AND 2 * asin(sqrt(least(1.0, sin(radians(DEC - dec0) / 2) ** 2
    + cos(radians(DEC)) * cos(radians(dec0)) * sin(radians(RA - ra0) / 2) ** 2))) <= radians(radius))"""


def by_cones(spark, sf, inside):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    targets = table(spark, sf, "customer").select(
        k.alias("APS_ID"), ((k * 37 % 3600) / 10.0).alias("RA"), ((k * 13 % 1800) / 10.0 - 90.0).alias("DEC"))
    cones = table(spark, sf, "supplier").select(
        ((s * 71 % 3600) / 10.0).alias("RA"), ((s * 29 % 1790) / 10.0 - 89.5).alias("DEC"),
        (0.137 + (s % 40) / 8.0).alias("RADIUS"))
    return C.in_cones(targets, cones, inside).select("APS_ID")


@query("c23_targets_in_cones", CONES_SQL.format(""))
def c23_in_cones(spark, sf):
    return by_cones(spark, sf, True)


@query("c23_targets_outside_cones", CONES_SQL.format("NOT"))
def c23_outside_cones(spark, sf):
    return by_cones(spark, sf, False)


@query("c23_wave_ranges", per_spectrum_sql(with_ctes(*ARM_CTES[:2], """kept AS (
  SELECT * FROM arms WHERE (arm = 'blue' AND wave BETWEEN 3800 AND 6500)
     OR (arm = 'red' AND wave BETWEEN 6700 AND 9000))"""), "kept"))
def c23_ranges(spark, sf):
    return per_spectrum(P.select_wave_ranges(
        arms(spark, sf), {"blue": (3800.0, 6500.0), "red": (6700.0, 9000.0)}))


@query("c24_metadata", """SELECT c_custkey AS C_CUSTKEY, c_acctbal AS C_ACCTBAL, c_name AS C_NAME,
  NULL::DOUBLE AS NOT_THERE FROM customer""")
def c24(spark, sf):
    return P.metadata(table(spark, sf, "customer"), ["c_acctbal", "C_NAME", "not_there"],
                      "C_CUSTKEY")
