"""Queries of the formatting jobs: survey tables -> array-form spectra with metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpeak.operators import pixels as P
from lumenpeak.plans import jobs
from workload.preprocessing import (ARM_CTES, BAND_CTES, BANDS, POINTS, arms, exposures,
                                    per_spectrum, photometry)
from workload.tables import FILTERS, filters
from workload.views import TRUTH, query, rounded, rounded_sql, table, truth, with_ctes

MAGS = """mags AS (SELECT o_custkey AS SPECID, o_totalprice::DOUBLE AS GMAG, o_orderkey % 100 / 4.0e0 AS RMAG
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"""


def magnitudes(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("SPECID"), F.col("o_totalprice").cast("double").alias("GMAG"),
        (F.col("o_orderkey") % 100 / 4.0).alias("RMAG"), F.col("o_orderkey").alias("seen"))


@query("job_arm_spectra", rounded_sql(with_ctes(
    *ARM_CTES, TRUTH, MAGS,
    """keep AS (SELECT SPECID FROM corrected WHERE arm = 'red' AND SPECID % 7 <> 0 AND SPECID % 3 <> 0
  GROUP BY SPECID HAVING min(flux) < max(flux))""",
    """met AS (SELECT SPECID, wave, avg(flux) AS flux, avg(ivar) AS ivar FROM filled
  WHERE SPECID IN (SELECT SPECID FROM keep) GROUP BY SPECID, wave)""",
    """sums AS (SELECT SPECID, count(*) AS n, sum(wave) AS wave, sum(flux) AS flux, sum(ivar) AS ivar
  FROM met GROUP BY SPECID)""") + """
SELECT sums.*, Z_TRUE, GMAG, RMAG FROM sums LEFT JOIN mags USING (SPECID)
  LEFT JOIN (SELECT SPECID, Z_TRUE FROM truth WHERE SPECID % 2 = 0) USING (SPECID)""", "wave", "flux", "ivar"))
def arm_spectra(spark, sf):
    """Inactive fibres and spectra with a constant red arm are left out."""
    k = F.col("SPECID")
    pixels = arms(spark, sf).withColumn("flux", F.when(
        (k % 7 == 0) & (F.col("arm") == "red"), 0.0).otherwise(F.col("flux")))
    known = truth(spark, sf).where(k % 2 == 0).select("SPECID", F.col("Z_TRUE").alias("Z"), F.lit(0).alias("seen"))
    fibres = truth(spark, sf).select("SPECID", F.when(k % 3 == 0, "p").when(
        k % 2 == 0, "a").otherwise("A").alias("fib_status"))
    spectra = jobs.format_arms(pixels, known, magnitudes(spark, sf), fibres, ("seen",))
    names = ("Z_TRUE", "GMAG", "RMAG")
    return per_spectrum(P.to_pixels(spectra, *names), *names)


@query("job_exposure_spectra", rounded_sql(f"""
SELECT SPECID, count(*) AS n, sum(wave) AS wave, sum(flux) AS flux, sum(ivar) AS ivar, any_value(GMAG) AS GMAG
FROM ({with_ctes(*BAND_CTES) + BANDS}) LEFT JOIN (WITH {MAGS} SELECT SPECID, GMAG FROM mags) USING (SPECID)
GROUP BY SPECID""", "wave", "flux", "ivar"))
def exposure_spectra(spark, sf):
    fibres = magnitudes(spark, sf).withColumnRenamed("GMAG", "gmag")
    spectra = jobs.format_exposures(exposures(spark, sf), fibres, ["gmag"], False, ("seen",), POINTS)
    return per_spectrum(P.to_pixels(spectra, "GMAG"), "GMAG")


@query("job_photometric_spectra", rounded_sql(with_ctes(FILTERS) + """
SELECT (label::VARCHAR || vec_id::VARCHAR)::BIGINT AS SPECID, vec_id AS NUMBER, count(*) AS n, sum(wave) AS wave,
  sum(embedding[idx + 1]::DOUBLE) AS flux,
  count(*) FILTER (idx % 9 <> 0 AND idx % 13 <> 5 AND embedding[idx + 1] <> 0) AS measured
FROM embeddings JOIN filters ON idx < len(embedding) AND name LIKE 'J%' GROUP BY ALL""", "wave", "flux"))
def photometric_spectra(spark, sf):
    spectra = jobs.format_photometry(photometry(spark, sf), filters(spark, sf), ["NUMBER"])
    return rounded(P.to_pixels(spectra, "NUMBER").groupBy("SPECID", "NUMBER").agg(
        F.count("*").alias("n"), F.sum("wave").alias("wave"), F.sum("flux").alias("flux"),
        F.count_if(F.col("ivar") > 0).alias("measured")), "wave", "flux")
