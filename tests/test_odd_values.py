"""NaN cuts, infinite flux, text ids, repeated ids and spectra off the break grid."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenpeak.functions.columns import cut_index
from lumenpeak.operators import candidates as C
from lumenpeak.operators import peaks as P
from lumenpeak.operators.continuum import find_broken_power_law_peaks
from lumenpeak.operators.quantiles import medians
from lumenpeak.plans import jobs
from lumenpeak.plans.params import JobParams

NAN, INF = float("nan"), float("inf")


def test_nan_passes_no_cut(spark):
    df = spark.createDataFrame([(NAN,), (None,), (0.5,)], "v double")
    for n in (3, 18, 100):
        even = [1 - i / n for i in range(n)]
        for cuts in (even, [c * c for c in even]):
            for op in (">=", ">"):
                got = [r[0] for r in df.select(cut_index(F.col("v"), cuts, op)).collect()]
                assert got[:2] == [n, n] and got[2] == next(i for i, c in enumerate(cuts) if (0.5 >= c if op == ">=" else 0.5 > c))


def test_infinite_flux_is_missing_for_short_and_long_kernels(spark):
    flux = [1.0] * 200
    flux[100] = INF
    df = spark.createDataFrame([(1, i, 3600.0 + i, f, 1.0) for i, f in enumerate(flux)],
                               "SPECID long, pix long, wave double, flux double, ivar double")
    for width in (5.0, 5.2):
        near = {r.pix: r.smoothed for r in P.smooth(df, width).where("pix BETWEEN 60 AND 140").collect()}
        assert all(abs(v - 1) < 1e-9 for v in near.values())


def test_medians_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, INF, NAN, None, -1e308, 1e308)] + [("b", INF)], "k string, v double")
    assert medians(df, "k", "v") == {"a": 1.5}


def spectra(spark, ids):
    rng = np.random.default_rng(3)
    wave = np.arange(3600.0, 7600.0, 10.0)
    rows = []
    for plate, name in enumerate(ids):
        flux = 2 + rng.normal(0, 0.05, len(wave)) + 6 * np.exp(-0.5 * ((wave - 4500 - 900 * plate) / 60) ** 2)
        rows.append((name, plate, wave.tolist(), flux.tolist(), [400.0] * len(wave)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["SPECID", "PLATE", "wave", "flux", "ivar"]))


def test_repeated_and_text_ids(spark, tmp_path):
    params = JobParams(mode="candidates", peak_finder_options={"width": 4.0, "min_significance": 8.0})
    apart = jobs.find_candidates(spectra(spark, ["x", "y"]), params).groupBy("PLATE").count().collect()
    both = jobs.find_candidates(spectra(spark, ["x", "x"]), params)
    assert sorted(map(tuple, apart)) == sorted(map(tuple, both.groupBy("PLATE").count().collect()))
    assert {r[0] for r in both.select("SPECID").collect()} == {"x"}
    pixels = P.smooth(jobs.P.to_pixels(spectra(spark, ["x", "y"])), 0)
    trials = C.trial_redshifts(P.find_peaks(pixels, 4.0, 8.0))
    assert {r[0] for r in C.line_metrics(pixels, trials).select("SPECID").distinct().collect()} == {"x", "y"}
    bad = spectra(spark, ["x"]).withColumn("ivar", F.slice("ivar", 1, 3))
    done = jobs.run(params, str(tmp_path / "o"), spectra(spark, ["x", "x"]).union(bad))
    assert done.unusable.count() == 1


def test_repeated_ids_of_equal_metadata(spark):
    params = JobParams(mode="candidates", peak_finder_options={"width": 4.0, "min_significance": 8.0})

    def found(df):
        rows = jobs.find_candidates(df, params).collect()
        return sorted((r.ASSUMED_LINE, r.Z_TRY or 0.0, r.PEAK_SIGNIFICANCE or 0.0) for r in rows), {r.SPECTRUM for r in rows}

    apart, keys = found(spectra(spark, ["x", "y"]).drop("PLATE"))
    assert len(keys) == 2 and len(apart) > 2
    same = spectra(spark, ["x", "x"]).drop("PLATE")
    for df in (same, same.withColumn("start", F.lit(0)), same.withColumn("start", F.lit(None).cast("long"))):
        both, keys = found(df)
        assert both == apart and len(keys) == 2
    twice, keys = found(same.union(same))  # copies, too
    assert twice == sorted(apart * 2) and len(keys) == 4
    pieces = [same.withColumns({c: F.slice(c, at + 1, 200) for c in ("wave", "flux", "ivar")}).withColumn("start", F.lit(at))
              for at in (0, 200)]
    pieces = pieces[0].union(pieces[1])
    one, keys = found(pieces.withColumn("SPECID", F.when(F.col("flux")[0] == same.first().flux[0], "x").when(
        F.col("flux")[0] == same.first().flux[200], "x").otherwise("y")))
    assert one == apart and len(keys) == 2
    first = F.col("flux")[0].isin(same.first().flux[0], same.first().flux[200])
    told = pieces.withColumn("source", F.when(first, "a").otherwise("b"))  # each from a file of its own
    one, keys = found(told)
    assert one == apart and len(keys) == 2
    # nothing tells these apart: they are listed, and the others are found all the same
    other = pieces.withColumn("SPECID", F.lit("z")).where(first)
    rest, keys = found(pieces.union(other))
    assert len(keys) == 1 and set(rest) < set(apart)
    assert jobs.unusable_spectra(pieces.union(other)).count() == 4
    assert jobs.unusable_spectra(told).count() == 0 == jobs.unusable_spectra(same).count()


def test_spectra_off_the_break_grid_keep_their_peaks(spark):
    rows = []
    for s, start in enumerate((3000, 4000, 9000)):
        for i in range(600):
            w = float(start + i)
            rows.append((s, i, w, 1e5 / w + (30.0 if 300 <= i < 310 else 0.0), 1.0))
    df = spark.createDataFrame(rows, "SPECID long, pix long, wave double, flux double, ivar double")
    assert {r[0] for r in find_broken_power_law_peaks(df, 6.0).select("SPECID").collect()} == {0, 1, 2}
