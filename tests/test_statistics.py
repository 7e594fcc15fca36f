"""Sweeps and quantiles against filtering once per cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenpeak.functions.columns import cut_index
from lumenpeak.functions.constants import (PROB_GRID, REPORT_CUTS, SIGNIFICANCE_CUTS,
                                           VELOCITY_EDGES)
from lumenpeak.operators import quantiles as Q
from lumenpeak.operators import reports as R
from lumenpeak.operators import statistics as S


def test_grids():
    assert len(PROB_GRID) == 100 and len(REPORT_CUTS) == 18 and len(SIGNIFICANCE_CUTS) == 100
    assert REPORT_CUTS[2] == 0.7999999999999999 and REPORT_CUTS[8] == 0.49999999999999967


@pytest.mark.parametrize("cuts, op", [
    (PROB_GRID, ">="), (PROB_GRID, ">"), ([1.0, 4.0, 9.0], "<="),
    (sorted(SIGNIFICANCE_CUTS, reverse=True), ">="),
    ([float(i * i) for i in range(40)], "<="), ([float(i) for i in range(40)], "<")])
def test_cut_index(spark, cuts, op):
    rng = np.random.default_rng(4)
    lo, hi = min(cuts), max(cuts)
    values = [float(v) for v in rng.uniform(lo - 1, hi + 1, 300)] + list(cuts)
    values += [float(np.nextafter(c, d)) for c in cuts for d in (-1e9, 1e9)]
    values += [float("inf"), float("-inf"), 1e300]
    ops = {">=": np.greater_equal, ">": np.greater, "<=": np.less_equal, "<": np.less}
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    got = df.select(cut_index(F.col("v"), cuts, op)).collect()
    for v, r in zip(values, got):
        passed = np.flatnonzero(ops[op](v, cuts))
        assert r[0] == (passed[0] if len(passed) else len(cuts)), v
    assert got[-1][0] == len(cuts)


def candidates(spark, n=900, seed=6):
    rng = np.random.default_rng(seed)
    z = np.round(rng.uniform(0, 4, n), 2)
    near = rng.uniform(size=n) < 0.5
    data = pd.DataFrame({
        "SPECID": rng.integers(0, 250, n), "Z_TRUE": z,
        "Z_TRY": np.where(near, z + rng.uniform(-0.2, 0.2, n), rng.uniform(0, 4, n)),
        "PROB": np.round(rng.uniform(0, 1, n), 2), "R_MAG": np.round(rng.uniform(17, 23, n), 1),
        "CLASS_PERSON": rng.choice([1, 3, 30, 4], n), "DUPLICATED": rng.uniform(size=n) < 0.4,
        "PEAK_SIGNIFICANCE": np.round(rng.uniform(0, 12, n), 1)})
    data["DELTA_Z"] = data["Z_TRY"] - data["Z_TRUE"]
    data["IS_CORRECT"] = (data["DELTA_Z"].abs() <= 0.15) & data["CLASS_PERSON"].isin([3, 30])
    return data, spark.createDataFrame(data)


def truth(spark):
    rng = np.random.default_rng(8)
    data = pd.DataFrame({"SPECID": np.arange(250), "Z_TRUE": rng.uniform(0, 4, 250),
                         "R_MAG": rng.uniform(17, 23, 250)})
    return data, spark.createDataFrame(data)


def test_sweep_counts(spark):
    data, df = candidates(spark)
    known, truth_df = truth(spark)
    rows = S.sweep_by_magnitude(df, truth_df, [18.5, 21.0]).collect()
    assert len(rows) == 300
    for r in rows:
        d, t = data[~data["DUPLICATED"] & (data["PROB"] >= r["prob"])], known
        if r["mag_cut"] is not None:
            d, t = d[d["R_MAG"] <= r["mag_cut"]], t[t["R_MAG"] <= r["mag_cut"]]
        good = d[d["IS_CORRECT"]]
        up = ((good["Z_TRUE"] >= 2.1) & (good["Z_TRY"] < 2.1)).sum()
        down = ((good["Z_TRUE"] < 2.1) & (good["Z_TRY"] >= 2.1)).sum()
        assert r["num_quasars"] == len(t) and r["num_candidates"] == len(d)
        assert r["num_candidates_zge2_1"] == (d["Z_TRY"] >= 2.1).sum() + up - down
        assert r["found"] == len(good) and r["missed"] == len(t) - len(good)
        alt = d[d["CLASS_PERSON"].isin([3, 30])]
        high = ((alt["Z_TRUE"] >= 2.1) & (alt["Z_TRY"] >= 2.1)).sum()
        assert r["found_alt_zge2_1"] == high + up
        if len(d):
            assert r["purity"] == pytest.approx(len(good) / len(d))


def test_peak_finder_study(spark):
    """Objects counted once although their rows have different magnitudes."""
    data, df = candidates(spark)
    known, truth_df = truth(spark)
    for r in S.peak_finder_completeness(df, truth_df, [18.0, 19.5, 21.0, 22.9]).collect():
        d = data[(data["R_MAG"] <= r["mag_cut"])]
        t = known[known["R_MAG"] <= r["mag_cut"]]
        assert r["num_spectra"] == d["SPECID"].nunique()
        assert r["num_spectra_qso"] == len(t)
        d = d[d["PEAK_SIGNIFICANCE"] >= r["significance_cut"]]
        good = d[(d["CLASS_PERSON"] == 3) & (d["DELTA_Z"].abs() <= 0.15)]
        assert r["num_entries"] == len(d) and r["num_correct_entries"] == len(good)
        assert r["completeness"] == pytest.approx(good["SPECID"].nunique() / len(t))
        high = good[good["Z_TRUE"] >= 2.1]["SPECID"].nunique()
        assert r["completeness_zge2_1"] == pytest.approx(high / (t["Z_TRUE"] >= 2.1).sum())


def test_optimum_prefers_first_on_ties(spark):
    data, df = candidates(spark)
    _, truth_df = truth(spark)
    sweep = S.threshold_sweep(df, truth_df)
    frame = sweep.orderBy("prob_index").toPandas()
    best = {r["case"]: r for r in S.optimal_threshold(sweep).collect()}
    for case, s in S._CASES:
        at = int(np.nanargmax(frame[f"f1_score{s}"].astype(float)))
        assert best[case]["prob"] == frame["prob"][at]
    crossing = {r["case"]: r for r in S.optimal_threshold(sweep, by_f1=False).collect()}
    gap = (frame["purity"].astype(float) - frame["completeness"].astype(float)).abs()
    assert crossing["all z"]["prob"] == frame["prob"][int(np.nanargmin(gap))]


def test_empty_selection_gives_null(spark):
    _, df = candidates(spark)
    row = S.purity(df.withColumn("IS_LINE", F.col("IS_CORRECT")).where("PROB > 2")).first()
    assert row["num_candidates"] == 0 and row["purity"] is None


def test_exact_medians(spark):
    rng = np.random.default_rng(12)
    groups = {
        0: np.full(501, 3.25), 1: rng.normal(0, 1e-9, 400) + 7, 2: rng.lognormal(0, 8, 777),
        3: np.array([1.0, 2.0]), 4: np.append(np.zeros(600), rng.uniform(0, 1e-12, 599)),
        5: np.array([5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs],
                               "k INT, v DOUBLE")
    got = Q.medians(df, "k", "v")
    assert got == {k: pytest.approx(np.median(v), rel=1e-15) for k, v in groups.items()}


def test_histogram_edges(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.uniform(-21000, 21000, 500), VELOCITY_EDGES])
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    want, _ = np.histogram(values, bins=VELOCITY_EDGES)
    got = {r["bin"]: r["n"] for r in R.histogram(df, "v", VELOCITY_EDGES).collect()}
    assert [got.get(i, 0) for i in range(len(want))] == list(want)
