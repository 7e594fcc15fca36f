"""Trial redshifts, line metrics and truth columns by direct evaluation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenpeak.functions.constants import LINES, TRY_LINES
from lumenpeak.operators import candidates as C
from lumenpeak.operators.rangejoin import interval_join

PEAKS = "SPECID BIGINT, pix BIGINT, wave DOUBLE, significance DOUBLE"


def metrics_by_hand(wave, flux, ivar, z):
    out = {}
    for index, line in enumerate(LINES):
        inside = [(wave >= (1 + z) * line[a]) & (wave <= (1 + z) * line[a + 1]) for a in (2, 4, 6)]
        peak, blue, red = inside
        n = [int(m.sum()) for m in inside]
        if 0 in n or n[1] < n[0] // 2 or n[2] < n[0] // 2:
            continue
        p, b, r = (flux[m].mean() for m in inside)
        cont = r + b
        if cont == 0 or math.isnan(cont):
            continue
        if math.isnan(p):  # the sides still give ratio2
            out[index] = (None, None, abs((r - b) / cont))
            continue
        v = [ivar[m].sum() for m in inside]
        ratio = 2 * p / cont
        sn = None
        if 0.0 not in v:
            err = math.sqrt(4 / v[0] + ratio**2 * (1 / v[1] + 1 / v[2]) / 4) / abs(cont)
            sn = (ratio - 1) / err
        out[index] = (ratio, sn, abs((r - b) / cont))
    return out


@pytest.mark.parametrize("piece", [4096, 50, 7])  # in one row, and in pieces
def test_line_metrics(spark, piece):
    rng = np.random.default_rng(1)
    spectra, rows = {}, []
    for s in range(3):
        wave = np.sort(rng.uniform(3600, 9800, 700))
        flux, ivar = rng.normal(3, 2, 700), rng.uniform(0, 2, 700)
        ivar[200:320] = 0.0
        flux[500] = np.nan
        spectra[s] = (wave, flux, ivar)
        rows += [(s, i, *map(float, v)) for i, v in enumerate(zip(wave, flux, ivar))]
    pixels = spark.createDataFrame(rows, "SPECID BIGINT, pix BIGINT, wave DOUBLE, flux DOUBLE, "
                                         "ivar DOUBLE").withColumn(
        "flux", F.when(~F.isnan("flux"), F.col("flux")))
    peaks = spark.createDataFrame(
        [(s, p, float(spectra[s][0][p]), 9.0) for s in range(3) for p in (30, 250, 480, 690)],
        PEAKS)
    trials = C.trial_redshifts(peaks)
    want = {}
    for t in trials.collect():
        assert t["Z_TRY"] >= 0
        for line, values in metrics_by_hand(*spectra[t["SPECID"]], t["Z_TRY"]).items():
            want[(t["SPECID"], t["peak_pix"], t["try_order"], line)] = values
    got = {(r["SPECID"], r["peak_pix"], r["try_order"], r["line_index"]):
           (r["ratio"], r["ratio_sn"], r["ratio2"])
           for r in C.line_metrics(pixels, trials, piece=piece).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert (a is None) == (b is None)
            if a is not None:
                assert a == pytest.approx(b, rel=1e-9)


def test_wide_table_is_the_pivot_of_the_metrics(spark):
    rng = np.random.default_rng(4)
    wave = np.arange(3600.0, 9800.0, 4.0)
    rows = [(s, i, float(w), float(f), float(v)) for s in range(4)
            for i, (w, f, v) in enumerate(zip(wave, rng.normal(3, 2, len(wave)), rng.uniform(0, 2, len(wave))))
            if s != 3 or i < 40]
    rows += [(5, 0, 4000.0, None, 1.0), (5, 1, 4001.0, float("inf"), float("nan"))]
    pixels = spark.createDataFrame(rows, "SPECID BIGINT, pix BIGINT, wave DOUBLE, flux DOUBLE, ivar DOUBLE")
    peaks = spark.createDataFrame([(s, p, 3600.0 + 4 * p, 9.0) for s in (0, 1, 2, 3, 5, 8) for p in (1, 300, 1200)], PEAKS)
    trials = C.trial_redshifts(peaks)  # spectrum 8 has no pixels
    want = C.candidate_table(trials, C.line_metrics(pixels, trials))
    for piece in (4096, 1000):  # a part of the spectra, then all, in one row
        got = C.measured_candidates(pixels, trials, piece=piece)
        assert got.columns == want.columns and got.count() == trials.count()
        for a, b in zip(*(sorted(map(tuple, df.collect()), key=lambda r: r[:3]) for df in (got, want))):
            assert [x is None for x in a] == [x is None for x in b] and a[-1] == b[-1]
            a, b = ([x for x in r[:-1] if x is not None] for r in (a, b))
            assert a == pytest.approx(b, rel=1e-9, nan_ok=True)


def test_pairs_grow_with_the_length_of_a_spectrum(spark):
    met = []
    for n in (25_000, 100_000):  # four times the range, pieces and peaks
        pixels = spark.range(n).selectExpr("1L AS SPECID", "id AS pix", "3600 + 0.05D * id AS wave", "1D AS flux", "1D AS ivar")
        peaks = pixels.where("pix % 500 = 0").selectExpr("SPECID", "pix", "wave", "9D AS significance")
        pairs = C.met_pieces(pixels, C.trial_redshifts(peaks), piece=256)
        met.append(pairs.agg(F.count("*"), F.sum(F.size("shift"))).first())
    assert 0 < met[1][0] < 5 * met[0][0]


def test_interval_join_bounds_are_inclusive(spark):
    points = spark.createDataFrame([(1, float(x)) for x in range(-20, 21)], "k INT, x DOUBLE")
    spans = spark.createDataFrame([(1, "a", -7.0, 3.0), (1, "b", 3.0, 3.0), (1, "c", 5.0, 4.0),
                                   (2, "d", -9.0, 9.0)], "k INT, id STRING, lo DOUBLE, hi DOUBLE")
    for width in (0.7, 4.0, 1000.0):
        rows = interval_join(points, spans, ["k"], "x", "lo", "hi", width).collect()
        assert sorted((r["id"], r["x"]) for r in rows) == sorted(
            [("a", float(x)) for x in range(-7, 4)] + [("b", 3.0)])


def test_interval_members_move_no_interval(spark):
    rng = np.random.default_rng(5)
    rows = [(s, float(w), float(f), float(f) / 3) for s, lo, n in ((1, 3600, 300), (2, 4000, 40), (3, -200, 12))
            for w, f in zip(np.round(lo + rng.uniform(0, 3000, n), 1), range(n))]
    rows += [rows[0], (1, None, 1.0, 1.0), (None, 5000.0, 1.0, 1.0), (4, 1e15, 1.0, 1.0), (4, 1300.0, 2.0, None),
             (2, 4444.0, None, 1.0)]
    pixels = spark.createDataFrame(rows, "SPECID BIGINT, wave DOUBLE, flux DOUBLE, ivar DOUBLE")
    tries = [(s, p, t, z) for s in (1, 2, 3, 4, 5, None) for p, t, z in
             ((1, 0, 0.0), (1, 1, 0.7), (9, 0, 2.5), (9, 2, -3.0), (9, 3, None))]
    tries += [(1, 1, 1, 0.7), (4, 7, 0, 1.0)]
    trials = spark.createDataFrame(tries, "SPECID BIGINT, peak_pix BIGINT, try_order INT, Z_TRY DOUBLE")
    want = interval_join(pixels, C.line_intervals(trials), ["SPECID"], "wave", "lo", "hi", C.METRIC_BIN_WIDTH)
    for options in ({}, {"piece": 50}, {"deal": 3}, {"bin_width": 7.0}):
        got = C.interval_members(pixels, trials, **options)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert got.count() == want.count() > 500
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in plain}
    try:
        for name, value in plain.items():
            spark.conf.set(name, value)
        members = C.interval_members(pixels.where("SPECID < 4"), trials).groupBy(
            *C.CANDIDATE_KEY, "line_index", "band").count()
        plan = members._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("line_index" in line or "__bin" in line for line in moved)


def test_interval_members_make_no_list_per_interval(spark):
    # a single pixel, equal ones, ends of bins, gaps of many bins, waves below zero
    waves = {1: [5000.0], 2: [4000.0, 4000.0, 4049.9, 4050.0, 4100.0, 9000.0, 9050.0], 3: [-120.0, -50.0, -0.1, 0.0, 1200.0]}
    pixels = [(s, w, float(i), None if i == 2 else 1.0 + i) for s in waves for i, w in enumerate(waves[s])]
    shifts = [0.0, 1.0, 3.5, 1e7, 1e300, -1e300, -1.0, -2.0, float("nan"), None]
    tries = [(s, p, 0, z) for s in (1, 2, 3, 4) for p, z in enumerate(shifts)]
    lines = (("a", 1.0, 4000.0, 4050.0, 4050.0, 9000.0, 5000.0, 5000.0), ("b", 1.0, 0.0, 1e9, 4100.1, 8999.9, 6.0, 5.0),
             ("c", 1.0, 1.0, 1200.0, -60.0, 0.0, 9050.0, 9051.0))
    want = []
    for s, p, t, z in tries:
        for k, line in enumerate(lines):
            for band in range(3) if z is not None else ():
                lo, hi = (1.0 + z) * line[2 + 2 * band], (1.0 + z) * line[3 + 2 * band]
                want += [(s, w, f, v, p, t, k, band, lo, hi) for q, w, f, v in pixels if q == s and lo <= w <= hi]
    members = C.interval_members(
        spark.createDataFrame(pixels, "SPECID BIGINT, wave DOUBLE, flux DOUBLE, ivar DOUBLE"),
        spark.createDataFrame(tries, "SPECID BIGINT, peak_pix BIGINT, try_order INT, Z_TRY DOUBLE"), lines)
    assert sorted(map(tuple, members.collect()), key=repr) == sorted(want, key=repr) and len(want) > 50
    plan = members.groupBy(*C.CANDIDATE_KEY, "line_index", "band").count()._jdf.queryExecution().executedPlan().toString()
    behind = plan[:plan.index("Join [SPECID")]  # a lambda would not be compiled
    assert behind.count("Generate explode") == 2 and "lambda" not in behind


def test_interval_members_of_few_candidates_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(C, "MEMBER_PIXELS", 100)
    pixels = spark.range(950).selectExpr("id % 95 AS SPECID", "4000D + id AS wave", "1D AS flux", "1D AS ivar")
    trials = spark.createDataFrame([(7, 1, 0, 2.5)], "SPECID BIGINT, peak_pix BIGINT, try_order INT, Z_TRY DOUBLE")
    members = C.interval_members(pixels, trials)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 10), REPARTITION_BY_NUM") == 2 and members.count() > 0


def test_trial_redshifts_keep_order_and_sign(spark):
    peaks = spark.createDataFrame([(1, 5, 1549.06, 7.0), (2, 3, 900.0, 8.0)], PEAKS)
    rows = C.trial_redshifts(peaks).collect()
    assert [(r["SPECID"], r["ASSUMED_LINE"]) for r in rows] == [(1, "lya"), (1, "civ")]
    assert rows[1]["Z_TRY"] == 0.0 and TRY_LINES[rows[0]["try_order"]] == "lya"
    with pytest.raises(ValueError, match="not in the line table"):
        C.trial_redshifts(peaks, try_lines=("lya", "xx"))


def test_unpeaked_spectra(spark):
    spectra = spark.createDataFrame([(1,), (2,), (3,)], "SPECID BIGINT")
    peaks = spark.createDataFrame([(1, 5, 5000.0, 7.0), (2, 3, 900.0, 8.0)], PEAKS)
    table = C.with_unpeaked(C.trial_redshifts(peaks), spectra, peaks)
    bare = table.where("ASSUMED_LINE = 'none'").collect()
    # spectrum 2 has a peak but no trial redshift: no row at all
    assert [r["SPECID"] for r in bare] == [3] and bare[0]["Z_TRY"] is None
    assert table.where("SPECID = 2").count() == 0


def test_pixel_metrics_at_the_edges(spark):
    pixels = spark.createDataFrame([(1, p, 10.0 * p, 1.0 + p) for p in range(5)],
                                   "SPECID BIGINT, pix BIGINT, flux DOUBLE, ivar DOUBLE")
    peaks = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 4, 0.0, 1.0)], PEAKS)
    rows = {r["peak_pix"]: r for r in C.pixel_metrics(pixels, peaks, 2).collect()}
    assert [rows[1][f"FLUX_{k}"] for k in (-2, -1, 0, 1)] == [None, 0.0, 10.0, 20.0]
    assert [rows[4][f"IVAR_{k}"] for k in (-2, -1, 0, 1)] == [3.0, 4.0, 5.0, None]


def test_truth_columns(spark):
    waves = {line[0]: line[1] for line in LINES}
    other = waves["civ"] / waves["lya"] * 3.0 - 1  # z of the peak if it is lya
    rows = [
        (1, 3, 2.0, 2.1, "lya"),        # quasar, right
        (2, 30, 2.0, 2.15, "lya"),      # BAL quasar at the tolerance
        (3, 1, 2.0, 2.0, "lya"),        # star with the right redshift
        (4, 4, 2.0, 2.0, "lya"),        # galaxy with the right redshift
        (5, 3, other, 2.0, "civ"),      # quasar right through another line only
        (6, 3, 1.0, None, "none"),      # no peak
        (7, 3, None, 2.0, "lya"),       # unknown truth
    ]
    df = spark.createDataFrame(
        rows, "SPECID BIGINT, CLASS_PERSON INT, Z_TRUE DOUBLE, Z_TRY DOUBLE, ASSUMED_LINE STRING")
    got = {r["SPECID"]: (r["CORRECT_REDSHIFT"], r["IS_CORRECT"], r["IS_LINE"])
           for r in C.with_truth(df, 0.15 + 1e-12).collect()}
    assert got == {1: (True, True, True), 2: (True, True, True), 3: (False, False, False),
                   4: (True, False, False), 5: (False, False, True),
                   6: (False, False, False), 7: (False, False, False)}
    with pytest.raises(ValueError, match="Z_TRUE"):
        C.with_truth(df.drop("Z_TRUE"))


def test_merge_fills_missing_columns(spark):
    a = spark.createDataFrame(pd.DataFrame({"SPECID": [1], "A": [1.0]}))
    b = spark.createDataFrame(pd.DataFrame({"SPECID": [2], "B": [2.0]}))
    rows = {r["SPECID"]: (r["A"], r["B"]) for r in C.merged([a, b]).collect()}
    assert rows == {1: (1.0, None), 2: (None, 2.0)}
