"""Preprocessing by direct evaluation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenpeak.operators import cones as C
from lumenpeak.operators import exposures as X
from lumenpeak.operators import pixels as P
from lumenpeak.sources import writers as W

RNG = np.random.default_rng(9)


def frame(spark, wave, flux=None, ivar=None, specid=1):
    n = len(wave)
    return spark.createDataFrame(pd.DataFrame({
        "SPECID": specid, "pix": np.arange(n), "wave": wave,
        "flux": np.arange(n) * 1.0 if flux is None else flux,
        "ivar": np.ones(n) if ivar is None else ivar}))


def test_sky_mask(spark, monkeypatch):
    wave = np.sort(RNG.uniform(3600, 9000, 600))
    lines = np.sort(RNG.uniform(3600, 9000, 120))
    sky = spark.createDataFrame([(float(x),) for x in lines], "wave DOUBLE")
    for margin in (1.5e-4, 2e-3):
        rows = P.mask_sky(frame(spark, wave), sky, margin).orderBy("pix").collect()
        hit = (np.abs(np.log10(wave[:, None] / lines)) <= margin).any(axis=1)
        assert [r["ivar"] == 0 for r in rows] == list(hit) and len(rows) == 600
        plan = P.mask_sky(frame(spark, wave), sky, margin)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        with monkeypatch.context() as m:
            m.setattr(P, "SKY_LINES", 10)
            assert P.mask_sky(frame(spark, wave), sky, margin).orderBy("pix").collect() == rows


def test_cones(spark, monkeypatch):
    n, m = 3000, 400
    ra, dec = RNG.uniform(0, 360, n), np.degrees(np.arcsin(RNG.uniform(-1, 1, n)))
    ra[:4], dec[:4] = [0, 359.999, 720.0, 10], [0, 90, -90, 89.99]
    cra, cdec = RNG.uniform(-180, 540, m), np.degrees(np.arcsin(RNG.uniform(-1, 1, m)))
    radius = 10 ** RNG.uniform(-3, 0.6, m)
    cra[:6], cdec[:6] = [0, 360, 0.0, 180, 200, 20], [0, 0.1, 90, -89.9, 40, -20]
    radius[:6] = [0, 0.5, 3, 1, 40, 0.01]
    targets = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "RA": ra, "DEC": dec}))
    targets = targets.union(targets.where("k = 5")).union(spark.createDataFrame([(-1, None, 1.0)], targets.schema))

    def within(few):
        a, d, c0, d0 = (np.radians(x) for x in (ra[:, None], dec[:, None], cra[:few], cdec[:few]))
        h = np.sin((d - d0) / 2) ** 2 + np.cos(d) * np.cos(d0) * np.sin((a - c0) / 2) ** 2
        return (np.degrees(2 * np.arcsin(np.sqrt(np.minimum(h, 1)))) <= radius[:few]).any(axis=1)

    for few, limit in ((m, 10**6), (m, 0), (0, 10**6)):
        monkeypatch.setattr(C, "BROADCAST_ROWS", limit)
        cones = spark.createDataFrame(pd.DataFrame({"RA": cra[:few], "DEC": cdec[:few], "RADIUS": radius[:few]}),
                                      "RA double, DEC double, RADIUS double")
        cones = cones.union(spark.createDataFrame([(None, 1.0, 9.0), (1.0, 1.0, float("nan")), (1.0, 1.0, -1.0)],
                                                  cones.schema))
        want = within(few)
        keys = sorted([*np.flatnonzero(want), *([5] if want[5] else [])])
        assert sorted(r.k for r in C.in_cones(targets, cones).collect()) == keys
        rest = sorted([*np.flatnonzero(~want), *([] if want[5] else [5]), -1])
        assert sorted(r.k for r in C.in_cones(targets, cones, inside=False).collect()) == rest


def rebin_by_hand(wave, flux, ivar, w, extend):
    low = np.arange(4000, wave.min() - w, -w)[::-1]
    grid = np.unique(np.append(low, np.arange(4000, wave.max() + w, w)))
    out = {}
    for c in grid:
        m = (wave >= c - w / 2 - extend) & (wave < c + w / 2 + extend)
        out[float(c)] = (flux[m].mean(), ivar[m].sum()) if m.any() else (0.0, 0.0)
    return out


@pytest.mark.parametrize("lo, hi", [(3700, 5200), (4350, 5000), (3000, 3800)])
@pytest.mark.parametrize("w, extend", [(100.0, 0.0), (50.0, 80.0), (3.0, 0.0)])
def test_rebin(spark, lo, hi, w, extend):
    wave = np.sort(RNG.uniform(lo, hi, 150))
    flux, ivar = RNG.normal(size=150), RNG.uniform(size=150)
    want = rebin_by_hand(wave, flux, ivar, w, extend)
    got = {r["wave"]: (r["flux"], r["ivar"])
           for r in P.rebin(frame(spark, wave, flux, ivar), w, extend).collect()}
    assert sorted(got) == sorted(want)
    for c in want:
        np.testing.assert_allclose(got[c], want[c], atol=1e-9)


def test_empty_bins_fill_every_chunk_without_an_aggregation(spark):
    rows = [(1, 4000.0 + 3.0 * 9000, 2.0, 1.0), (1, 4001.0, 4.0, 3.0), (1, 4000.5, 6.0, 5.0),
            (2, None, 1.0, 1.0), (None, 4000.0 - 3.0 * 5000, 7.0, 2.0), (3, 4000.0 + 3.0 * 4096, 8.0, 9.0)]
    source = spark.createDataFrame(rows, "SPECID BIGINT, wave DOUBLE, flux DOUBLE, ivar DOUBLE")
    got = P.rebin(source, 3.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Union")]  # the grid meets no aggregation, so no task holds it
    made = {(r["SPECID"], r["k"]): (r["wave"], r["flux"], r["ivar"]) for r in got.collect()}
    assert len(made) == got.count() == 9001 + 1 + 5001 + 4097
    for key in ((1, 0), (1, 9000), (2, 0), (None, -5000), (None, 0), (3, 4096)):
        assert key in made
    assert {k: v[1:] for k, v in made.items() if v[1:] != (0.0, 0.0)} == {
        (1, 0): (5.0, 8.0), (1, 9000): (2.0, 1.0), (None, -5000): (7.0, 2.0), (3, 4096): (8.0, 9.0)}
    assert all(wave == 4000.0 + 3.0 * k for (_, k), (wave, _, _) in made.items())


def test_noise_repeats_and_spares_dead_pixels(spark):
    ivar = np.where(np.arange(400) % 4 == 0, 0.0, 4.0)
    source = frame(spark, np.arange(400.0), np.zeros(400), ivar)
    a, b = (P.add_noise(source, 3, seed=5).orderBy("pix").collect() for _ in range(2))
    assert a == b
    flux = np.array([r["flux"] for r in a])
    assert (flux[::4] == 0).all()
    assert np.std(flux[np.arange(400) % 4 != 0]) == pytest.approx(1.0, rel=0.15)
    assert P.add_noise(source, 1) is source


def test_exposures(spark):
    rows = [(1, "b", e, p, 10.0 + p, float(e + p), 1.0 + e, p == 2) for e in range(3)
            for p in range(4)]
    df = spark.createDataFrame(rows, "SPECID BIGINT, band STRING, exposure INT, pix BIGINT, "
                                     "wave DOUBLE, flux DOUBLE, ivar DOUBLE, mask BOOLEAN")
    masked = X.mask_exposures(df)
    got = {r["pix"]: (r["flux"], r["ivar"]) for r in X.combine_exposures(masked).collect()}
    assert got[2] == (0.0, 0.0)
    assert got[1] == (pytest.approx((1 * 1 + 2 * 2 + 3 * 3) / 6), 6.0)
    first = {r["pix"]: (r["flux"], r["ivar"]) for r in X.first_exposure(masked).collect()}
    assert first[3] == (3.0, 1.0) and first[2] == (2.0, 0.0)


def test_combined_bands_keep_weight(spark):
    """Resampling only moves weight: the total ivar inside the grid stays."""
    rows = [(1, b, p, start + 2.0 * p, 5.0, 2.0) for b, start in (("b", 100.0), ("r", 160.0))
            for p in range(50)]
    df = spark.createDataFrame(rows, "SPECID BIGINT, band STRING, pix BIGINT, wave DOUBLE, "
                                     "flux DOUBLE, ivar DOUBLE")
    for chunk in (4096, 8):
        out = X.combine_bands(df, 80, chunk).orderBy("pix").toPandas()
        assert len(out) == 80 and out["wave"].iloc[[0, -1]].tolist() == [100.0, 258.0]
        np.testing.assert_allclose(out["flux"][out["ivar"] > 0], 5.0)
        step = 158.0 / 79
        assert out["ivar"].sum() * step == pytest.approx(2 * 50 * 2 * 2.0, rel=0.02)


def test_arms(spark):
    flux = np.array([0, 0, 1, 2, 3, 4, 5, 6, 0, 0, 9, 10, 11, 12, 13, 14, 15, 0.0])
    arm = frame(spark, 100.0 + 2 * np.arange(18), flux, (flux != 0) * 1.0).withColumn(
        "arm", F.lit("red"))
    cut = X.trim_edges(arm)
    assert [r["pix"] for r in cut.orderBy("pix").collect()] == list(range(3, 16))
    gaps = X.find_gaps(cut)
    assert gaps.first()[2:] == (4, 13)
    filled = [r["flux"] for r in X.fill_gaps(cut, gaps).orderBy("pix").collect()]
    np.testing.assert_allclose(filled[1:11], np.linspace(3, 12, 10))


def test_array_form_in_pieces(spark):
    source = frame(spark, np.arange(100.0), RNG.normal(size=100))
    packed = W.to_spectra(source, chunk=16)
    assert packed.count() == 7 and packed.select(F.max(F.size("flux"))).first()[0] == 16
    back = P.to_pixels(packed).orderBy("pix").collect()
    assert back == source.select("SPECID", "pix", "wave", "flux", "ivar").orderBy("pix").collect()


def test_forbidden_ranges_come_in_pairs():
    assert P.forbidden_ranges([1.0, 2.0, 5.0, 6.0]) == [(1.0, 2.0), (5.0, 6.0)]
    with pytest.raises(ValueError):
        P.forbidden_ranges([1.0])


def test_arms_are_made_once(spark, tmp_path):
    rows = [(s, a, p, 100.0 * s + p, 0.0 if p in (20, 21) else 1.0 + p, 0.0 if p in (20, 21) else 1.0, 1.0)
            for s in (1, 2) for a in ("blue", "red") for p in range(40)]
    path = str(tmp_path / "arms")
    spark.createDataFrame(rows, "SPECID BIGINT, arm STRING, pix BIGINT, wave DOUBLE, flux DOUBLE, ivar DOUBLE, "
                                "sens DOUBLE").write.parquet(path)
    source = spark.read.parquet(path)
    cut = X.trim_edges(source)
    for df in (cut, X.find_gaps(cut), X.fill_gaps(cut, X.find_gaps(cut)), X.arm_spectra(source)):
        assert df.inputFiles() and not any(path in file for file in df.inputFiles())
    made = {(r["SPECID"], r["pix"]): r["flux"] for r in X.arm_spectra(source).collect()}
    assert made == {(s, p - 1): 1.0 + p for s in (1, 2) for p in range(1, 39)}
