"""Peak finders on analytic spectra, and chunked windows against whole ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenpeak.operators import continuum as K
from lumenpeak.operators import halo
from lumenpeak.operators import peaks as P
from lumenpeak.plans.params import peak_finder, register_peak_finder

WAVE = np.arange(4000.0, 9000.0)


def bumps(*peaks):
    return sum(a * np.exp(-(WAVE - m) ** 2 / (2 * s * s)) for m, a, s in peaks)


def frame(spark, flux, specid=1):
    return spark.createDataFrame(pd.DataFrame({
        "SPECID": specid, "pix": np.arange(len(flux)), "wave": WAVE[:len(flux)], "flux": flux,
        "ivar": 1.0}))


def found(df):
    rows = sorted(df.collect(), key=lambda r: r["pix"])
    return [r["pix"] for r in rows], [r["significance"] for r in rows]


FLAT = bumps((5000, 10, 100), (5500, 7, 100), (7000, 7, 150))
LINES3 = ((5000, 10, 50), (5500, 7, 50), (7000, 7, 100))


@pytest.mark.parametrize("width, least, pix, sig", [
    (70, 6, [1000, 1500, 3000], [76.4883757, 53.48831078, 30.52738474]),
    (70, 40, [1000, 1500], [76.4883757, 53.48831078]),
    (200, 6, [1039, 3000], [95.92189993, 131.96229093])])
@pytest.mark.parametrize("chunk", [4096, 300])
def test_flat_continuum(spark, width, least, pix, sig, chunk):
    got = found(P.find_peaks(frame(spark, FLAT), width, least, chunk))
    assert got[0] == pix
    np.testing.assert_allclose(got[1], sig, rtol=1e-7)


@pytest.mark.parametrize("chunk", [4096, 37])
def test_power_law(spark, chunk):
    pixels = frame(spark, 1e8 * WAVE**-2 + bumps(*LINES3))
    fits = K.fit_power_law(pixels, 2.0)
    fit = fits.first()
    np.testing.assert_allclose([fit["amplitude"], fit["power_index"]],
                               [1.09605851e8, 2.00703770], rtol=1e-7)
    got = found(K.compress_runs(K.power_law_pixels(pixels, fits, 2.0), chunk))
    assert got[0] == [1000, 1500, 3000]
    np.testing.assert_allclose(got[1], [1132.29694149, 754.85128291, 1529.2492195], rtol=1e-7)


def test_broken_power_law(spark):
    flux = np.where(WAVE > 6500, 1e8 * 6500 * WAVE**-3, 1e8 * WAVE**-2) + bumps(*LINES3)
    pix, _ = found(K.find_broken_power_law_peaks(frame(spark, flux), 2.0))
    np.testing.assert_allclose(pix, [1000, 1500, 2999], atol=2)


def test_too_few_points_give_a_flat_fit(spark):
    pixels = frame(spark, np.array([4.0, -1.0, -1.0, 6.0]))
    fit = K.fit_power_law(pixels, 100.0).first()
    assert (fit["amplitude"], fit["power_index"]) == (2.0, 0.0)
    negative = frame(spark, np.array([-4.0, -1.0, 2.0]))
    fit = K.fit_power_law(negative, 2.0).first()
    assert fit["failed"] and fit["amplitude"] == -1.0


def smooth_by_hand(flux, width):
    taps = np.array(P.smoothing_kernel(width))
    half = len(taps) // 2
    out = []
    for i in range(len(flux)):
        total = weight = 0.0
        for k, t in enumerate(taps):
            j = i + k - half
            x = flux[j] if 0 <= j < len(flux) else 0.0
            if not np.isnan(x):
                total, weight = total + t * x, weight + t
        out.append(total / weight)
    return out


@pytest.mark.parametrize("width", [1.0, 2.5, 9.0])
@pytest.mark.parametrize("chunk", [4096, 16])
def test_smoothing_against_direct_sum(spark, width, chunk):
    flux = np.random.default_rng(3).normal(5, 2, 90)
    flux[[0, 17, 40, 41]] = np.nan
    pixels = frame(spark, flux).withColumn(
        "flux", F.when(~F.isnan("flux"), F.col("flux")))
    rows = P.smooth(pixels, width, chunk).orderBy("pix").collect()
    np.testing.assert_allclose([r["smoothed"] for r in rows], smooth_by_hand(flux, width))


def test_peaks_by_direct_evaluation(spark):
    """Every significance recomputed by hand, with zero ivar and missing flux around."""
    rng = np.random.default_rng(5)
    flux, ivar = rng.normal(10, 4, 200), rng.uniform(0.5, 2, 200)
    flux[60], ivar[100:112] = np.nan, 0.0
    width, (full, half) = 1.5, P.frame_sizes(1.5)
    smooth = smooth_by_hand(flux, width)
    want = {}
    for i in range(1, 199):
        if not (smooth[i] > smooth[i - 1] and smooth[i] > smooth[i + 1]):
            continue
        if i < full or i + full > 200 or ivar[i - full:i + full].sum() == 0:
            continue
        side = flux[i - full:i - half].mean() + flux[i + half:i + full].mean()
        sig = (flux[i - half:i + half].mean() - side / 2) * np.sqrt(ivar[i - full:i + full].sum())
        if not np.isnan(sig):
            want[i] = sig
    data = pd.DataFrame({"SPECID": 1, "pix": range(200), "wave": 4000.0 + np.arange(200),
                         "flux": flux, "ivar": ivar})
    pixels = spark.createDataFrame(data).withColumn(
        "flux", F.when(~F.isnan("flux"), F.col("flux")))
    for chunk in (4096, 16):
        pix, sig = found(P.find_peaks(pixels, width, None, chunk))
        assert pix == sorted(want)
        np.testing.assert_allclose(sig, [want[p] for p in pix])


def test_positions_in_blocks(spark):
    """A key with most of the rows is numbered as a whole although cut into blocks."""
    rows = [(0 if i % 5 else i % 3, (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k INT, a INT, b INT")
    got = {(r["k"], r["b"]): r["pix"] for r in halo.positions(
        df, ["k"], ["a", "b"], F.expr("a div 64")).collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((a, b) for k, a, b in rows if k == key)
        assert [got[(key, b)] for _, b in ordered] == list(range(len(ordered)))


def test_runs_across_chunks(spark):
    pix = [0, 1, 2, 3, 4, 5, 8, 9, 15, 16, 31, 40]
    rows = [(1, p, float(p + 1)) for p in pix]
    df = spark.createDataFrame(rows, "SPECID BIGINT, pix BIGINT, significance DOUBLE")
    whole = sorted(map(tuple, K.compress_runs(df, 4096).collect()))
    assert [r[1] for r in whole] == [3, 9, 16, 31, 40]
    for chunk in (1, 2, 4, 8):
        assert sorted(map(tuple, K.compress_runs(df, chunk).collect())) == whole


def test_finder_options(spark):
    with pytest.raises(ValueError, match="unknown peak finder"):
        peak_finder("nope")
    with pytest.raises(ValueError, match="unknown options"):
        peak_finder("power_law", {"width": 3})
    register_peak_finder("every_pixel", lambda pixels, offset: pixels.select(
        "SPECID", "pix", "wave", F.lit(offset).alias("significance")), {"offset": 1.0})
    assert peak_finder("every_pixel")(frame(spark, FLAT[:7])).count() == 7


def test_fits_in_rows_and_by_rounds(spark):
    """Spectra fitted in one row agree with those fitted by rounds over their pixels."""
    rng = np.random.default_rng(5)
    rows = []
    for spec in range(4):
        wave = 3700.0 + 8.0 * np.arange(600 if spec else 30)
        flux = 50 * (wave / 6000) ** -1.5 + rng.normal(0, 1, len(wave)) + 40 * (rng.uniform(size=len(wave)) < 0.05)
        rows += [(spec, i, float(w), None if i == 7 else float(f), 0.0 if i == 9 else 1.0)
                 for i, (w, f) in enumerate(zip(wave, flux))]
    rows += [(9, i, 4000.0 + i, None, 1.0) for i in range(20)]  # no flux at all
    df = spark.createDataFrame(rows, "SPECID BIGINT, pix BIGINT, wave DOUBLE, flux DOUBLE, ivar DOUBLE")
    for find in (K.find_power_law_peaks, K.find_broken_power_law_peaks):
        whole, cut = (sorted(map(tuple, find(df, 5.0, chunk=c).collect())) for c in (4096, 100))
        assert [r[:3] for r in whole] == [r[:3] for r in cut] and len(whole) > 20
        np.testing.assert_allclose([r[3] for r in whole], [r[3] for r in cut], rtol=1e-6)
