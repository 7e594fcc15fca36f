"""The broken power law with a free break, spectrum by spectrum in numpy."""

import numpy as np
import pandas as pd
import pytest

from lumenpeak.operators import continuum as K
from lumenpeak.operators.packedfits import two_lines


def model(fit, wave):
    amplitude, blue, red, at = fit
    return amplitude * np.where(wave < at, (wave / at) ** -blue, (wave / at) ** -red)


def hinged(x, z, w, at):
    """Best pair of lines that meet at ``at``, and its misfit."""
    basis = np.column_stack([np.ones_like(x), np.where(x < at, x - at, 0), np.where(x < at, 0, x - at)])
    coef, *_ = np.linalg.lstsq(basis * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)
    return (w * (z - basis @ coef) ** 2).sum(), (*coef, at)


def by_search(x, z, w):
    """The break by a fine search between all neighbouring points."""
    best = None
    for i in range(1, len(x) - 2):
        for at in np.linspace(x[i], x[i + 1], 41)[1:]:
            tried = hinged(x, z, w, at)
            best = tried if best is None or tried[0] < best[0] else best
    return best


@pytest.mark.parametrize("seed", range(6))
def test_no_break_beats_the_closed_form(seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, 1, 24))
    z = np.where(x < 0.6, x - 0.6, -2 * (x - 0.6)) + rng.normal(0, 0.2, 24)
    w = rng.uniform(0.5, 3, 24)
    level, blue, red, at = two_lines(x, z, w)
    misfit = (w * (z - level - np.where(x < at, blue, red) * (x - at)) ** 2).sum()
    assert misfit <= by_search(x, z, w)[0] * (1 + 1e-9)


def test_points_that_allow_no_break():
    for n in (0, 1, 2, 3):
        with np.errstate(all="ignore"):
            assert two_lines(np.arange(n, dtype=float), np.ones(n), np.ones(n)) is None


def noisy(rng, wave, specid):
    at = rng.uniform(4400, 5400)
    flux = model((20.0, rng.uniform(0, 2), rng.uniform(1, 4), at), wave)
    flux = flux + rng.normal(0, 0.5, len(wave)) + 12 * (rng.uniform(size=len(wave)) < 0.08)
    ivar = rng.uniform(2, 5, len(wave)) * (0.2, 2.0, 9.0)[specid % 3]
    flux[5], ivar[9] = -3.0, 0.0
    return flux, ivar


def frame(spark, spectra):
    return spark.createDataFrame(pd.concat([pd.DataFrame(
        {"SPECID": s, "pix": np.arange(len(w)), "wave": w, "flux": f, "ivar": v}) for s, (w, f, v) in spectra.items()]))


def gauss_newton(wave, flux, ivar, use, start, steps):
    """Least squares in flux by steps whose breaks are searched one by one."""
    x = np.log(wave) - K.LOG_ORIGIN
    x, f, v = x[use], flux[use], ivar[use]

    def value(fit):
        return fit[0] + np.where(x < fit[3], fit[1], fit[2]) * (x - fit[3])

    def misfit(fit):
        return (v * (f - np.exp(value(fit))) ** 2).sum()

    if start is None:
        pos = f > 0
        start = two_lines(x[pos], np.log(f[pos]), v[pos] * f[pos] ** 2)
    for _ in range(steps):
        m = np.exp(value(start))
        tried = two_lines(x, np.log(m) + (f - m) / m, v * m * m)
        if not misfit(tried) < misfit(start):
            break
        start = tried
    return start


def fit_by_hand(wave, flux, ivar, least):
    start = (ivar > 0) & (flux >= 0)
    fits, lowest = [gauss_newton(wave, flux, ivar, start, None, K.FLUX_STEPS)], None

    def natural(fit):
        return np.exp(fit[0]), -fit[1], -fit[2], np.exp(fit[3] + K.LOG_ORIGIN)

    while True:
        mask = start.copy()
        for fit in fits:
            mask &= np.abs(flux - model(natural(fit), wave)) * np.sqrt(ivar) < least
        chi2 = ((flux - model(natural(fits[-1]), wave))[mask] ** 2 * ivar[mask]).sum()
        if lowest is not None and (np.isclose(chi2, lowest) or chi2 >= lowest):
            return [natural(f) for f in fits[:-1]]
        lowest = chi2
        fits.append(gauss_newton(wave, flux, ivar, mask, fits[-1], K.FLUX_STEPS))


@pytest.mark.parametrize("chunk", [4096, 40])  # in the row, and in rounds over pixels
def test_loop(spark, chunk):
    rng = np.random.default_rng(17)
    wave = np.arange(4000.0, 5800.0, 12.0)
    spectra = {s: (wave, *noisy(rng, wave, s)) for s in range(12 if chunk > 100 else 2)}
    fits = {r["SPECID"]: r for r in K.fit_broken_power_law(frame(spark, spectra), 3.0, chunk=chunk).collect()}
    want = {s: fit_by_hand(*arrays, 3.0) for s, arrays in spectra.items()}
    assert fits.keys() == want.keys()
    for specid, clips in want.items():
        got = [tuple(c) for c in fits[specid]["clips"]]
        assert len(got) == len(clips)
        np.testing.assert_allclose(got, clips, rtol=1e-6)


def test_once_gives_the_first_fit(spark):
    rng = np.random.default_rng(3)
    wave = np.arange(4000.0, 5800.0, 12.0)
    spectra = {0: (wave, *noisy(rng, wave, 0))}
    whole, cut = (tuple(K.fit_broken_power_law(frame(spark, spectra), 3.0, chunk=c, once=True).first()["clips"][0])
                  for c in (4096, 40))
    np.testing.assert_allclose(whole, cut, rtol=1e-7)
    np.testing.assert_allclose(whole, fit_by_hand(*spectra[0], 3.0)[0], rtol=1e-9)


@pytest.mark.parametrize("ivar", [4.0, 400.0])
def test_laws_without_noise_have_no_peaks(spark, ivar):
    wave = np.arange(4000.0, 9000.0, 2.0)
    spectra = {i: (wave, model((50.0, 1.0, 3.0, at), wave), np.full(len(wave), ivar))
               for i, at in enumerate((6400.0, 6450.0, 6451.3, 4100.0, 9400.0))}
    near = np.arange(9000.0, 11000.0, 2.0)  # beyond any range of optical breaks
    spectra[9] = (near, model((50.0, 0.5, 2.0, 9871.0), near), np.full(len(near), ivar))
    pixels = frame(spark, spectra)
    assert K.find_broken_power_law_peaks(pixels, 5.0).count() == 0
    fits = {r["SPECID"]: r for r in K.fit_broken_power_law(pixels, 5.0).collect()}
    for i, at in ((0, 6400), (1, 6450), (2, 6451.3), (3, 4100), (9, 9871)):
        np.testing.assert_allclose(fits[i]["break_wave"], at, rtol=1e-6)


def test_known_spectrum(spark):
    """Three bumps on a law that breaks at 6500 A; the known fit was found by a general solver."""
    wave = np.arange(4000.0, 9000.0)
    flux = np.where(wave > 6500, 1e8 * 6500 * wave ** -3, 1e8 * wave ** -2)
    for centre, height, width in ((5000, 10, 50), (5500, 7, 50), (7000, 7, 100)):
        flux = flux + height * np.exp(-(wave - centre) ** 2 / 2 / width ** 2)
    pixels = frame(spark, {0: (wave, flux, np.ones(len(wave)))})
    fit = K.fit_broken_power_law(pixels, 2.0).first()
    np.testing.assert_allclose(fit["break_wave"], 7154.00072, rtol=1e-5)
    np.testing.assert_allclose([fit[c] for c in ("amplitude", "blue_index", "red_index")],
                               [2.13162327, 1.84380352, 4.36938260], rtol=2e-3)
    peaks = sorted((r["pix"], r["significance"]) for r in K.find_broken_power_law_peaks(pixels, 2.0).collect())
    assert [p for p, _ in peaks] == [1000, 1500, 2999]
    np.testing.assert_allclose([s for _, s in peaks], [1132.82042781, 742.97287816, 1417.40093294], rtol=1e-3)
