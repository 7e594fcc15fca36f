"""Clipped continuum fits of spectra that fit into one row.

A spectrum of at most CHUNK pixels is one row of arrays, so all its rounds run where
the row lies; a task reads its rows one Arrow batch at a time.  The rules are those
of ``continuum``, which fits longer spectra by rounds over their pixels.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package


def _near(old: float, new: float) -> bool:
    return abs(old - new) <= 1e-8 + 1e-5 * abs(new)


def _flags(flux: np.ndarray, ivar: np.ndarray, model: np.ndarray, limit: float) -> np.ndarray:
    """Pixels whose significance is below the limit; an undefined one is not."""
    return np.abs(flux - model) * np.sqrt(ivar) < limit


def power_law_of(wave: np.ndarray, flux: np.ndarray, ivar: np.ndarray, limit: float,
                 origin: float) -> dict:
    """Missing values are NaN here."""
    usable = (flux > 0) & (ivar > 0) & np.isfinite(flux) & np.isfinite(ivar)
    known = flux[~np.isnan(flux)]
    mean_flux = known.mean() if len(known) else np.nan
    x, y, weight = np.log(wave) - origin, np.log(np.where(usable, flux, 1.0)), ivar * ivar
    kept = np.ones(len(wave), bool)
    amplitude, index, failed, clips = 0.0, 0.0, True, []
    while True:
        use = usable & kept
        n, w, u, v = int(use.sum()), weight[use], x[use], y[use]
        sw, sx, sy, sxx, sxy = w.sum(), (w * u).sum(), (w * v).sum(), (w * u * u).sum(), (w * u * v).sum()
        below = sxx * sw - sx * sx
        slope = (sxy * sw - sx * sy) / below if below != 0 else np.nan
        raw = np.exp((sy - slope * sx) / sw - slope * origin) if sw != 0 else np.nan
        if n >= 3 and raw > 0 and np.isfinite(raw) and np.isfinite(slope):
            tried, tried_index = float(raw), -float(slope)
        else:
            tried, tried_index = float(mean_flux if n < 3 else flux[use].mean()), 0.0
        fails = not tried > 0
        if fails:
            tried, tried_index = float(mean_flux), 0.0
        # a spectrum without any flux has no fit to wait for
        if np.isnan(tried) or (_near(amplitude, tried) and _near(index, tried_index)):
            return {"amplitude": amplitude, "power_index": index, "clips": clips, "failed": failed}
        amplitude, index, failed = tried, tried_index, fails
        if not fails:
            clips.append({"amplitude": amplitude, "power_index": index})
            kept &= _flags(flux, ivar, amplitude * wave ** -index, limit)


def _broken_model(x: np.ndarray, fit: tuple) -> np.ndarray:
    """Logarithm of the model at logarithms of wavelength; the fit is (level at the
    break, slopes on its blue and red side, the break)."""
    level, blue, red, at = fit
    return level + np.where(x < at, blue, red) * (x - at)


def two_lines(x: np.ndarray, z: np.ndarray, w: np.ndarray) -> tuple | None:
    """The continuous pair of straight lines through (x, z) with the least weighted misfit.

    ``x`` is in order.  For every split of the points the best pair either consists of
    the two free lines, if they meet in the gap between the parts, or meets at a point;
    both have closed forms in running sums, so the break is found exactly, anywhere.
    None if no split leaves two points with different x on both sides.
    """
    terms = np.stack([np.ones_like(w), w, w * x, w * x * x, w * z, w * x * z, w * z * z])
    upto = np.cumsum(terms, axis=1)
    whole, left, at = upto[:, -1:], upto[:, :-1], x[1:]
    right = whole - left
    enough = (left[0] >= 2) & (right[0] >= 2)

    def line(s):
        slope = (s[1] * s[5] - s[2] * s[4]) / (s[1] * s[3] - s[2] * s[2])
        level = (s[4] - slope * s[2]) / s[1]
        return level, slope, s[6] - level * s[4] - slope * s[5]

    def hinge(s):
        return s[2] - at * s[1], s[3] - 2 * at * s[2] + at * at * s[1], s[5] - at * s[4]

    (a, b, miss_l), (c, d, miss_r) = line(left), line(right)
    meet = (a - c) / (d - b)
    free = np.where(enough & (meet > x[:-1]) & (meet <= at) & np.isfinite(miss_l + miss_r), miss_l + miss_r, np.inf)
    (lp, lpp, lpy), (rp, rpp, rpy) = hinge(left), hinge(right)
    level = (whole[4] - lp * lpy / lpp - rp * rpy / rpp) / (whole[1] - lp * lp / lpp - rp * rp / rpp)
    blue, red = (lpy - level * lp) / lpp, (rpy - level * rp) / rpp
    held = whole[6] - level * whole[4] - blue * lpy - red * rpy
    held = np.where(enough & np.isfinite(held), held, np.inf)
    if not len(at):
        return None
    i, j = int(np.argmin(free)), int(np.argmin(held))
    if free[i] <= held[j]:
        return (a[i] + b[i] * meet[i], b[i], d[i], meet[i]) if np.isfinite(free[i]) else None
    return level[j], blue[j], red[j], at[j]


def fitted(x: np.ndarray, flux: np.ndarray, ivar: np.ndarray, start: tuple | None, steps: int) -> tuple | None:
    """Least squares in flux, weighted by ivar, over the given pixels.

    Each step takes the logarithm of the model as linear around the fit before, which
    makes it a ``two_lines`` problem, and counts if the misfit falls.  The first fit is
    one in the logarithm of the flux.
    """
    if start is None:
        use = flux > 0
        start = two_lines(x[use], np.log(flux[use]), ivar[use] * flux[use] ** 2)
    if start is None:
        return None

    def misfit(fit):
        return (ivar * (flux - np.exp(_broken_model(x, fit))) ** 2).sum()

    least = misfit(start)
    for _ in range(steps):
        level = _broken_model(x, start)
        model = np.exp(level)
        tried = two_lines(x, level + (flux - model) / model, ivar * model ** 2)
        reached = np.nan if tried is None else misfit(tried)
        if not reached < least:
            break
        start, least = tried, reached
    return start


def _named(fit: tuple, origin: float) -> dict:
    level, blue, red, at = fit
    return {"amplitude": float(np.exp(level)), "blue_index": float(-blue), "red_index": float(-red),
            "break_wave": float(np.exp(at + origin))}


def broken_power_law_of(wave: np.ndarray, flux: np.ndarray, ivar: np.ndarray, limit: float,
                        origin: float, steps: int, once: bool = False) -> dict | None:
    """None where no break has two pixels on both sides; ``once``: without clipping."""
    order = np.argsort(wave, kind="stable")
    x, flux, ivar = np.log(wave[order]) - origin, flux[order], ivar[order]
    kept = (ivar > 0) & (flux >= 0) & np.isfinite(ivar) & np.isfinite(flux) & np.isfinite(x)

    def refit(start):
        return fitted(x[kept], flux[kept], ivar[kept], start, steps)

    newest = refit(None)
    if newest is None:
        return None
    fits, best = [newest], None
    while not once:
        model = np.exp(_broken_model(x, newest))
        kept = kept & _flags(flux, ivar, model, limit)
        chi2 = float(((flux[kept] - model[kept]) ** 2 * ivar[kept]).sum()) if kept.any() else np.nan
        if best is not None and (_near(chi2, best) or not chi2 < best):
            fits.pop()  # the newest fit is no gain
            break
        best = 0.0 if np.isnan(chi2) else chi2
        newest = refit(newest)
        fits.append(newest)
    clips = [_named(f, origin) for f in fits]
    return {**clips[-1], "clips": clips}


def fitter(fit: Callable, schema: pa.Schema) -> Callable:
    """Task over rows (SPECID, wave, flux, ivar); the columns of ``schema`` come out."""
    def numbers(column: pa.Array, row: int) -> np.ndarray:
        return pc.fill_null(column[row].values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for batch in batches:
                ids, found = batch.column("SPECID").to_pylist(), []
                for i, spec in enumerate(ids):
                    one = fit(*[numbers(batch.column(c), i) for c in ("wave", "flux", "ivar")])
                    if one is not None:
                        found.append({"SPECID": spec, **one})
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return work
