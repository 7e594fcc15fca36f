"""Peak finding and candidate queries (K, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpeak.functions.constants import LINES
from lumenpeak.functions.shared import fresh_path, written
from lumenpeak.operators import candidates as C
from lumenpeak.operators import continuum as K
from lumenpeak.operators import peaks as P
from lumenpeak.plans import jobs
from lumenpeak.plans.params import JobParams, peak_finder
from lumenpeak.sources.writers import to_spectra
from workload.views import (MEMBERS, METRICS, MIN_SIG, PIXELS, TRIALS, TRUTH, WIDTH, lines_sql,
                            num, peaks_sql, pixels, query, rounded, rounded_sql, smoothed_sql,
                            table, truth, truth_flags_sql, with_ctes)

PEAKS_CTES = (PIXELS, peaks_sql())


def found_peaks(spark, sf):
    return P.find_peaks(pixels(spark, sf), WIDTH, MIN_SIG)


def trials_of(spark, sf):
    return C.trial_redshifts(found_peaks(spark, sf))


@query("c6_gaussian_smoothing", rounded_sql(with_ctes(PIXELS) + f"""
SELECT SPECID, pix, {smoothed_sql(WIDTH)} AS smoothed FROM pixels
WINDOW w AS (PARTITION BY SPECID ORDER BY pix)""", "smoothed"))
def c6(spark, sf):
    return rounded(P.smooth(pixels(spark, sf), WIDTH).select("SPECID", "pix", "smoothed"))


@query("k1_local_maxima", rounded_sql(with_ctes(PIXELS, peaks_sql()) + """
SELECT SPECID, pix, smoothed FROM framed WHERE smoothed > before AND smoothed > after""",
                                      "smoothed"))
def k1(spark, sf):
    return rounded(P.local_maxima(pixels(spark, sf), WIDTH).select("SPECID", "pix", "smoothed"))


@query("k2_window_significance", rounded_sql(with_ctes(PIXELS, peaks_sql(WIDTH, -1e300)) + """
SELECT SPECID, pix, significance FROM peaks""", "significance"))
def k2(spark, sf):
    return rounded(P.find_peaks(pixels(spark, sf), WIDTH, None).select(
        "SPECID", "pix", "significance"))


@query("k3_significant_peaks", rounded_sql(with_ctes(*PEAKS_CTES) + """
SELECT SPECID, pix, wave, significance FROM peaks""", "significance"))
def k3(spark, sf):
    return rounded(found_peaks(spark, sf), "significance")


def power_law_sql(min_sig: float, rounds: int) -> str:
    """The clip-and-refit loop, unrolled; a settled spectrum stays as it is."""
    m = num(min_sig)
    keep = f"coalesce(abs(flux - f.a * pow(wave, -f.b)) * sqrt(ivar) < {m}, false)"
    parts = [PIXELS, """mask0 AS (SELECT *, true AS kept FROM pixels)""",
             """fit0 AS (SELECT SPECID, 0.0e0 AS a, 0.0e0 AS b, false AS done, true AS bad
  FROM pixels GROUP BY SPECID)"""]
    for i in range(rounds):
        parts.append(f"""sum{i} AS (SELECT SPECID, count(w) AS n, sum(w) AS sw, sum(w*x) AS sx,
    sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, avg(flux) AS ma,
    avg(flux) FILTER (w IS NOT NULL) AS mu
  FROM (SELECT SPECID, flux, CASE WHEN kept AND flux > 0 AND ivar > 0 THEN ivar * ivar END AS w,
        ln(wave) - 8.5e0 AS x, CASE WHEN flux > 0 THEN ln(flux) END AS y FROM mask{i})
  GROUP BY SPECID)""")
        parts.append(f"""raw{i} AS (SELECT *, CASE WHEN sxx*sw - sx*sx <> 0
    THEN (sxy*sw - sx*sy) / (sxx*sw - sx*sx) END AS slope FROM sum{i})""")
        parts.append(f"""new{i} AS (SELECT SPECID, ma,
    CASE WHEN n < 3 THEN ma WHEN isfinite(exp((sy - slope*sx)/sw - slope*8.5e0))
      AND exp((sy - slope*sx)/sw - slope*8.5e0) > 0
      THEN exp((sy - slope*sx)/sw - slope*8.5e0) ELSE mu END AS na,
    CASE WHEN n >= 3 AND isfinite(exp((sy - slope*sx)/sw - slope*8.5e0))
      AND exp((sy - slope*sx)/sw - slope*8.5e0) > 0 THEN -slope ELSE 0.0e0 END AS nb
  FROM raw{i})""")
        parts.append(f"""ok{i} AS (SELECT SPECID, coalesce(na <= 0, true) AS nbad,
    CASE WHEN coalesce(na <= 0, true) THEN ma ELSE na END AS na,
    CASE WHEN coalesce(na <= 0, true) THEN 0.0e0 ELSE nb END AS nb FROM new{i})""")
        parts.append(f"""step{i} AS (SELECT SPECID, a, b, bad, na, nb, nbad, done OR
    (abs(a - na) <= 1e-8 + 1e-5 * abs(na) AND abs(b - nb) <= 1e-8 + 1e-5 * abs(nb)) AS done
  FROM fit{i} JOIN ok{i} USING (SPECID))""")
        parts.append(f"""fit{i + 1} AS MATERIALIZED (SELECT SPECID,
    CASE WHEN done THEN a ELSE na END AS a,
    CASE WHEN done THEN b ELSE nb END AS b, CASE WHEN done THEN bad ELSE nbad END AS bad, done
  FROM step{i})""")
        parts.append(f"""mask{i + 1} AS MATERIALIZED (SELECT p.SPECID, pix, wave, flux, ivar,
    kept AND (f.done OR f.bad OR {keep}) AS kept
  FROM mask{i} p JOIN fit{i + 1} f USING (SPECID))""")
    return ",\n".join(parts)


# With these tables most fits settle after a few rounds.
CLIP, ROUNDS = 40.0, 18
FITS_SQL = power_law_sql(CLIP, ROUNDS)
RUNS_SQL = f"""above AS (SELECT p.SPECID, pix, CASE WHEN f.bad THEN 0.0e0
    ELSE abs(flux - f.a * pow(wave, -f.b)) * sqrt(ivar) END AS sig
  FROM mask{ROUNDS} p JOIN fit{ROUNDS} f USING (SPECID)
  WHERE NOT kept AND flux > f.a * pow(wave, -f.b)),
islands AS (SELECT *, pix - row_number() OVER (PARTITION BY SPECID ORDER BY pix) AS g FROM above),
runs AS (SELECT SPECID, CASE WHEN count(*) = 1 THEN min(pix)
    ELSE round_even(sum(pix * sig) / sum(sig), 0)::BIGINT END AS pix, sum(sig) AS significance
  FROM islands GROUP BY SPECID, g)"""


def stored_pixels(spark, sf):
    """Pixels as a table, read by more than one step."""
    return written(pixels(spark, sf), "pixels")


@query("k4_power_law_fit", rounded_sql(f"WITH {FITS_SQL}\n" + f"""
SELECT SPECID, ln(a) AS log_amplitude, b AS power_index FROM fit{ROUNDS}""",
                                       "log_amplitude", "power_index"))
def k4(spark, sf):
    fits = K.fit_power_law(stored_pixels(spark, sf), CLIP)
    return rounded(fits.select("SPECID", F.ln("amplitude").alias("log_amplitude"),
                               "power_index"))


@query("k5_pixels_above_fit", rounded_sql(f"WITH {FITS_SQL},\n{RUNS_SQL}\n" + """
SELECT SPECID, pix, sig AS significance FROM above""", "significance"))
def k5(spark, sf):
    source = stored_pixels(spark, sf)
    return rounded(K.power_law_pixels(source, K.fit_power_law(source, CLIP), CLIP))


@query("k6_compressed_peaks", rounded_sql(f"WITH {FITS_SQL},\n{RUNS_SQL}\n" + """
SELECT SPECID, r.pix, wave, significance FROM runs r JOIN pixels p USING (SPECID, pix)""",
                                          "significance"))
def k6(spark, sf):
    return rounded(K.find_power_law_peaks(stored_pixels(spark, sf), CLIP), "significance")


# Slopes of short segments lose digits to cancellation; so many decimals are compared.
BROKEN_DIGITS, ABOVE_DIGITS = 2, 3
# A broken fit in SQL is a struct: level at the break, slopes on its two sides, and the break,
# all in logarithms.
_LINES = {"n": "count(*)", "sw": "sum(w)", "sx": "sum(w*x)", "sxx": "sum(w*x*x)", "sz": "sum(w*z)",
          "sxz": "sum(w*x*z)", "szz": "sum(w*z*z)"}


def two_lines_sql(name: str, points: str) -> list[str]:
    """CTE ``name`` (SPECID, fit): the best continuous pair of lines through points (SPECID, x, z, w)."""
    left = ", ".join(f"{sql} OVER l AS l_{c}, {sql} OVER r AS r_{c}" for c, sql in _LINES.items())
    fits = ", ".join(f"({s}_sw*{s}_sxz - {s}_sx*{s}_sz) / ({s}_sw*{s}_sxx - {s}_sx*{s}_sx) AS m_{s}, "
                     f"{s}_sx - x*{s}_sw AS p_{s}, {s}_sxx - 2*x*{s}_sx + x*x*{s}_sw AS pp_{s}, "
                     f"{s}_sxz - x*{s}_sz AS pz_{s}" for s in "lr")
    return [f"""{name}a AS (SELECT SPECID, x, lag(x) OVER (PARTITION BY SPECID ORDER BY x) AS x0, {left} FROM ({points})
  WINDOW l AS (PARTITION BY SPECID ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    r AS (PARTITION BY SPECID ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
            f"""{name}b AS (SELECT *, (l_sz - m_l*l_sx) / l_sw AS c_l, (r_sz - m_r*r_sx) / r_sw AS c_r,
    (l_sz + r_sz - p_l*pz_l/pp_l - p_r*pz_r/pp_r) / (l_sw + r_sw - p_l*p_l/pp_l - p_r*p_r/pp_r) AS lv
  FROM (SELECT *, {fits} FROM {name}a WHERE l_n >= 2 AND r_n >= 2))""",
            f"""{name}c AS (SELECT *, (c_l - c_r) / (m_r - m_l) AS br, (pz_l - lv*p_l) / pp_l AS h_l,
    (pz_r - lv*p_r) / pp_r AS h_r FROM {name}b)""",
            f"""{name}d AS (SELECT SPECID, x, 0 AS kind, {{'lv': c_l + m_l*br, 'm1': m_l, 'm2': m_r, 'br': br}} AS fit,
    l_szz - c_l*l_sz - m_l*l_sxz + r_szz - c_r*r_sz - m_r*r_sxz AS miss FROM {name}c WHERE br > x0 AND br <= x
  UNION ALL SELECT SPECID, x, 1, {{'lv': lv, 'm1': h_l, 'm2': h_r, 'br': x}},
    l_szz + r_szz - lv*(l_sz + r_sz) - h_l*pz_l - h_r*pz_r FROM {name}c)""",
            f"""{name} AS MATERIALIZED (SELECT SPECID, arg_min(fit, {{'miss': miss, 'kind': kind, 'x': x}}) AS fit
  FROM {name}d WHERE isfinite(miss) GROUP BY SPECID)"""]


def _log_model(f: str) -> str:
    return f"({f}.lv + CASE WHEN x < {f}.br THEN {f}.m1 ELSE {f}.m2 END * (x - {f}.br))"


def flux_steps_sql(i: str, mask: str, start: str) -> list[str]:
    """CTE ``fit{i}`` (SPECID, fit): least squares in flux over the kept pixels of ``mask``, from the fits of ``start``."""
    parts, now = [], start
    for k in range(K.FLUX_STEPS):
        name = f"s{i}_{k}"
        parts += [f"""{name}m AS MATERIALIZED (SELECT m.SPECID, x, flux, ivar, f.fit, {_log_model('f.fit')} AS lm
  FROM {mask} m JOIN {now} f USING (SPECID) WHERE kept)""",
                  *two_lines_sql(name, f"SELECT SPECID, x, lm + (flux - exp(lm)) / exp(lm) AS z, "
                                       f"ivar * exp(lm) * exp(lm) AS w FROM {name}m"),
                  f"""{name}g AS (SELECT m.SPECID, any_value(t.fit) AS fit, sum(ivar * (flux - exp(lm))**2) AS now,
    sum(ivar * (flux - exp({_log_model('t.fit')}))**2) AS next FROM {name}m m JOIN {name} t USING (SPECID) GROUP BY ALL)""",
                  f"""{name}f AS MATERIALIZED (SELECT SPECID, CASE WHEN g.next < g.now THEN g.fit ELSE f.fit END AS fit
  FROM {now} f LEFT JOIN {name}g g USING (SPECID))"""]
        now = f"{name}f"
    return [*parts, f"fit{i} AS (SELECT * FROM {now})"]


def first_broken_sql() -> list[str]:
    return [PIXELS, f"""mask0 AS MATERIALIZED (SELECT *, ln(wave) - {num(K.LOG_ORIGIN)} AS x,
    coalesce(ivar > 0 AND flux >= 0, false) AS kept FROM pixels)""",
            *two_lines_sql("start", "SELECT SPECID, x, ln(flux) AS z, ivar*flux*flux AS w FROM mask0 WHERE kept AND flux > 0"),
            *flux_steps_sql("0", "mask0", "start")]


@query("k7_broken_power_law_fit", rounded_sql("WITH " + ",\n".join(first_broken_sql()) + f"""
SELECT SPECID, exp(fit.br + {num(K.LOG_ORIGIN)}) AS break_wave, exp(fit.lv) AS amplitude, -fit.m1 AS blue_index,
  -fit.m2 AS red_index FROM fit0""", "break_wave", "amplitude", "blue_index", "red_index",
    digits=BROKEN_DIGITS))
def k7_fit(spark, sf):
    return rounded(K.fit_broken_power_law(pixels(spark, sf), once=True).select(
        "SPECID", "break_wave", "amplitude", "blue_index", "red_index"), digits=BROKEN_DIGITS)


def broken_loop_sql(min_sig: float, rounds: int) -> str:
    """The clip-and-refit loop of the broken law, unrolled.

    A fit whose chi squared is no gain is dropped again, so pixels carry the mask
    with (kept) and without (prev) the newest fit of their spectrum.
    """
    def below(f: str) -> str:
        return f"coalesce(abs(flux - exp({_log_model(f)})) * sqrt(ivar) < {num(min_sig)}, false)"

    parts = [*first_broken_sql(), """state1 AS (SELECT SPECID, fit, fit AS before, NULL::DOUBLE AS chi, false AS done
  FROM fit0)""",
             f"""mask1 AS MATERIALIZED (SELECT m.SPECID, pix, x, flux, ivar, kept AS prev,
    kept AND {below('s.fit')} AS kept FROM mask0 m JOIN state1 s USING (SPECID))"""]
    for i in range(1, rounds):
        parts += [f"""chi{i} AS (SELECT SPECID, sum(CASE WHEN kept THEN (flux - exp({_log_model('s.fit')}))**2 * ivar END) AS now
  FROM mask{i} m JOIN state{i} s USING (SPECID) GROUP BY SPECID)""",
                  f"""gain{i} AS MATERIALIZED (SELECT s.*, now, NOT done AND (chi IS NULL OR coalesce(
      abs(now - chi) > 1e-8 + 1e-5 * abs(chi) AND now < chi, false)) AS better
  FROM state{i} s JOIN chi{i} USING (SPECID))""",
                  f"better{i} AS (SELECT SPECID, fit FROM gain{i} WHERE better)",
                  *flux_steps_sql(str(i), f"mask{i}", f"better{i}"),
                  f"""state{i + 1} AS MATERIALIZED (SELECT g.SPECID,
    CASE WHEN done THEN g.fit WHEN better THEN coalesce(n.fit, g.fit) ELSE before END AS fit,
    CASE WHEN better THEN g.fit ELSE before END AS before,
    CASE WHEN better THEN coalesce(now, 0) ELSE chi END AS chi,
    done OR NOT better AS done, NOT done AND NOT better AS back, better AS moved
  FROM gain{i} g LEFT JOIN fit{i} n USING (SPECID))""",
                  f"""mask{i + 1} AS MATERIALIZED (SELECT m.SPECID, pix, x, flux, ivar,
    CASE WHEN moved THEN kept ELSE prev END AS prev,
    CASE WHEN moved THEN kept AND {below('s.fit')} WHEN back THEN prev ELSE kept END AS kept
  FROM mask{i} m JOIN state{i + 1} s USING (SPECID))"""]
    parts.append(f"""above AS (SELECT m.SPECID, pix, abs(flux - exp({_log_model('s.fit')})) * sqrt(ivar) AS sig
  FROM mask{rounds} m JOIN state{rounds} s USING (SPECID)
  WHERE NOT kept AND flux > exp({_log_model('s.fit')}))""")
    return ",\n".join(parts)


BROKEN_ROUNDS = 12


@query("k7_broken_power_law_peaks", rounded_sql(
    f"WITH {broken_loop_sql(CLIP, BROKEN_ROUNDS)},\n{RUNS_SQL[RUNS_SQL.index('islands AS'):]}\n" + """
SELECT SPECID, r.pix, wave, significance FROM runs r JOIN pixels p USING (SPECID, pix)""",
    "significance", digits=ABOVE_DIGITS))
def k7(spark, sf):
    return rounded(K.find_broken_power_law_peaks(stored_pixels(spark, sf), CLIP), "significance", digits=ABOVE_DIGITS)


@query("k8_chosen_peak_finder", with_ctes(PIXELS, peaks_sql(WIDTH, 60.0)) + """
SELECT SPECID, count(*) AS n_peaks FROM peaks GROUP BY SPECID""")
def k8(spark, sf):
    finder = peak_finder("smoothing", {"width": WIDTH, "min_significance": 60.0})
    return finder(pixels(spark, sf)).groupBy("SPECID").agg(F.count("*").alias("n_peaks"))


# --- candidates -------------------------------------------------------------


@query("d1_repeated_ids", with_ctes(*PEAKS_CTES, TRIALS) + """
SELECT SPECID // 2 AS SPECID, count(DISTINCT SPECID) AS n_spectra, count(*) FILTER (n = 0) AS n_none, sum(n)::BIGINT AS n_tried
FROM (SELECT SPECID, count(try_order) AS n FROM (SELECT DISTINCT SPECID FROM pixels) LEFT JOIN trials USING (SPECID)
  GROUP BY SPECID) GROUP BY ALL""")
def repeated_ids(spark, sf):
    """Two spectra of each object, equal in all metadata, are treated one by one."""
    spectra = to_spectra(pixels(spark, sf)).withColumn("SPECID", F.expr("SPECID div 2"))
    params = JobParams(mode="candidates", peak_finder_options={"width": WIDTH, "min_significance": MIN_SIG})
    none = F.col("ASSUMED_LINE") == "none"
    return jobs.find_candidates(spectra, params).groupBy("SPECID").agg(
        F.countDistinct("SPECTRUM").alias("n_spectra"), F.count_if(none).alias("n_none"),
        F.count_if(~none).alias("n_tried"))


@query("d1_trial_redshifts", rounded_sql(with_ctes(*PEAKS_CTES, TRIALS) + """
SELECT SPECID, peak_pix, try_order, ASSUMED_LINE, Z_TRY, PEAK_SIGNIFICANCE FROM trials""",
                                         "Z_TRY", "PEAK_SIGNIFICANCE"))
def d1(spark, sf):
    return rounded(trials_of(spark, sf).drop("assumed_index"))


@query("d2_interval_members", rounded_sql(with_ctes(*PEAKS_CTES, TRIALS, MEMBERS) + """
SELECT SPECID, peak_pix, try_order, line_index, band, count(*) AS n, sum(flux) AS flux,
  sum(ivar) AS ivar FROM members GROUP BY ALL""", "ivar"))
def d2(spark, sf):
    source = stored_pixels(spark, sf)
    members = C.interval_members(
        source, C.trial_redshifts(P.find_peaks(source, WIDTH, MIN_SIG)))
    return rounded(members.groupBy(*C.CANDIDATE_KEY, "line_index", "band").agg(
        F.count("*").alias("n"), F.sum("flux").alias("flux"), F.sum("ivar").alias("ivar")), "ivar")


def metrics_of(spark, sf):
    source = stored_pixels(spark, sf)
    return C.line_metrics(source, C.trial_redshifts(P.find_peaks(source, WIDTH, MIN_SIG)))


METRIC_CTES = (*PEAKS_CTES, TRIALS, MEMBERS, METRICS)


@query("d3_line_metrics", rounded_sql(with_ctes(*METRIC_CTES) + """
SELECT SPECID, peak_pix, try_order, line_index, ratio, ratio_sn, ratio2 FROM metrics""",
                                      "ratio", "ratio_sn", "ratio2"))
def d3(spark, sf):
    return rounded(metrics_of(spark, sf))


def _wide_sql() -> str:
    columns = ",\n".join(
        f"(round(max({k}) FILTER (m.line_index = {i}), 6) + 0.0)::DOUBLE "
        f"AS {line[0].upper()}_{k.upper()}"
        for i, line in enumerate(LINES) for k in ("ratio", "ratio_sn", "ratio2"))
    return f"""SELECT SPECID, peak_pix, try_order, {columns},
  (round(any_value(Z_TRY), 6) + 0.0)::DOUBLE AS Z_TRY,
  (round(any_value(PEAK_SIGNIFICANCE), 6) + 0.0)::DOUBLE AS PEAK_SIGNIFICANCE,
  any_value(ASSUMED_LINE) AS ASSUMED_LINE
FROM trials t LEFT JOIN metrics m USING (SPECID, peak_pix, try_order)
GROUP BY SPECID, peak_pix, try_order"""


def wide_table(spark, sf):
    source = stored_pixels(spark, sf)
    peaks = written(P.find_peaks(source, WIDTH, MIN_SIG), "peaks")
    trials = C.trial_redshifts(peaks)
    return peaks, C.measured_candidates(source, trials)


@query("d4_candidate_table", with_ctes(*METRIC_CTES) + _wide_sql())
def d4(spark, sf):
    return rounded(wide_table(spark, sf)[1])


@query("d5_unpeaked_spectra", with_ctes(PIXELS, peaks_sql(WIDTH, 90.0), TRIALS, TRUTH) + """
SELECT SPECID, ASSUMED_LINE, Z_TRY IS NULL AS unmeasured, count(*) AS n FROM (
  SELECT SPECID, ASSUMED_LINE, Z_TRY FROM trials UNION ALL
  SELECT SPECID, 'none', NULL FROM truth WHERE SPECID NOT IN (SELECT SPECID FROM peaks))
GROUP BY ALL""")
def d5(spark, sf):
    peaks = P.find_peaks(pixels(spark, sf), WIDTH, 90.0)
    trials = C.trial_redshifts(peaks).drop("assumed_index")
    return (C.with_unpeaked(trials, truth(spark, sf), peaks)
            .groupBy("SPECID", "ASSUMED_LINE", F.col("Z_TRY").isNull().alias("unmeasured"))
            .agg(F.count("*").alias("n")))


NEAR = 4


def _near_sql() -> str:
    columns = []
    for k in range(-NEAR, NEAR):
        move = (lambda c: c if k == 0 else f"lag({c}, {-k}) OVER w" if k < 0
                else f"lead({c}, {k}) OVER w")
        columns += [f'{move("flux")} AS "FLUX_{k}"',
                    f'(round({move("ivar")}, 6) + 0.0)::DOUBLE AS "IVAR_{k}"']
    return f"""SELECT n.* FROM (SELECT SPECID, pix AS peak_pix, {', '.join(columns)} FROM pixels
  WINDOW w AS (PARTITION BY SPECID ORDER BY pix)) n
SEMI JOIN peaks k ON n.SPECID = k.SPECID AND n.peak_pix = k.pix"""


@query("d6_pixel_metrics", with_ctes(*PEAKS_CTES) + _near_sql())
def d6(spark, sf):
    return rounded(C.pixel_metrics(pixels(spark, sf), found_peaks(spark, sf), NEAR))


TRUTH_CTES = (*PEAKS_CTES, TRIALS, TRUTH, lines_sql(),
              "known AS (SELECT t.*, Z_TRUE, CLASS_PERSON FROM trials t JOIN truth USING (SPECID))",
              truth_flags_sql("known", "flagged"))


def flagged(spark, sf):
    known = trials_of(spark, sf).join(
        truth(spark, sf).select("SPECID", "Z_TRUE", "CLASS_PERSON"), "SPECID")
    return C.with_truth(known)


_KEY = "SPECID, peak_pix, try_order"


@query("d7_redshift_error", rounded_sql(with_ctes(*TRUTH_CTES) + f"""
SELECT {_KEY}, DELTA_Z FROM flagged""", "DELTA_Z"))
def d7(spark, sf):
    return rounded(flagged(spark, sf).select(*C.CANDIDATE_KEY, "DELTA_Z"))


for _id, _column in (("d8_correct_redshift", "CORRECT_REDSHIFT"), ("d9_is_correct", "IS_CORRECT"),
                     ("d10_is_line", "IS_LINE")):
    query(_id, with_ctes(*TRUTH_CTES) + f"SELECT {_KEY}, {_column} FROM flagged")(
        lambda spark, sf, column=_column: flagged(spark, sf).select(*C.CANDIDATE_KEY, column))


@query("d11_truth_required", with_ctes(TRUTH) + """
SELECT CLASS_PERSON, count(*) AS n FROM truth GROUP BY CLASS_PERSON""")
def d11(spark, sf):
    known = truth(spark, sf)
    C.require_truth(known)
    try:
        C.require_truth(known.drop("Z_TRUE"))
    except ValueError:
        return known.groupBy("CLASS_PERSON").agg(F.count("*").alias("n"))
    raise AssertionError("a table without Z_TRUE must be refused")


def uneven_spectra(spark, sf):
    """Array spectra, some with arrays of unequal length or none at all."""
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("SPECID"), "label", values.alias("flux"),
        F.transform(values, lambda v, i: 3600.0 + 90.0 * i).alias("wave"),
        F.when(F.col("vec_id") % 7 == 0, F.slice(values, 1, 60))
        .when(F.col("vec_id") % 11 != 0, F.transform(values, lambda v: F.lit(1.0))).alias("ivar"))


@query("d12_bad_spectra", """SELECT label, (vec_id % 7 <> 0 AND vec_id % 11 <> 0) AS usable,
  count(*) AS n FROM embeddings GROUP BY ALL""")
def d12(spark, sf):
    good, bad = C.split_valid(uneven_spectra(spark, sf))
    both = good.withColumn("usable", F.lit(True)).unionByName(
        bad.withColumn("usable", F.lit(False)))
    return both.groupBy("label", "usable").agg(F.count("*").alias("n"))


@query("d13_merged_tables", rounded_sql(with_ctes(*PEAKS_CTES, TRIALS) + """
SELECT SPECID, peak_pix, try_order, Z_TRY, PEAK_SIGNIFICANCE FROM trials WHERE try_order < 3
UNION ALL SELECT SPECID, peak_pix, try_order, Z_TRY, NULL FROM trials WHERE try_order >= 3""",
                                        "Z_TRY", "PEAK_SIGNIFICANCE"))
def d13(spark, sf):
    trials = trials_of(spark, sf).select(*C.CANDIDATE_KEY, "Z_TRY", "PEAK_SIGNIFICANCE")
    return rounded(C.merged([trials.where("try_order < 3"),
                             trials.where("try_order >= 3").drop("PEAK_SIGNIFICANCE")]))


@query("d13_file_manifest", with_ctes(*PEAKS_CTES, TRIALS) + """
SELECT CASE WHEN try_order < 3 THEN 'a' ELSE 'b' END AS folder, 'read' AS state, 1::BIGINT AS n_files, count(*)::BIGINT AS n_rows,
  count(*)::BIGINT AS merged_rows FROM trials GROUP BY ALL
UNION ALL SELECT 'c', 'damaged', 1, 0, 0 UNION ALL SELECT 'd', 'empty', 1, 0, 0""")
def file_manifest(spark, sf):
    """Four candidate files are merged, one of them damaged and one without rows."""
    trials = written(trials_of(spark, sf).select(*C.CANDIDATE_KEY, "Z_TRY"), "trials")
    folder = fresh_path(spark, "merged")
    for name, part in (("a", trials.where("try_order < 3")), ("b", trials.where("try_order >= 3")),
                       ("d", trials.where("false"))):
        part.coalesce(1).write.parquet(f"{folder}/{name}")
    spark.range(1).selectExpr("'no footer' AS value").coalesce(1).write.text(f"{folder}/c")
    paths = [f"{folder}/{name}" for name in "abcd"]
    result = jobs.merge_files(spark, JobParams(mode="merge"), f"{folder}/out", paths)
    given = result.candidates.select(F.when(F.col("TRY_ORDER") < 3, "a").otherwise("b").alias("folder")).groupBy(
        "folder").agg(F.count("*").alias("merged_rows"))
    name = F.element_at(F.split("file", "/"), -2)
    return result.files.groupBy(name.alias("folder"), "state").agg(
        F.count("*").alias("n_files"), F.sum("rows_read").alias("n_rows")).join(given, "folder", "left").fillna(
        0, ["merged_rows"])


@query("best_peak_candidate", rounded_sql(with_ctes(*METRIC_CTES) + """
SELECT b.*, count(m.line_index) AS n_lines, avg(ratio) AS mean_ratio FROM (
  SELECT SPECID, peak_pix, try_order, ASSUMED_LINE, Z_TRY, PEAK_SIGNIFICANCE FROM (
    SELECT *, row_number() OVER (PARTITION BY SPECID
      ORDER BY PEAK_SIGNIFICANCE DESC, peak_pix, try_order) AS r FROM trials) WHERE r = 1) b
LEFT JOIN metrics m USING (SPECID, peak_pix, try_order) GROUP BY ALL""",
                                          "Z_TRY", "PEAK_SIGNIFICANCE", "mean_ratio"))
def flagship(spark, sf):
    """Peaks -> trial redshifts -> most significant candidate per spectrum -> its line metrics."""
    from lumenpeak.operators.pixels import first_per_key

    source = stored_pixels(spark, sf)
    trials = C.trial_redshifts(written(P.find_peaks(source, WIDTH, MIN_SIG), "peaks"))
    best = written(first_per_key(trials.drop("assumed_index"), ["SPECID"],
                                 [F.col("PEAK_SIGNIFICANCE").desc(), F.col("peak_pix"), F.col("try_order")]), "best")
    metrics = C.line_metrics(source, best).groupBy(*C.CANDIDATE_KEY).agg(
        F.count("*").alias("n_lines"), F.avg("ratio").alias("mean_ratio"))
    return rounded(best.join(metrics, list(C.CANDIDATE_KEY), "left").fillna(0, ["n_lines"]))
