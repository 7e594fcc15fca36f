"""Evaluation queries (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpeak.functions.constants import (LINES, PROB_GRID, REPORT_CUTS, SIGNIFICANCE_CUTS,
                                           VELOCITY_EDGES)
from lumenpeak.operators import candidates as C
from lumenpeak.operators import reports as R
from lumenpeak.operators import statistics as S
from workload.views import (CUSTOMER_TRUTH, PIXELS, SCORED, TRUTH, customer_truth, lines_sql, num,
                            orders_candidates, pixels, query, rounded, rounded_sql, scored, truth,
                            with_ctes)

MAG_CUTS = [18.0, 19.05, 20.0, 21.5, 22.5]
MAG_BINS = [17.0, 18.5, 19.5, 20.5, 22.0]


def array_sql(values) -> str:
    return "[" + ", ".join(num(v) for v in values) + "]"


def _try(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) END"


COMPLETENESS_SQL = """comp AS (SELECT count(*) AS num_quasars,
    count(*) FILTER (Z_TRUE >= 1) AS num_quasars_zge1,
    count(*) FILTER (Z_TRUE >= 2.1e0) AS num_quasars_zge2_1,
    count(*) FILTER (hit) AS found_quasars, count(*) FILTER (hit AND Z_TRUE >= 1) AS found_quasars_zge1,
    count(*) FILTER (hit AND Z_TRUE >= 2.1e0) AS found_quasars_zge2_1
  FROM (SELECT q.*, SPECID IN (SELECT SPECID FROM {0} WHERE IS_CORRECT) AS hit FROM qso q))"""

COMPLETENESS_COLUMNS = ", ".join(
    f"{_try('found_quasars' + s, 'num_quasars' + s)} AS completeness{s}"
    for s in ("", "_zge1", "_zge2_1"))
PURITY_COUNTS = """count(*) AS num_candidates, count(*) FILTER (IS_CORRECT) AS num_correct,
  count(*) FILTER (Z_TRUE >= 1) AS num_zge1, count(*) FILTER (IS_CORRECT AND Z_TRUE >= 1) AS correct_zge1,
  count(*) FILTER (Z_TRUE >= 2.1e0) AS num_zge2_1,
  count(*) FILTER (IS_CORRECT AND Z_TRUE >= 2.1e0) AS correct_zge2_1,
  count(*) FILTER (IS_LINE) AS num_line"""
PURITY_COLUMNS = ", ".join(f"{_try(a, b)} AS {c}" for a, b, c in (
    ("num_correct", "num_candidates", "purity"), ("correct_zge1", "num_zge1", "purity_zge1"),
    ("correct_zge2_1", "num_zge2_1", "purity_zge2_1"),
    ("num_line", "num_candidates", "line_purity")))


@query("f1_completeness", rounded_sql(
    with_ctes(SCORED, CUSTOMER_TRUTH, COMPLETENESS_SQL.format("scored"))
    + f"SELECT *, {COMPLETENESS_COLUMNS} FROM comp",
    "completeness", "completeness_zge1", "completeness_zge2_1"))
def f1(spark, sf):
    return rounded(S.completeness(customer_truth(spark, sf), scored(spark, sf)))


@query("f2_purity", rounded_sql(
    with_ctes(SCORED) + f"SELECT *, {PURITY_COLUMNS} FROM (SELECT {PURITY_COUNTS} FROM scored)",
    "purity", "purity_zge1", "purity_zge2_1", "line_purity"))
def f2(spark, sf):
    return rounded(S.purity(scored(spark, sf)))


@query("f3_probability_report", rounded_sql(with_ctes(
    SCORED, CUSTOMER_TRUTH,
    f"""cuts AS (SELECT 0 AS step, NULL::DOUBLE AS prob_cut UNION ALL
  SELECT i, {array_sql(REPORT_CUTS)}[i] FROM range(1, {len(REPORT_CUTS) + 1}) t(i))""",
    """picked AS (SELECT c.step, c.prob_cut, s.* FROM cuts c JOIN scored s ON step = 0
  OR (PROB > prob_cut AND NOT DUPLICATED AND Z_CONF_PERSON = 3))""",
    f"""pure AS (SELECT step, {PURITY_COUNTS} FROM picked GROUP BY step)""",
    """hits AS (SELECT step, count(*) AS found_quasars, count(*) FILTER (Z_TRUE >= 1) AS found_quasars_zge1,
    count(*) FILTER (Z_TRUE >= 2.1e0) AS found_quasars_zge2_1
  FROM (SELECT DISTINCT step, q.SPECID, q.Z_TRUE FROM picked p JOIN qso q ON q.SPECID = p.SPECID
        WHERE IS_CORRECT) GROUP BY step)""",
    """totals AS (SELECT count(*) AS num_quasars, count(*) FILTER (Z_TRUE >= 1) AS num_quasars_zge1,
    count(*) FILTER (Z_TRUE >= 2.1e0) AS num_quasars_zge2_1 FROM qso)""",
    f"""joined AS (SELECT c.step, c.prob_cut, {', '.join(f'coalesce({c}, 0) AS {c}' for c in S._PURITY)},
    totals.*, {', '.join(f'coalesce(found_quasars{s}, 0) AS found_quasars{s}'
                         for s in ('', '_zge1', '_zge2_1'))}
  FROM cuts c CROSS JOIN totals LEFT JOIN pure USING (step) LEFT JOIN hits USING (step))""")
    + f"SELECT *, {PURITY_COLUMNS}, {COMPLETENESS_COLUMNS} FROM joined",
    "prob_cut", "purity", "purity_zge1", "purity_zge2_1", "line_purity", "completeness",
    "completeness_zge1", "completeness_zge2_1"))
def f3(spark, sf):
    return rounded(S.probability_report(customer_truth(spark, sf), scored(spark, sf)))


def sweep_sql(mags: list[float] | None) -> str:
    """CTE sweep: one row per (mag_cut, prob); every cut filters the whole table."""
    mag_list = [*(mags or []), None]
    mag_rows = ", ".join(f"({i}, {'NULL' if m is None else num(m)})"
                         for i, m in enumerate(mag_list))
    true = {"": "true", "_zge2_1": "Z_TRUE >= 2.1e0", "_zlt2_1": "Z_TRUE < 2.1e0"}
    quasar = "CLASS_PERSON IN (3, 30)"
    parts = [
        f"mags(mag_index, mag_cut) AS (SELECT i, m::DOUBLE FROM (VALUES {mag_rows}) t(i, m))",
        f"""probs AS (SELECT i AS prob_index, {array_sql(PROB_GRID)}[i + 1] AS cut
  FROM range({len(PROB_GRID)}) t(i))""",
        f"""nq AS (SELECT mag_index, {', '.join(
            f'(count(*) FILTER ({c}))::DOUBLE AS num_quasars{s}' for s, c in true.items())}
  FROM mags JOIN qso ON mag_cut IS NULL OR R_MAG <= mag_cut GROUP BY mag_index)""",
        f"""raw AS (SELECT g.mag_index, mag_cut, g.prob_index, g.cut AS prob, count(s.SPECID) AS r,
    count(*) FILTER (Z_TRY >= 2.1e0) AS rh, count(*) FILTER (Z_TRY < 2.1e0) AS rl,
    count(*) FILTER (IS_CORRECT AND {quasar}) AS g,
    count(*) FILTER (IS_CORRECT AND {quasar} AND Z_TRUE >= 2.1e0) AS gh,
    count(*) FILTER (IS_CORRECT AND {quasar} AND Z_TRUE < 2.1e0) AS gl,
    count(*) FILTER ({quasar} AND Z_TRUE >= 2.1e0 AND Z_TRY >= 2.1e0) AS ah,
    count(*) FILTER ({quasar} AND Z_TRUE < 2.1e0 AND Z_TRY < 2.1e0) AS al,
    count(*) FILTER (IS_CORRECT AND Z_TRUE >= 2.1e0 AND Z_TRY < 2.1e0) AS up,
    count(*) FILTER (IS_CORRECT AND Z_TRUE < 2.1e0 AND Z_TRY >= 2.1e0) AS down
  FROM (SELECT * FROM mags, probs) g LEFT JOIN (SELECT * FROM scored WHERE NOT DUPLICATED) s
    ON PROB >= g.cut AND (mag_cut IS NULL OR R_MAG <= mag_cut)
  GROUP BY g.mag_index, mag_cut, g.prob_index, g.cut)""",
        """sides AS (SELECT mag_index, mag_cut, prob_index, prob, num_quasars, num_quasars_zge2_1,
    num_quasars_zlt2_1, r::DOUBLE AS num_candidates, (rh + up - down)::DOUBLE AS num_candidates_zge2_1,
    (rl - up + down)::DOUBLE AS num_candidates_zlt2_1, g::DOUBLE AS found,
    (CASE WHEN rh > 0 THEN gh ELSE 0 END)::DOUBLE AS found_zge2_1,
    (CASE WHEN rl > 0 THEN gl ELSE 0 END)::DOUBLE AS found_zlt2_1,
    ((CASE WHEN rh > 0 THEN ah ELSE 0 END) + up)::DOUBLE AS found_alt_zge2_1,
    ((CASE WHEN rl > 0 THEN al ELSE 0 END) + down)::DOUBLE AS found_alt_zlt2_1
  FROM raw JOIN nq USING (mag_index))""",
        "alts AS (SELECT *, found_alt_zge2_1 + found_alt_zlt2_1 AS found_alt FROM sides)",
    ]
    pc = ", ".join(
        f"num_quasars{s} - found{k}{s} AS missed{k}{s}, "
        f"{_try(f'found{k}{s}', f'num_candidates{s}')} AS purity{k}{s}, "
        f"{_try(f'found{k}{s}', f'num_quasars{s}')} AS completeness{k}{s}"
        for k in ("", "_alt") for s in S.SIDES)
    scores = ", ".join(
        _try(f"2.0e0 * purity{k}{s} * completeness{k}{s}", f"purity{k}{s} + completeness{k}{s}")
        + f" AS f1_score{k}{s}" for k in ("", "_alt") for s in S.SIDES)
    parts += [f"rates AS (SELECT *, {pc} FROM alts)", f"sweep AS (SELECT *, {scores} FROM rates)"]
    return ",\n".join(parts)


SWEEP_COLUMNS = S.sweep_columns()


@query("f4_threshold_sweep", rounded_sql(
    with_ctes(SCORED, CUSTOMER_TRUTH, sweep_sql(None))
    + f"SELECT prob_index, {', '.join(SWEEP_COLUMNS)} FROM sweep", *SWEEP_COLUMNS))
def f4(spark, sf):
    return rounded(S.threshold_sweep(scored(spark, sf), customer_truth(spark, sf)))


def optimal_sql(by_f1: bool, keys: str = "") -> str:
    parts = []
    lead = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys}" if keys else ""
    for case, s in S._CASES:
        score = f"f1_score{s}" if by_f1 else f"-abs(purity{s} - completeness{s})"

        def pick(value, kind, suffix):
            columns = ", ".join(f"{c}{kind}{s} AS {c}{suffix}"
                                for c in ("purity", "completeness", "f1_score"))
            return f"""(SELECT {lead}prob AS prob{suffix}, num_candidates{s} AS num_candidates{suffix},
  {columns} FROM (SELECT *, row_number() OVER ({over} ORDER BY {value} DESC NULLS LAST, prob_index) AS r
  FROM sweep) WHERE r = 1)"""

        on = f"USING ({keys})" if keys else "ON true"
        names = ", ".join(f"{c}{x}" for x in ("", "_alt") for c in (
            "prob", "num_candidates", "purity", "completeness", "f1_score"))
        parts.append(f"SELECT {lead}'{case}' AS \"case\", {names} FROM {pick(score, '', '')} a JOIN "
                     f"{pick(f'f1_score_alt{s}', '_alt', '_alt')} b {on}")
    return " UNION ALL ".join(parts)


OPTIMAL_COLUMNS = [f"{c}{x}" for x in ("", "_alt") for c in (
    "prob", "num_candidates", "purity", "completeness", "f1_score")]


@query("f5_optimal_threshold", rounded_sql(
    with_ctes(SCORED, CUSTOMER_TRUTH, sweep_sql(None)) + optimal_sql(True), *OPTIMAL_COLUMNS))
def f5(spark, sf):
    return rounded(S.optimal_threshold(
        S.threshold_sweep(scored(spark, sf), customer_truth(spark, sf))))


@query("f6_statistics_by_magnitude", rounded_sql(
    with_ctes(SCORED, CUSTOMER_TRUTH, sweep_sql(MAG_CUTS).replace(
        "sweep AS (SELECT *,", "sweep0 AS (SELECT *,")
        + ",\nsweep AS (SELECT * FROM sweep0 WHERE mag_cut IS NOT NULL)")
    + optimal_sql(False, "mag_cut"), *OPTIMAL_COLUMNS))
def f6(spark, sf):
    return rounded(S.statistics_by_magnitude(scored(spark, sf), customer_truth(spark, sf),
                                             MAG_CUTS))


def finder_sql(mags: list[float] | None) -> str:
    cut = (f"SELECT unnest({array_sql(mags)}) AS mag_cut" if mags
           else "SELECT NULL::DOUBLE AS mag_cut")
    keep = "(mag_cut IS NULL OR R_MAG <= mag_cut)"
    true = {"": "true", "_zge2_1": "Z_TRUE >= 2.1e0", "_zlt2_1": "Z_TRUE < 2.1e0"}
    near = "DELTA_Z BETWEEN -0.15e0 AND 0.15e0"
    high = "Z_TRUE >= 2.1e0 AND Z_TRY < 2.1e0"
    low = "Z_TRUE < 2.1e0 AND Z_TRY >= 2.1e0"
    good = f"CLASS_PERSON = 3 AND {near}"
    counts = [
        "count(*) FILTER (s.SPECID IS NOT NULL) AS num_entries",
        f"count(*) FILTER (Z_TRY >= 2.1e0) + count(*) FILTER ({high} AND {near}) "
        f"- count(*) FILTER ({low} AND {near}) AS num_entries_zge2_1",
        f"count(*) FILTER (Z_TRY < 2.1e0) - count(*) FILTER ({high} AND {near}) "
        f"+ count(*) FILTER ({low} AND {near}) AS num_entries_zlt2_1"]
    counts += [f"count(*) FILTER ({good} AND {c}) AS num_correct_entries{s}"
               for s, c in true.items()]
    counts += [f"count(DISTINCT s.SPECID) FILTER ({good} AND {c}) AS found{s}"
               for s, c in true.items()]
    names = ["significance_cut", *[f"num_spectra{s}" for s in true],
             *[f"num_spectra_qso{s}" for s in true], *[f"num_entries{s}" for s in true],
             *[f"num_correct_entries{s}" for s in true]]
    rates = ", ".join(f"{_try('found' + s, 'num_spectra_qso' + s)} AS completeness{s}"
                      for s in true)
    lead = "mag_cut, " if mags else ""
    return with_ctes(
        SCORED, CUSTOMER_TRUTH, f"mags AS ({cut})",
        f"sigs AS (SELECT unnest({array_sql(SIGNIFICANCE_CUTS)}) AS significance_cut)",
        f"""nq AS (SELECT mag_cut AS mc, {', '.join(
            f'count(DISTINCT SPECID) FILTER ({c}) AS num_spectra_qso{s}'
            for s, c in true.items())} FROM mags JOIN qso ON {keep} GROUP BY mag_cut)""",
        f"""ns AS (SELECT mag_cut AS mc2, count(DISTINCT SPECID) AS num_spectra,
    count(DISTINCT SPECID) AS num_spectra_zge2_1, count(DISTINCT SPECID) AS num_spectra_zlt2_1
  FROM mags JOIN flagged ON {keep} GROUP BY mag_cut)""",
        f"""study AS (SELECT mag_cut, significance_cut, {', '.join(counts)}
  FROM (SELECT * FROM mags, sigs) g LEFT JOIN flagged s
    ON {keep} AND PEAK_SIGNIFICANCE >= significance_cut GROUP BY mag_cut, significance_cut)"""
    ) + f"""SELECT {lead}{', '.join(names)}, {rates} FROM study
  JOIN nq ON mc IS NOT DISTINCT FROM mag_cut JOIN ns ON mc2 IS NOT DISTINCT FROM mag_cut"""


COMPLETENESS_NAMES = ["significance_cut", "completeness", "completeness_zge2_1",
                      "completeness_zlt2_1"]


def entries(spark, sf):
    return C.with_truth(orders_candidates(spark, sf))


@query("f7_peak_finder_completeness", rounded_sql(finder_sql(None), *COMPLETENESS_NAMES))
def f7(spark, sf):
    return rounded(S.peak_finder_completeness(entries(spark, sf), customer_truth(spark, sf)))


@query("f8_peak_finder_completeness_by_magnitude",
       rounded_sql(finder_sql(MAG_CUTS), *COMPLETENESS_NAMES))
def f8(spark, sf):
    return rounded(S.peak_finder_completeness(entries(spark, sf), customer_truth(spark, sf),
                                              MAG_CUTS))


@query("f17_trial_redshifts_per_spectrum", rounded_sql(
    f"SELECT mag_cut, significance_cut, completeness, "
    f"{_try('num_entries', 'num_spectra')} AS entries_per_spectrum, "
    f"{_try('num_correct_entries', 'num_spectra_qso')} AS correct_per_quasar "
    f"FROM ({finder_sql(MAG_CUTS)})", "significance_cut", "completeness", "entries_per_spectrum",
    "correct_per_quasar"))
def f17(spark, sf):
    return rounded(S.trial_redshifts_per_spectrum(S.peak_finder_completeness(
        entries(spark, sf), customer_truth(spark, sf), MAG_CUTS)))


# --- figure data ------------------------------------------------------------


def bins_sql(bins) -> str:
    rows = ", ".join(f"({num(a)}, {num(b)})" for a, b in zip(bins[:-1], bins[1:]))
    return f"bins(mag_lo, mag_hi) AS (VALUES {rows})"


VELOCITY = """speed AS (SELECT mag_lo, mag_hi, DELTA_Z / (1 + Z_TRUE) * 3e5 AS dv
  FROM flagged JOIN bins ON R_MAG > mag_lo AND R_MAG <= mag_hi WHERE IS_CORRECT)"""


@query("f9_redshift_precision", rounded_sql(with_ctes(SCORED, bins_sql(MAG_BINS), VELOCITY) + """
SELECT mag_lo, mag_hi, avg(dv) AS mean_dv, stddev_samp(dv) AS sigma_dv,
  median(abs(dv)) / 3e5 * 1.48e0 * 100 AS nmad100, count(*) AS n
FROM speed GROUP BY mag_lo, mag_hi""", "mean_dv", "sigma_dv", "nmad100"))
def f9(spark, sf):
    return rounded(R.redshift_precision(entries(spark, sf), MAG_BINS))


def _histogram_sql(source: str, value: str, edges, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    width = num((edges[-1] - edges[0]) / (len(edges) - 1))
    over = f"PARTITION BY {by}" if by else ""
    last = len(edges) - 1
    return f"""SELECT {lead}(i - 1)::INTEGER AS bin, e[i] AS bin_lo, e[i + 1] AS bin_hi, n,
  n / (sum(n) OVER ({over}) * {width}) AS density FROM (
  SELECT {lead}i, any_value(e) AS e, count(*) AS n FROM (SELECT {array_sql(edges)} AS e) x,
    range(1, {last + 1}) t(i), {source}
  WHERE {value} >= e[i] AND ({value} < e[i + 1] OR (i = {last} AND {value} = e[i + 1]))
  GROUP BY {lead}i)"""


@query("f10_velocity_histogram", rounded_sql(
    with_ctes(SCORED, bins_sql(MAG_BINS), VELOCITY)
    + _histogram_sql("speed", "dv", VELOCITY_EDGES, "mag_lo, mag_hi"), "density"))
def f10(spark, sf):
    return rounded(R.velocity_histogram(entries(spark, sf), MAG_BINS), "density")


@query("f11_column_histogram", rounded_sql(
    with_ctes(SCORED) + _histogram_sql("flagged", "Z_TRY", R._column_edges(), "IS_CORRECT"),
    "density"))
def f11(spark, sf):
    return rounded(R.column_histogram(entries(spark, sf), "Z_TRY", by_correct=True), "density")


RATIO_LIKE = """wide AS (SELECT IS_CORRECT, (cand_id % 53) / 10.0e0 - 1.2e0 AS LYA_RATIO,
  (cand_id % 31) / 7.0e0 - 1.0e0 AS LYA_RATIO_SN, (cand_id % 11) / 3.0e0 AS CIV_RATIO2 FROM flagged)"""


@query("f12_ratio_histograms", rounded_sql(with_ctes(SCORED, RATIO_LIKE, """long AS (
  SELECT IS_CORRECT, 'LYA_RATIO' AS "column", LYA_RATIO AS value FROM wide UNION ALL
  SELECT IS_CORRECT, 'LYA_RATIO_SN', LYA_RATIO_SN FROM wide UNION ALL
  SELECT IS_CORRECT, 'CIV_RATIO2', CIV_RATIO2 FROM wide)""") + _histogram_sql(
    "long", "value", R._column_edges(), 'IS_CORRECT, "column"'), "density"))
def f12(spark, sf):
    k = F.col("cand_id")
    wide = entries(spark, sf).select(
        "IS_CORRECT", "Z_TRY", ((k % 53) / 10.0 - 1.2).alias("LYA_RATIO"),
        ((k % 31) / 7.0 - 1.0).alias("LYA_RATIO_SN"), ((k % 11) / 3.0).alias("CIV_RATIO2"))
    return rounded(R.ratio_histograms(wide, by_correct=True), "density")


RUN_COLUMNS = ["f1_score", "purity", "completeness", "diff_f1_score", "diff_purity",
               "diff_completeness"]


def _runs_sql() -> str:
    base = with_ctes(SCORED, CUSTOMER_TRUTH, sweep_sql(MAG_CUTS).replace(
        "sweep AS (SELECT *,", "sweep0 AS (SELECT *,")
        + ",\nsweep AS (SELECT * FROM sweep0 WHERE mag_cut IS NOT NULL)")
    one = base + optimal_sql(False, "mag_cut")
    other = one.replace("o_orderkey * 7919 % 1000", "o_orderkey * 6007 % 1000")
    return f"""WITH runs AS (SELECT 'control' AS run, * FROM ({one}) UNION ALL
  SELECT 'other', * FROM ({other}))
SELECT r.run, r."case", r.mag_cut, r.f1_score, r.purity, r.completeness,
  r.f1_score - c.f1_score AS diff_f1_score, r.purity - c.purity AS diff_purity,
  r.completeness - c.completeness AS diff_completeness
FROM runs r JOIN runs c ON c.run = 'control' AND c."case" = r."case" AND c.mag_cut = r.mag_cut
WHERE r."case" <> 'all z'"""


@query("f13_run_comparison", rounded_sql(_runs_sql(), *RUN_COLUMNS))
def f13(spark, sf):
    from lumenpeak.operators.forest import with_duplicates

    known, catalogue = entries(spark, sf), customer_truth(spark, sf)
    other = known.withColumn("PROB", (F.col("cand_id") * 6007 % 1000) / 1000.0)
    runs = [S.statistics_by_magnitude(with_duplicates(df, ["cand_id"]), catalogue, MAG_CUTS)
            .withColumn("run", F.lit(name)) for name, df in (("control", known), ("other", other))]
    return rounded(R.compare_runs(runs[0].unionByName(runs[1]), "control"), *RUN_COLUMNS)


@query("f14_confusion_points", with_ctes(SCORED, bins_sql(MAG_BINS), """picked AS (
  SELECT *, CASE WHEN Z_TRY >= 2.1e0 THEN PROB > 0.6e0 ELSE PROB > 0.3e0 END AS sel
  FROM flagged JOIN bins ON R_MAG > mag_lo AND R_MAG <= mag_hi)""") + """
SELECT mag_lo, mag_hi, 'correct' AS kind, Z_TRUE, Z_TRY FROM picked WHERE IS_CORRECT UNION ALL
SELECT mag_lo, mag_hi, CASE CLASS_PERSON WHEN 3 THEN 'qso' WHEN 4 THEN 'galaxy' ELSE 'star' END,
  Z_TRUE, Z_TRY FROM picked WHERE sel AND CLASS_PERSON IN (1, 3, 4)""")
def f14(spark, sf):
    return R.confusion_points(entries(spark, sf), MAG_BINS, 0.3, 0.6)


EXCLUDED = [("civ_blue", "civ_red"), ("lya", "lyb")]


@query("f15_confusion_tracks", rounded_sql(with_ctes(CUSTOMER_TRUTH, lines_sql(), """z AS (
  SELECT DISTINCT floor(Z_TRUE / 0.5e0) * 0.5e0 AS z FROM qso)""") + """
SELECT z, a.LINE AS "real", b.LINE AS assumed, a.WAVE / b.WAVE * (1 + z) - 1 AS z_assumed
FROM z, lines a, lines b WHERE a.LINE <> b.LINE
  AND (a.LINE, b.LINE) NOT IN (('civ_blue', 'civ_red'), ('lya', 'lyb'))""", "z_assumed"))
def f15(spark, sf):
    steps = customer_truth(spark, sf).select(
        (F.floor(F.col("Z_TRUE") / 0.5) * 0.5).alias("z")).distinct()
    return rounded(R.confusion_tracks(steps, LINES, EXCLUDED), "z_assumed")


@query("f16_observed_lines", rounded_sql(with_ctes(PIXELS, TRUTH, lines_sql(), """span AS (
  SELECT SPECID, min(wave) AS lo, max(wave) AS hi FROM pixels GROUP BY SPECID)""") + """
SELECT SPECID, LINE, WAVE * (1 + Z_TRUE) AS wave_observed FROM truth JOIN span USING (SPECID), lines
WHERE CLASS_PERSON IN (3, 4) AND lo < WAVE * (1 + Z_TRUE) AND WAVE * (1 + Z_TRUE) < hi""",
                                         "wave_observed"))
def f16(spark, sf):
    span = pixels(spark, sf).groupBy("SPECID").agg(
        F.min("wave").alias("min_wave"), F.max("wave").alias("max_wave"))
    return rounded(R.observed_lines(truth(spark, sf).join(span, "SPECID")))
