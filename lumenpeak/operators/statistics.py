"""Completeness, purity and threshold sweeps, each in one pass over the candidates.

A sweep over many cuts never filters once per cut: every row is filed under the
first cut it passes, rows are counted per cut (map tasks do most of it), and
counts at each cut are running sums over that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.columns import bound, literal_array, ratio, with_cut_index
from lumenpeak.functions.constants import (PROB_GRID, QUASAR, QUASAR_CLASSES, REDSHIFT_TOLERANCE,
                                           REPORT_CUTS, SIGNIFICANCE_CUTS, SPLIT_REDSHIFT)
from lumenpeak.functions.shared import written


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def grid_frame(df: DataFrame, cuts: Sequence[float], index: str, name: str) -> DataFrame:
    """One row per cut, from one generated row."""
    values = literal_array(cuts)
    return df.sparkSession.range(1).select(F.posexplode(values).alias(index, name))


# --- completeness and purity ------------------------------------------------


def completeness(catalogue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of catalogue rows with a correct candidate: all, z >= 1, z >= 2.1."""
    found = (candidates.where("IS_CORRECT").select(F.col("SPECID").alias("__found")).distinct())
    marked = catalogue.join(found, F.col("SPECID") == F.col("__found"), "left")
    hit, z = F.col("__found").isNotNull(), F.col("Z_TRUE")
    counts = marked.agg(
        F.count("*").alias("num_quasars"), _count_if(z >= 1.0).alias("num_quasars_zge1"),
        _count_if(z >= 2.1).alias("num_quasars_zge2_1"), _count_if(hit).alias("found_quasars"),
        _count_if(hit & (z >= 1.0)).alias("found_quasars_zge1"),
        _count_if(hit & (z >= 2.1)).alias("found_quasars_zge2_1"))
    return counts.withColumns({
        "completeness": ratio(F.col("found_quasars"), F.col("num_quasars")),
        "completeness_zge1": ratio(F.col("found_quasars_zge1"), F.col("num_quasars_zge1")),
        "completeness_zge2_1": ratio(F.col("found_quasars_zge2_1"), F.col("num_quasars_zge2_1")),
    })


def _purity_counts() -> list[Column]:
    z, good = F.col("Z_TRUE"), F.col("IS_CORRECT")
    return [F.count("*").alias("num_candidates"), _count_if(good).alias("num_correct"),
            _count_if(z >= 1).alias("num_zge1"), _count_if(good & (z >= 1)).alias("correct_zge1"),
            _count_if(z >= 2.1).alias("num_zge2_1"),
            _count_if(good & (z >= 2.1)).alias("correct_zge2_1"),
            _count_if(F.col("IS_LINE")).alias("num_line")]


def _purity_ratios() -> dict[str, Column]:
    return {"purity": ratio(F.col("num_correct"), F.col("num_candidates")),
            "purity_zge1": ratio(F.col("correct_zge1"), F.col("num_zge1")),
            "purity_zge2_1": ratio(F.col("correct_zge2_1"), F.col("num_zge2_1")),
            "line_purity": ratio(F.col("num_line"), F.col("num_candidates"))}


_PURITY = ("num_candidates", "num_correct", "num_zge1", "correct_zge1", "num_zge2_1",
           "correct_zge2_1", "num_line")


def purity(candidates: DataFrame) -> DataFrame:
    """Share of correct rows: all, z >= 1, z >= 2.1, and of rows on any line."""
    return candidates.agg(*_purity_counts()).withColumns(_purity_ratios())


def probability_report(catalogue: DataFrame, candidates: DataFrame,
                       cuts: Sequence[float] = REPORT_CUTS) -> DataFrame:
    """Completeness and purity of all rows (step 0) and above each probability cut.

    Above a cut: PROB > cut, not duplicated, confident inspection.  The candidates are
    read once: all that is reported follows from their counts per object and first cut.
    """
    cuts = sorted(cuts, reverse=True)
    n = len(cuts)
    usable = F.expr("NOT DUPLICATED AND Z_CONF_PERSON = 3")
    # n: passes no cut, and counts only where all rows do
    filed = with_cut_index(candidates, "first", "PROB", cuts, ">").withColumn(
        "cut_index", F.when(usable, F.col("first")).otherwise(n))
    counts = written(filed.groupBy("SPECID", "cut_index").agg(*_purity_counts()), "report")
    pure = counts.groupBy("cut_index").agg(*[F.sum(c).alias(c) for c in _PURITY])
    # a quasar is found from the easiest cut its best correct candidate passes on
    best = counts.where("num_correct > 0").groupBy("SPECID").agg(
        F.min("cut_index").alias("cut_index"))
    truth = catalogue.select("SPECID", "Z_TRUE")
    z = F.col("Z_TRUE")

    def quasars(name: str) -> list[Column]:
        return [F.count("*").alias(name), _count_if(z >= 1.0).alias(f"{name}_zge1"),
                _count_if(z >= 2.1).alias(f"{name}_zge2_1")]

    hits = best.join(truth, "SPECID").groupBy("cut_index").agg(*quasars("found_quasars"))
    totals = truth.agg(*quasars("num_quasars")).withColumn("one", F.lit(1))
    found = [c for c in hits.columns if c != "cut_index"]
    grid = candidates.sparkSession.range(1).select(F.posexplode(
        F.array(*[F.lit(c).cast("double") for c in (*cuts, None)])).alias("cut_index", "prob_cut"))
    upto = Window.orderBy("cut_index").rowsBetween(Window.unboundedPreceding, 0)
    both = grid.join(pure, "cut_index", "left").join(hits, "cut_index", "left").select(
        F.when(F.col("cut_index") == n, 0).otherwise(F.col("cut_index") + 1).alias("step"),
        "prob_cut", F.lit(1).alias("one"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto).alias(c) for c in (*_PURITY, *found)]
    ).join(totals, "one").drop("one")
    return both.withColumns({
        **_purity_ratios(),
        "completeness": ratio(F.col("found_quasars"), F.col("num_quasars")),
        "completeness_zge1": ratio(F.col("found_quasars_zge1"), F.col("num_quasars_zge1")),
        "completeness_zge2_1": ratio(F.col("found_quasars_zge2_1"), F.col("num_quasars_zge2_1")),
    })


# --- threshold sweep --------------------------------------------------------

SIDES = ("", "_zge2_1", "_zlt2_1")


def _sweep_measures(split: float) -> dict[str, Column]:
    """Conditional counts per row; every statistic of the sweep is a sum of these."""
    true_high, true_low = F.col("Z_TRUE") >= split, F.col("Z_TRUE") < split
    high, low = F.col("Z_TRY") >= split, F.col("Z_TRY") < split
    quasar, good = F.col("CLASS_PERSON").isin(*QUASAR_CLASSES), F.col("IS_CORRECT")
    return {
        "rows": F.lit(True), "rows_high": high, "rows_low": low,
        "good": good & quasar, "good_high": good & quasar & true_high,
        "good_low": good & quasar & true_low,
        "alt_high": quasar & true_high & high, "alt_low": quasar & true_low & low,
        "moved_up": good & true_high & low, "moved_down": good & true_low & high,
    }


_MEASURES = (
    "rows", "rows_high", "rows_low", "good", "good_high", "good_low", "alt_high", "alt_low",
    "moved_up", "moved_down")


def _sweep_columns(sums: DataFrame) -> DataFrame:
    """Running counts -> the statistics of each cut.

    A redshift side without candidates before correction has no found quasars;
    correct rows whose trial redshift lies across the split move to the side of
    their true redshift.
    """
    df = bound(sums, **{name: f"CAST({sql} AS DOUBLE)" for name, sql in {
        "num_candidates": "rows",
        "num_candidates_zge2_1": "rows_high + moved_up - moved_down",
        "num_candidates_zlt2_1": "rows_low - moved_up + moved_down",
        "found": "good",
        "found_zge2_1": "CASE WHEN rows_high > 0 THEN good_high ELSE 0 END",
        "found_zlt2_1": "CASE WHEN rows_low > 0 THEN good_low ELSE 0 END",
        "found_alt": "CASE WHEN rows_high > 0 THEN alt_high ELSE 0 END + moved_up "
                     "+ CASE WHEN rows_low > 0 THEN alt_low ELSE 0 END + moved_down",
        "found_alt_zge2_1": "CASE WHEN rows_high > 0 THEN alt_high ELSE 0 END + moved_up",
        "found_alt_zlt2_1": "CASE WHEN rows_low > 0 THEN alt_low ELSE 0 END + moved_down",
    }.items()})
    every = [(kind, side) for kind in ("", "_alt") for side in SIDES]
    df = bound(df, **{name: sql for k, s in every for name, sql in (
        (f"missed{k}{s}", f"num_quasars{s} - found{k}{s}"),
        (f"purity{k}{s}", f"try_divide(found{k}{s}, num_candidates{s})"),
        (f"completeness{k}{s}", f"try_divide(found{k}{s}, num_quasars{s})"))})
    return bound(df, **{f"f1_score{k}{s}": f"try_divide(2.0D * purity{k}{s} * completeness{k}{s}, "
                                           f"purity{k}{s} + completeness{k}{s})"
                        for k, s in every})


def sweep_columns() -> list[str]:
    out = ["prob", *[f"num_quasars{s}" for s in SIDES], *[f"num_candidates{s}" for s in SIDES]]
    for kind in ("", "_alt"):
        for s in SIDES:
            out += [f"found{kind}{s}", f"missed{kind}{s}"]
        for s in SIDES:
            out += [f"purity{kind}{s}", f"completeness{kind}{s}", f"f1_score{kind}{s}"]
    return out


def sweep_by_magnitude(candidates: DataFrame, truth: DataFrame,
                       mag_cuts: Sequence[float] | None = None,
                       probs: Sequence[float] = PROB_GRID,
                       split: float = SPLIT_REDSHIFT, magnitude: str = "R_MAG") -> DataFrame:
    """Threshold sweep for the objects up to each magnitude cut, and for all.

    ``mag_cuts`` ascend; the case of all objects has mag_cut NULL.  One
    aggregation fills a (magnitude, probability) table of counts; running sums
    along both axes give every combination.
    """
    mags = list(mag_cuts or [])
    probs = list(probs)
    m, p = len(mags), len(probs)

    def by_mag(df: DataFrame) -> DataFrame:
        # faintest bin (m) holds what no cut keeps: it counts for all objects only
        if not mags:
            return df.withColumn("mag_index", F.lit(0))
        return with_cut_index(df.withColumn("__mag", F.col(magnitude)), "mag_index", "__mag",
                              mags, "<=").drop("__mag")

    measures = _sweep_measures(split)
    kept = candidates.where("NOT DUPLICATED AND PROB IS NOT NULL")
    filed = with_cut_index(by_mag(kept), "prob_index", "PROB", probs, ">=").where(
        f"prob_index < {p}")
    counts = filed.groupBy("mag_index", "prob_index").agg(
        *[_count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in measures.items()])
    mag_rows = [*mags, None]
    axis = F.array(*[F.lit(v).cast("double") for v in mag_rows])
    grid = (grid_frame(candidates, probs, "prob_index", "prob")
            .select("*", F.posexplode(axis).alias("mag_index", "mag_cut")))
    dense = grid.join(counts, ["mag_index", "prob_index"], "left").fillna(0, list(_MEASURES))
    along_prob = Window.partitionBy("mag_index").orderBy("prob_index").rowsBetween(
        Window.unboundedPreceding, 0)
    along_mag = Window.partitionBy("prob_index").orderBy("mag_index").rowsBetween(
        Window.unboundedPreceding, 0)
    for w in (along_prob, along_mag):
        dense = dense.withColumns({c: F.sum(c).over(w) for c in _MEASURES})

    z = F.col("Z_TRUE")
    true_counts = by_mag(truth).groupBy("mag_index").agg(
        F.count("*").alias("num_quasars"), _count_if(z >= split).alias("num_quasars_zge2_1"),
        _count_if(z < split).alias("num_quasars_zlt2_1"))
    names = [f"num_quasars{s}" for s in SIDES]
    mag_axis = grid.select("mag_index").distinct()
    upto = Window.orderBy("mag_index").rowsBetween(Window.unboundedPreceding, 0)
    quasars = mag_axis.join(true_counts, "mag_index", "left").select("mag_index", *[
        F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto).cast("double").alias(c) for c in names])
    swept = _sweep_columns(dense.join(quasars, "mag_index"))
    return swept.select("mag_index", "mag_cut", "prob_index", *sweep_columns())


def threshold_sweep(candidates: DataFrame, truth: DataFrame, probs: Sequence[float] = PROB_GRID,
                    split: float = SPLIT_REDSHIFT) -> DataFrame:
    """Statistics at each probability cut, for all objects."""
    return sweep_by_magnitude(candidates, truth, None, probs, split).drop(
        "mag_index", "mag_cut")


_CASES = (("z<2.1", "_zlt2_1"), ("z>=2.1", "_zge2_1"), ("all z", ""))


def optimal_threshold(sweep: DataFrame, by_f1: bool = True,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Best cut per case: largest F1, or purity closest to completeness.

    The relaxed variant always takes the largest F1.  Ties, and cases where the
    score is nowhere defined, go to the first cut of the grid.
    """
    def best(value: str, kind: str, side: str, suffix: str) -> str:
        picked = ", ".join(
            f"'{name}{suffix}', {column}" for name, column in (
                ("prob", "prob"), ("num_candidates", f"num_candidates{side}"),
                *((c, f"{c}{kind}{side}") for c in ("purity", "completeness", "f1_score"))))
        return (f"min_by(named_struct({picked}), named_struct('none', {value} IS NULL, "
                f"'down', -({value}), 'at', prob_index))")

    picks, rows = [], []
    for i, (case, s) in enumerate(_CASES):
        main = f"f1_score{s}" if by_f1 else f"-abs(purity{s} - completeness{s})"
        picks += [F.expr(best(main, "", s, "")).alias(f"main{i}"),
                  F.expr(best(f"f1_score_alt{s}", "_alt", s, "_alt")).alias(f"alt{i}")]
        rows.append(f"named_struct('case', '{case}', 'm', main{i}, 'a', alt{i})")
    found = sweep.groupBy(*keys).agg(*picks)
    return found.selectExpr(*keys, f"inline(array({', '.join(rows)}))").selectExpr(
        *keys, "case", "m.*", "a.*")


def statistics_by_magnitude(candidates: DataFrame, truth: DataFrame, mag_cuts: Sequence[float],
                            probs: Sequence[float] = PROB_GRID) -> DataFrame:
    """Crossing point of purity and completeness for the objects up to each magnitude."""
    sweep = sweep_by_magnitude(candidates, truth, mag_cuts, probs)
    return optimal_threshold(sweep.where("mag_cut IS NOT NULL"), by_f1=False,
                             keys=["mag_index", "mag_cut"]).drop("mag_index")


# --- peak finder completeness -----------------------------------------------


def peak_finder_completeness(candidates: DataFrame, truth: DataFrame,
                             mag_cuts: Sequence[float] | None = None,
                             cuts: Sequence[float] = SIGNIFICANCE_CUTS,
                             tolerance: float = REDSHIFT_TOLERANCE,
                             split: float = SPLIT_REDSHIFT,
                             magnitude: str = "R_MAG") -> DataFrame:
    """Entries and completeness of the peak finder at each significance cut.

    With ``mag_cuts`` the study is repeated for the objects up to each cut.  An
    object is found at a cut if its most significant correct entry passes, so
    distinct objects are counted from one maximum per object.
    """
    down = sorted(cuts, reverse=True)
    n = len(down)
    mags = list(mag_cuts) if mag_cuts is not None else [None]

    def filed_by_mag(df: DataFrame) -> DataFrame:
        if mag_cuts is None:
            return df.withColumn("mag_index", F.lit(0))
        return with_cut_index(df.withColumn("__mag", F.col(magnitude)), "mag_index", "__mag",
                              mags, "<=").drop("__mag").where(f"mag_index < {len(mags)}")

    near = F.col("DELTA_Z").between(-tolerance, tolerance)
    true_high, true_low = F.col("Z_TRUE") >= split, F.col("Z_TRUE") < split
    high, low = F.col("Z_TRY") >= split, F.col("Z_TRY") < split
    good = (F.col("CLASS_PERSON") == QUASAR) & near
    in_mag = filed_by_mag(candidates)
    filed = with_cut_index(in_mag, "sig_index", "PEAK_SIGNIFICANCE", down, ">=").where(
        f"sig_index < {n}")
    entry = {
        "num_entries": F.lit(True), "entries_high": high, "entries_low": low,
        "up": true_high & low & near, "down": true_low & high & near,
        "num_correct_entries": good, "num_correct_entries_zge2_1": good & true_high,
        "num_correct_entries_zlt2_1": good & true_low,
    }
    counts = filed.groupBy("mag_index", "sig_index").agg(
        *[_count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in entry.items()])

    # per object and side: at each magnitude cut, the first significance cut passed
    correct = filed.where(good)
    sides = F.array(F.lit("all"), F.when(true_high, "zge2_1").when(true_low, "zlt2_1"))
    best = (correct.select("SPECID", "mag_index", "sig_index", F.explode(sides).alias("side"))
            .where("side IS NOT NULL")
            .groupBy("SPECID", "side", "mag_index").agg(F.min("sig_index").alias("sig_index")))
    # an object counts once: from a brighter magnitude bin on it may only improve
    earlier = Window.partitionBy("SPECID", "side").orderBy("mag_index").rowsBetween(
        Window.unboundedPreceding, -1)
    steps = best.withColumn("before", F.min("sig_index").over(earlier)).where(
        "before IS NULL OR sig_index < before")
    found = steps.groupBy("mag_index", "sig_index").agg(*[
        _count_if(F.col("side") == s).alias(f"found_{s}") for s in ("all", "zge2_1", "zlt2_1")])
    # where it was already found at a harder cut from `before` on, take it back there
    undone = steps.where("before IS NOT NULL").groupBy(
        "mag_index", F.col("before").alias("sig_index")).agg(*[
            _count_if(F.col("side") == s).alias(f"undo_{s}") for s in ("all", "zge2_1", "zlt2_1")])

    axis = F.array(*[F.lit(v).cast("double") for v in mags])
    grid = (grid_frame(candidates, down, "sig_index", "significance_cut")
            .select("*", F.posexplode(axis).alias("mag_index", "mag_cut")))
    added = [*entry, *[f"{k}_{s}" for k in ("found", "undo") for s in ("all", "zge2_1", "zlt2_1")]]
    dense = (grid.join(counts, ["mag_index", "sig_index"], "left")
             .join(found, ["mag_index", "sig_index"], "left")
             .join(undone, ["mag_index", "sig_index"], "left").fillna(0, added))
    along_sig = Window.partitionBy("mag_index").orderBy("sig_index").rowsBetween(
        Window.unboundedPreceding, 0)
    along_mag = Window.partitionBy("sig_index").orderBy("mag_index").rowsBetween(
        Window.unboundedPreceding, 0)
    for w in (along_sig, along_mag):
        dense = dense.withColumns({c: F.sum(c).over(w) for c in added})

    # distinct objects up to each magnitude: each counts from its brightest bin on
    z = F.col("Z_TRUE")
    upto = Window.orderBy("mag_index").rowsBetween(Window.unboundedPreceding, 0)
    mag_axis = grid.select("mag_index").distinct()

    def distinct_objects(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
        firsts = df.groupBy("SPECID").agg(
            *[F.min(F.when(v, F.col("mag_index"))).alias(k) for k, v in measures.items()])
        long = firsts.select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("name"), F.col(k).alias("mag_index"))
            for k in measures])).alias("__m")).select("__m.*").where("mag_index IS NOT NULL")
        counted = long.groupBy("mag_index").agg(
            *[_count_if(F.col("name") == k).alias(k) for k in measures])
        return mag_axis.join(counted, "mag_index", "left").select("mag_index", *[
            F.sum(F.coalesce(F.col(k), F.lit(0))).over(upto).alias(k) for k in measures])

    quasars = distinct_objects(filed_by_mag(truth), {
        "num_spectra_qso": F.lit(True), "num_spectra_qso_zge2_1": z >= split,
        "num_spectra_qso_zlt2_1": z < split})
    spectra = distinct_objects(in_mag, {"num_spectra": F.lit(True)})
    c = F.col
    out = dense.join(quasars, "mag_index").join(spectra, "mag_index").withColumns({
        "num_entries_zge2_1": c("entries_high") + c("up") - c("down"),
        "num_entries_zlt2_1": c("entries_low") - c("up") + c("down"),
        # the same number on both sides of the split
        "num_spectra_zge2_1": c("num_spectra"), "num_spectra_zlt2_1": c("num_spectra"),
        "completeness": ratio(c("found_all") - c("undo_all"), c("num_spectra_qso")),
        "completeness_zge2_1": ratio(c("found_zge2_1") - c("undo_zge2_1"),
                                     c("num_spectra_qso_zge2_1")),
        "completeness_zlt2_1": ratio(c("found_zlt2_1") - c("undo_zlt2_1"),
                                     c("num_spectra_qso_zlt2_1")),
    })
    names = ["significance_cut"]
    for stem in ("num_spectra", "num_spectra_qso", "num_entries", "num_correct_entries",
                 "completeness"):
        names += [f"{stem}{s}" for s in SIDES]
    return out.select(*(["mag_cut"] if mag_cuts is not None else []), *names)


def trial_redshifts_per_spectrum(study: DataFrame) -> DataFrame:
    """Entries per spectrum and correct entries per quasar of a peak finder study."""
    return study.withColumns({
        "entries_per_spectrum": ratio(F.col("num_entries"), F.col("num_spectra")),
        "correct_per_quasar": ratio(F.col("num_correct_entries"), F.col("num_spectra_qso")),
    }).select("mag_cut", "significance_cut", "completeness", "entries_per_spectrum",
              "correct_per_quasar")
