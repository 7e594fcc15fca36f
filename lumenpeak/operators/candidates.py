"""Trial redshifts, line metrics, the wide candidate table and its truth columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpeak.functions.columns import any_of, ratio
from lumenpeak.functions.constants import (LINES, NUM_PIXELS, QUASAR_CLASSES, REDSHIFT_TOLERANCE,
                                           STAR, TRY_LINES)
from lumenpeak.functions.lines import band_structs, line_position, try_line_structs
from lumenpeak.functions.shared import written
from lumenpeak.operators.halo import CHUNK
from lumenpeak.operators.rangejoin import bin_of, binned_points, interval_join

# About the width of an observed-frame line interval, in Angstrom.
METRIC_BIN_WIDTH = 50.0
# Pixels packed into one row there.
METRIC_PIECE = CHUNK
# Spectra whose metrics a task works on at once.
ROWS = 64
# Candidates whose interval members leave one task.
MEMBER_DEAL = 16_384
# Pixels of packed spectra that meet in one task.
MEMBER_PIXELS = 64 * CHUNK

CANDIDATE_KEY = ("SPECID", "peak_pix", "try_order")


def trial_redshifts(peaks: DataFrame, lines: Sequence[tuple] = LINES,
                    try_lines: Sequence[str] = TRY_LINES) -> DataFrame:
    """One row per peak and try-line with a non-negative trial redshift."""
    return (peaks.withColumn("__try", F.explode(try_line_structs(try_lines, lines)))
            .select("SPECID", F.col("pix").alias("peak_pix"), "__try.try_order",
                    "__try.ASSUMED_LINE", "__try.assumed_index",
                    (F.col("wave") / F.col("__try.rest_wave") - 1.0).alias("Z_TRY"),
                    F.col("significance").alias("PEAK_SIGNIFICANCE"))
            .where("Z_TRY >= 0"))


def line_intervals(candidates: DataFrame, lines: Sequence[tuple] = LINES) -> DataFrame:
    """Observed-frame peak (0), blue (1) and red (2) interval of each line.

    Columns: key, line_index, band, lo, hi.
    """
    shifted = 1.0 + F.col("Z_TRY")
    return (candidates.select(*CANDIDATE_KEY, "Z_TRY",
                              F.explode(band_structs(lines)).alias("__b"))
            .select(*CANDIDATE_KEY, "__b.line_index", "__b.band",
                    (shifted * F.col("__b.rest_lo")).alias("lo"),
                    (shifted * F.col("__b.rest_hi")).alias("hi")))


def interval_members(pixels: DataFrame, candidates: DataFrame, lines: Sequence[tuple] = LINES,
                     bin_width: float = METRIC_BIN_WIDTH, piece: int = METRIC_PIECE,
                     deal: int = MEMBER_DEAL) -> DataFrame:
    """Pixels inside each interval of each candidate.

    Only pixels and candidates are shuffled, once, by spectrum.  The pixels of a spectrum of
    at most ``piece`` of them become one row, where the intervals of a candidate look up
    the pixels of the bins they touch.  Members leave partitioned by spectrum, those of
    some ``deal`` candidates a task, so grouping them by candidate needs no shuffle.  Spectra
    with more pixels, or more than ``piece`` bins between their ends, take the binned join.
    """
    pixels = pixels.select("SPECID", "wave", "flux", "ivar").where("wave IS NOT NULL")
    candidates = written(candidates.select(*CANDIDATE_KEY, "Z_TRY"), "trials")
    extent = (F.max("wave") - F.min("wave")) / F.lit(float(bin_width))
    long = written(pixels.groupBy("SPECID").agg(((F.count("*") <= piece) & (extent < piece)).alias("packs"))
                   .where("NOT packs").select("SPECID"), "long-spectra")
    if long.isEmpty():
        return _packed_members(pixels, candidates, lines, bin_width, deal)
    short = _packed_members(pixels.join(long, "SPECID", "left_anti"),
                            candidates.join(long, "SPECID", "left_anti"), lines, bin_width, deal)
    return short.unionByName(interval_join(
        pixels.join(long, "SPECID", "left_semi"),
        line_intervals(candidates.join(long, "SPECID", "left_semi"), lines), ["SPECID"], "wave", "lo", "hi",
        bin_width))


def _packed_members(pixels: DataFrame, candidates: DataFrame, lines: Sequence[tuple], bin_width: float,
                    deal: int) -> DataFrame:
    """``interval_members`` of spectra that fit into one row each.

    ``starts[b]`` is the place of the first pixel in bin ``first_bin + b`` or behind it, so an
    interval counts through the places of the bins it touches and keeps the pixels inside it.
    No list is made or copied for an interval; what follows the join is compiled as one."""
    tasks = max(candidates.count() // deal, pixels.count() // MEMBER_PIXELS) + 1
    packed = pixels.repartition(tasks, "SPECID").groupBy("SPECID").agg(
        F.sort_array(F.collect_list(F.struct("wave", "flux", "ivar"))).alias("sorted")).withColumn(
        "bins", F.transform("sorted.wave", lambda wave: bin_of(wave, bin_width))).selectExpr(
        "SPECID", "sorted.wave AS waves", "sorted.flux AS fluxes", "sorted.ivar AS ivars",
        "sorted[0].wave AS begins", "element_at(sorted, -1).wave AS ends",
        "bins[0] AS first_bin", "element_at(bins, -1) AS last_bin",
        "concat(flatten(transform(bins, (b, i) -> array_repeat(i, int(coalesce(b - get(bins, i - 1), 1))))), "
        "array(size(bins))) AS starts")
    wanted = candidates.select(*CANDIDATE_KEY, (1.0 + F.col("Z_TRY")).alias("shift")).repartition(tasks, "SPECID")
    spans = wanted.join(packed, "SPECID").withColumn("span", F.explode(band_structs(lines))).withColumns({
        "lo": F.col("shift") * F.col("span.rest_lo"), "hi": F.col("shift") * F.col("span.rest_hi")}).where(
        "lo <= ends AND hi >= begins AND lo <= hi")

    def place(end: str) -> Column:
        """Of the bin of ``end``, counted from the first; ends off the spectrum are in its outer bins."""
        inside = F.least(F.greatest(bin_of(F.col(end), bin_width), F.col("first_bin")), F.col("last_bin"))
        return (inside - F.col("first_bin")).cast("int")

    touched = spans.withColumns({"first": F.get("starts", place("lo")), "after": F.get("starts", place("hi") + 1)})
    # explode_outer: for explode, Spark would make the sequence twice, first to see whether it is empty
    met = touched.withColumn("i", F.explode_outer(F.when(
        F.col("first") < F.col("after"), F.sequence(F.col("first"), F.col("after") - 1))))
    return met.select("SPECID", F.get("waves", F.col("i")).alias("wave"), F.get("fluxes", F.col("i")).alias("flux"),
                      F.get("ivars", F.col("i")).alias("ivar"), "peak_pix", "try_order", "span.line_index", "span.band",
                      "lo", "hi").where("wave >= lo AND wave <= hi")


def line_metrics(pixels: DataFrame, candidates: DataFrame, lines: Sequence[tuple] = LINES,
                 piece: int = METRIC_PIECE) -> DataFrame:
    """(key, line_index, ratio, ratio_sn, ratio2) of the measurable lines.

    A line has no row where a side is too sparsely covered or the continuum is
    zero or missing; its metrics are then missing.
    """
    wanted = candidates.select(*CANDIDATE_KEY, "Z_TRY")
    short, long = _by_length(pixels, wanted, piece)
    found = _measured(*short, lines, False)
    return found if long is None else found.unionByName(_metrics(line_sums(*long, lines, piece)))


def measured_candidates(pixels: DataFrame, candidates: DataFrame, lines: Sequence[tuple] = LINES,
                        piece: int = METRIC_PIECE) -> DataFrame:
    """The wide candidate table, as ``candidate_table`` of the line metrics gives it.

    Candidates of a spectrum of at most ``piece`` pixels are finished where its pixels
    lie: one row each, without a row per line, a grouping or a join.
    """
    short, long = _by_length(pixels, candidates, piece)
    wide = _measured(*short, lines, True).select(
        *CANDIDATE_KEY, *metric_columns(lines), "Z_TRY", "PEAK_SIGNIFICANCE", "ASSUMED_LINE")
    if long is None:
        return wide
    return wide.unionByName(candidate_table(long[1], _metrics(line_sums(*long, lines, piece)), lines))


def _by_length(pixels: DataFrame, candidates: DataFrame, piece: int):
    """((pixels, candidates) of the spectra of at most ``piece`` pixels, the same of the
    longer ones or None)."""
    pixels = pixels.select("SPECID", "pix", "wave", "flux", "ivar").where("wave IS NOT NULL")
    long = written(pixels.where(F.col("pix") >= piece).select("SPECID").distinct(), "long-spectra")
    if long.isEmpty():
        return (pixels, candidates), None
    return ((pixels.join(long, "SPECID", "left_anti"), candidates.join(long, "SPECID", "left_anti")),
            (pixels.join(long, "SPECID", "left_semi"), candidates.join(long, "SPECID", "left_semi")))


def _bands(lines: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Rest-frame ends of the peak, blue and red interval of each line."""
    return (np.array([[float(line[i]) for i in (2, 4, 6)] for line in lines]),
            np.array([[float(line[i]) for i in (3, 5, 7)] for line in lines]))


def _packed(pixels: DataFrame, *keys: str) -> DataFrame:
    """Pixels as arrays; infinity marks a missing value: a sum keeps it, and Arrow carries it."""
    def marked(column: str) -> str:
        return (f"collect_list(CASE WHEN abs({column}) < double('infinity') THEN {column} "
                f"ELSE double('infinity') END) AS {column}")

    return pixels.groupBy(*keys).agg(F.collect_list("wave").alias("wave"), F.expr(marked("flux")),
                                     F.expr(marked("ivar")))


def _measured(pixels: DataFrame, candidates: DataFrame, lines: Sequence[tuple], wide: bool) -> DataFrame:
    """Metrics of candidates whose spectra have one row each: both sides are grouped by
    spectrum, which is also what the join needs."""
    packed = _packed(pixels, "SPECID")
    batches = candidates.groupBy("SPECID").agg(F.collect_list(F.struct(*candidates.columns)).alias("found"))
    joined = batches.join(packed, "SPECID", "left")
    kinds = dict(candidates.dtypes)
    if wide:
        columns = [*candidates.columns, *metric_columns(lines)]
        schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns)
    else:
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in CANDIDATE_KEY), "line_index INT",
                            "ratio DOUBLE", "ratio_sn DOUBLE", "ratio2 DOUBLE"])
    return joined.mapInArrow(_measurer(*_bands(lines), wide, CANDIDATE_KEY), schema)


def _summer(rest_lo: np.ndarray, rest_hi: np.ndarray):
    """Counts and sums over the pixels of one row, per candidate, line and interval.

    Interval ends are found by bisection and sums are taken over slices, so no
    (pixel, interval) row exists.  The result is a closure, which travels to the tasks
    whole: executors need not have this package.
    """
    def sums(wave, flux, ivar, shift, which=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``which``: a line per shift, or all lines."""
        order = np.argsort(wave, kind="stable")
        lo, hi = (rest_lo, rest_hi) if which is None else (rest_lo[which], rest_hi[which])
        scale = shift[:, None, None] if which is None else shift[:, None]
        wave = wave[order]
        first, last = np.searchsorted(wave, scale * lo, "left"), np.searchsorted(wave, scale * hi, "right")
        count = np.maximum(last - first, 0)
        ends = np.stack([first, np.maximum(first, last)], axis=-1).ravel()

        def slices(values: np.ndarray) -> np.ndarray:
            if not len(ends):
                return np.zeros(count.shape)
            # one padding zero lets a slice end at the last pixel
            padded = np.append(values[order], 0.0)
            return np.where(count > 0, np.add.reduceat(padded, ends)[::2].reshape(count.shape), 0.0)

        return count, slices(flux), slices(ivar)

    return sums


def _measurer(rest_lo: np.ndarray, rest_hi: np.ndarray, wide: bool, key: tuple):
    """Task over rows (SPECID, found, wave, flux, ivar): metrics of every candidate."""
    sums = _summer(rest_lo, rest_hi)

    def metrics(n, f, v):
        """(has a row, then value and missing of each metric); see ``_metrics``."""
        half = n[..., 0] // 2
        f, v = np.where(f < np.inf, f, np.nan), np.where(v < np.inf, v, np.nan)
        peak, blue, red = (f[..., i] / n[..., i] for i in range(3))
        continuum = blue + red
        there = (n > 0).all(axis=-1) & (n[..., 1] >= half) & (n[..., 2] >= half)
        there &= ~np.isnan(continuum) & (continuum != 0)
        ratio = 2 * peak / continuum
        error = np.sqrt(4 / v[..., 0] + ratio * ratio * ((1 / v[..., 1] + 1 / v[..., 2]) / 4)) / np.abs(continuum)
        no_ratio = ~there | np.isnan(peak)
        no_error = no_ratio | np.isnan(v).any(axis=-1) | (v == 0).any(axis=-1) | (error == 0)
        return there, ((ratio, no_ratio), ((ratio - 1) / error, no_error), (np.abs((red - blue) / continuum), ~there))

    def columns(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, stops = batch.column("found").flatten(), batch.column("found").offsets.to_numpy()
        fields = {f.name: found.field(i) for i, f in enumerate(found.type)}
        shift = 1.0 + pc.fill_null(fields["Z_TRY"], float("nan")).to_numpy(zero_copy_only=False)
        lists = [batch.column(c) for c in ("wave", "flux", "ivar")]
        parts = []
        for row, (a, z) in enumerate(zip(stops - stops[0], stops[1:] - stops[0])):
            values = [x[row].values for x in lists]
            arrays = [np.empty(0) if x is None else x.to_numpy(zero_copy_only=False) for x in values]
            parts.append(sums(*arrays, shift[a:z]))
        there, values = metrics(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        if wide:
            table = [pa.array(v[:, i], mask=m[:, i]) for i in range(there.shape[1]) for v, m in values]
            return [*fields.values(), *table]
        which, line = np.nonzero(there)
        return [*(fields[c].take(pa.array(which)) for c in key), pa.array(line.astype(np.int32)),
                *(pa.array(v[which, line], mask=m[which, line]) for v, m in values)]

    def work(batches):
        with np.errstate(all="ignore"):
            for batch in batches:
                for at in range(0, len(batch), ROWS):  # bounds the arrays of a step
                    made = columns(batch.slice(at, ROWS))
                    yield pa.RecordBatch.from_arrays(made, [f"c{i}" for i in range(len(made))])

    return work


def met_pieces(pixels: DataFrame, candidates: DataFrame, lines: Sequence[tuple] = LINES,
               piece: int = METRIC_PIECE) -> DataFrame:
    """Pairs of a piece of a spectrum and a batch of stretches that lie about there.

    Pixels are packed into rows of at most ``piece`` neighbours.  The stretch of a
    spectrum that a line of a candidate looks at, and the stretch of a piece, are filed
    under the bins they touch; there are as many bins as pieces, so a stretch meets only
    pieces about where it lies, whatever the spectrum's length.  The stretches of a bin
    are dealt into batches of some CHUNK.
    """
    rest_lo, rest_hi = _bands(lines)
    pieces = _packed(pixels.withColumn("piece", F.expr(f"pix div {piece}")), "SPECID", "piece").withColumns(
        {"lo": F.array_min("wave"), "hi": F.array_max("wave")})
    span = written(pixels.groupBy("SPECID").agg(
        F.min("wave").alias("from"), F.max("wave").alias("to"),
        F.countDistinct(F.expr(f"pix div {piece}")).alias("bins")).join(
        candidates.groupBy("SPECID").agg(F.count("*").alias("n")), "SPECID").withColumn(
        "deals", F.expr(f"n * {len(lines)} div (bins * {CHUNK}) + 1")).drop("n"), "spans")

    def binned(df: DataFrame) -> DataFrame:
        width = F.when(F.col("to") > F.col("from"), (F.col("to") - F.col("from")) / F.col("bins")).otherwise(F.lit(1.0))

        def bin_of(value: Column) -> Column:
            return F.floor((value - F.col("from")) / width)

        inside = df.join(span, "SPECID").where((F.col("hi") >= F.col("from")) & (F.col("lo") <= F.col("to")))
        first = bin_of(F.greatest("lo", "from"))
        return inside.withColumn("first", first).withColumn("bin", F.explode(F.sequence(
            F.col("first"), bin_of(F.least("hi", "to"))))).drop("from", "to", "bins", "lo", "hi")

    stretch = F.array(*[F.struct(F.lit(i).alias("line_index"), F.lit(float(rest_lo[i].min())).alias("lo"),
                                 F.lit(float(rest_hi[i].max())).alias("hi")) for i in range(len(lines))])
    shifted = 1.0 + F.col("Z_TRY")
    wanted = candidates.where("Z_TRY IS NOT NULL").select(*CANDIDATE_KEY, "Z_TRY", F.explode(stretch).alias("s")).select(
        *CANDIDATE_KEY, shifted.alias("shift"), "s.line_index",
        (shifted * F.col("s.lo")).alias("lo"), (shifted * F.col("s.hi")).alias("hi"))
    dealt = binned(wanted).withColumn(
        "batch", F.pmod(F.xxhash64("peak_pix", "try_order", "line_index"), F.col("deals")))
    batches = dealt.groupBy("SPECID", "bin", "batch").agg(*[F.collect_list(c).alias(c) for c in (
            "peak_pix", "try_order", "shift", "line_index", "first")])
    return binned(pieces).drop("deals").withColumnRenamed("first", "begins").join(batches, ["SPECID", "bin"])


def line_sums(pixels: DataFrame, candidates: DataFrame, lines: Sequence[tuple] = LINES,
              piece: int = METRIC_PIECE) -> DataFrame:
    """Pixels, flux and ivar in the peak (0), blue (1) and red (2) interval of each line,
    for spectra of any length.

    A stretch and a piece that share several bins are taken in the first.  Sums over
    pieces add up; a flux or ivar that is missing or not finite makes its sum missing.
    """
    met, kinds = met_pieces(pixels, candidates, lines, piece), dict(candidates.dtypes)
    columns = ", ".join([f"n{i} BIGINT" for i in range(3)] + [f"{c}{i} DOUBLE" for c in "fv" for i in range(3)])
    partial = met.mapInArrow(_piece_summer(*_bands(lines)), ", ".join(
        [*(f"{c} {kinds[c]}" for c in CANDIDATE_KEY), "line_index INT", columns]))
    total = partial.groupBy(*CANDIDATE_KEY, "line_index").agg(
        *[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "nfv" for i in range(3)])
    return total.withColumns({
        f"{c}{i}": F.when(F.col(f"{c}{i}") < F.lit(float("inf")), F.col(f"{c}{i}"))
        for c in "fv" for i in range(3)})


def _piece_summer(rest_lo: np.ndarray, rest_hi: np.ndarray):
    """Task over pairs of a piece and the stretches of a bin: sums of each stretch."""
    sums = _summer(rest_lo, rest_hi)

    def of_pair(batch: pa.RecordBatch, row: int) -> list:
        def values(name: str) -> np.ndarray:
            return batch.column(name)[row].values.to_numpy(zero_copy_only=False)

        here = np.maximum(values("first"), batch.column("begins")[row].as_py()) == batch.column("bin")[row].as_py()
        line = values("line_index")[here]
        n, f, v = sums(values("wave"), values("flux"), values("ivar"), values("shift")[here], line)
        some = np.flatnonzero(n.any(axis=1))
        ids = batch.column("SPECID").take(pa.array(np.full(len(some), row)))
        return [ids, *(batch.column(c)[row].values.filter(pa.array(here)).take(pa.array(some))
                       for c in ("peak_pix", "try_order", "line_index")),
                *(pa.array(t[some, i]) for t in (n, f, v) for i in range(3))]

    def work(batches):
        for batch in batches:
            for row in range(len(batch)):
                made = of_pair(batch, row)
                yield pa.RecordBatch.from_arrays(made, [f"c{i}" for i in range(len(made))])

    return work


def _metrics(sums: DataFrame) -> DataFrame:
    whole = sums.where("n0 > 0 AND n1 > 0 AND n2 > 0 AND n1 >= n0 div 2 AND n2 >= n0 div 2")
    peak, blue, red = (F.col(f"f{i}") / F.col(f"n{i}") for i in range(3))
    weighted = F.expr("v0 <> 0 AND v1 <> 0 AND v2 <> 0")
    metrics = whole.withColumn("continuum", blue + red).where("continuum <> 0").withColumns({
        "ratio": 2.0 * peak / F.col("continuum"),
        "ratio2": F.abs((red - blue) / F.col("continuum")),
    })
    error = F.when(weighted, F.sqrt(
        F.try_divide(F.lit(4.0), F.col("v0"))
        + F.col("ratio") * F.col("ratio")
        * ((F.try_divide(F.lit(1.0), F.col("v1")) + F.try_divide(F.lit(1.0), F.col("v2"))) / 4.0)
    )) / F.abs("continuum")
    return metrics.withColumn("error", error).select(
        *CANDIDATE_KEY, "line_index", "ratio",
        ratio(F.col("ratio") - 1.0, F.col("error")).alias("ratio_sn"), "ratio2")


def metric_columns(lines: Sequence[tuple] = LINES) -> list[str]:
    return [f"{line[0].upper()}_{kind}" for line in lines
            for kind in ("RATIO", "RATIO_SN", "RATIO2")]


def pivoted_metrics(metrics: DataFrame, lines: Sequence[tuple] = LINES) -> DataFrame:
    """Long metrics -> one row per candidate with {LINE}_RATIO, _RATIO_SN, _RATIO2.

    A candidate gathers at most one entry per line.
    """
    gathered = metrics.groupBy(*CANDIDATE_KEY).agg(F.expr(
        "map_from_entries(collect_list(named_struct('line', line_index, 'm', "
        "named_struct('RATIO', ratio, 'RATIO_SN', ratio_sn, 'RATIO2', ratio2)))) AS found"))
    return gathered.selectExpr(*CANDIDATE_KEY, *[
        f"try_element_at(found, {index}).{kind} AS {line[0].upper()}_{kind}"
        for index, line in enumerate(lines) for kind in ("RATIO", "RATIO_SN", "RATIO2")])


def candidate_table(candidates: DataFrame, metrics: DataFrame,
                    lines: Sequence[tuple] = LINES) -> DataFrame:
    """Wide candidate table; candidates without a measurable line keep NULL metrics."""
    return (candidates.join(pivoted_metrics(metrics, lines), list(CANDIDATE_KEY), "left")
            .select(*CANDIDATE_KEY, *metric_columns(lines), "Z_TRY", "PEAK_SIGNIFICANCE",
                    "ASSUMED_LINE"))


def with_unpeaked(table: DataFrame, spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """Add one row (ASSUMED_LINE 'none', all metrics NULL) per spectrum without peaks.

    A spectrum whose peaks all have negative trial redshifts gets no row.
    """
    bare = (spectra.select("SPECID").join(peaks.select("SPECID"), "SPECID", "left_anti")
            .withColumn("ASSUMED_LINE", F.lit("none")))
    return table.unionByName(bare, allowMissingColumns=True)


def attach_metadata(table: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata columns (one row per SPECID) first, then the candidate columns."""
    names = [c for c in metadata.columns if c != "SPECID"]
    joined = table.join(metadata, "SPECID")
    return joined.select("SPECID", *names, *[c for c in table.columns if c != "SPECID"])


def pixel_metrics(pixels: DataFrame, peaks: DataFrame, num_pixels: int = NUM_PIXELS) -> DataFrame:
    """Flux and ivar of the ``num_pixels`` pixels on each side of every peak.

    Each peak asks for its 2*num_pixels neighbours by position, so the join is on
    (SPECID, pix) and the gathered list never exceeds 2*num_pixels entries.
    Columns FLUX_-k, IVAR_-k (left) and FLUX_k, IVAR_k (from the peak on); NULL
    outside the spectrum.
    """
    wanted = (peaks.select("SPECID", F.col("pix").alias("peak_pix"))
              .withColumn("offset", F.explode(F.sequence(F.lit(-num_pixels),
                                                         F.lit(num_pixels - 1))))
              .withColumn("pix", F.col("peak_pix") + F.col("offset")))
    found = wanted.join(pixels.select("SPECID", "pix", "flux", "ivar"), ["SPECID", "pix"], "left")
    gathered = found.groupBy("SPECID", "peak_pix").agg(
        F.map_from_entries(F.collect_list(
            F.struct("offset", F.struct("flux", "ivar")))).alias("__near"))
    columns = []
    for k in range(-num_pixels, num_pixels):
        # left pixels carry a minus sign in both names, so names stay unique
        near = F.try_element_at("__near", F.lit(k))
        columns += [near["flux"].alias(f"FLUX_{k}"), near["ivar"].alias(f"IVAR_{k}")]
    return gathered.select("SPECID", "peak_pix", *columns)


def pixel_metric_columns(num_pixels: int = NUM_PIXELS) -> list[str]:
    return [f"FLUX_{k}" for k in range(-num_pixels, num_pixels)]


def require_truth(df: DataFrame) -> None:
    """Training and test need the true redshift and class."""
    missing = [c for c in ("Z_TRUE", "CLASS_PERSON") if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are needed in training and test")


def correct_redshift(tolerance: float = REDSHIFT_TOLERANCE) -> Column:
    return F.coalesce((F.col("CLASS_PERSON") != STAR)
                      & F.col("DELTA_Z").between(-tolerance, tolerance), F.lit(False))


def is_line(lines: Sequence[tuple] = LINES, tolerance: float = REDSHIFT_TOLERANCE) -> Column:
    """Correct, or a quasar whose redshift is right if another line made the peak."""
    waves = [float(line[1]) for line in lines]
    where = line_position(lines)
    assumed = reduce(lambda c, item: c.when(F.col("ASSUMED_LINE") == item[0], item[1]),
                     [(name, waves[i]) for name, i in where.items() if i >= 0],
                     F.when(F.lit(False), F.lit(None).cast("double")))
    others = any_of([
        (F.col("ASSUMED_LINE") != line[0])
        & (assumed / F.lit(waves[i]) * (1 + F.col("Z_TRY")) - 1 - F.col("Z_TRUE")).between(
            -tolerance, tolerance)
        for i, line in enumerate(lines)
    ])
    quasar = F.col("CLASS_PERSON").isin(*QUASAR_CLASSES)
    return F.coalesce(F.col("IS_CORRECT") | (quasar & F.coalesce(others, F.lit(False))),
                      F.lit(False))


def with_truth(table: DataFrame, tolerance: float = REDSHIFT_TOLERANCE,
               lines: Sequence[tuple] = LINES) -> DataFrame:
    """Add DELTA_Z, CORRECT_REDSHIFT, IS_CORRECT and IS_LINE."""
    require_truth(table)
    return (table.withColumn("DELTA_Z", F.col("Z_TRY") - F.col("Z_TRUE"))
            .withColumn("CORRECT_REDSHIFT", correct_redshift(tolerance))
            .withColumn("IS_CORRECT", F.col("CORRECT_REDSHIFT")
                        & F.coalesce(F.col("CLASS_PERSON").isin(*QUASAR_CLASSES), F.lit(False)))
            .withColumn("IS_LINE", is_line(lines, tolerance)))


def split_valid(spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) array-form spectra: arrays present, non-empty, same length."""
    size = F.size("flux")
    fine = F.coalesce((size > 0) & (F.size("wave") == size) & (F.size("ivar") == size)
                      & F.col("SPECID").isNotNull(), F.lit(False))
    return spectra.where(fine), spectra.where(~fine)


def merged(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenation; columns a table lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
