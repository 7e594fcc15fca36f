"""The jobs: spectra -> candidates -> model / catalogue / statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpeak.functions.columns import nan_to_null
from lumenpeak.functions.shared import written
from lumenpeak.operators import candidates as C
from lumenpeak.operators import exposures as X
from lumenpeak.operators import forest as E
from lumenpeak.operators import pixels as P
from lumenpeak.operators import statistics as S
from lumenpeak.plans.params import JobParams, peak_finder
from lumenpeak.sources import readers, writers


@dataclass(frozen=True)
class Model:
    """Trained forests and the parameters they were trained with."""

    forests: dict[str, E.Forest | E.NodeForest]
    params: JobParams

    def features(self) -> list[str]:
        return list(next(iter(self.forests.values())).features)


def model_features(params: JobParams) -> list[str]:
    return E.feature_columns(params.lines, params.num_pixels if params.pixels_as_metrics else 0,
                             params.extra_features)


ARRAYS = ("wave", "flux", "ivar", "start", "source")


def observed_spectra(spectra: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Spectra with a key of their own in SPECID (the object's id moves to ``__object``),
    and the rows that cannot be told apart, or None where that cannot happen.

    An object may have been observed several times, and its spectra may be equal in all
    metadata.  A row without ``start`` is a spectrum by itself.  Rows with ``start`` that
    are equal in all metadata are pieces of one spectrum.  Where a ``start`` repeats among
    them, they are spectra of one piece each if all have the same one, else spectra of the
    file that ``source`` names; if it repeats in one file too, nothing tells the
    spectra apart.
    """
    named = [c for c in spectra.columns if c not in ARRAYS]
    # the row's number is given once, so it is written
    rows = written(spectra.withColumns({
        "__object": F.col("SPECID"), "__same": F.xxhash64(F.to_json(F.struct(*named))),
        "__row": F.monotonically_increasing_id()}), "observations")
    own, key, made = F.xxhash64("__same", "__row"), F.col("__same"), ("__same", "__row", "__file")
    if "start" not in spectra.columns:
        return rows.withColumn("SPECID", own).drop(*made), None
    rows = rows.withColumn("__file", F.coalesce("source", F.lit("")) if "source" in spectra.columns else F.lit(""))
    counts = F.count("*").alias("n"), F.countDistinct("start").alias("starts"), F.min("start").alias("least"), F.max("start").alias("most")
    by_file = rows.where("start IS NOT NULL").groupBy("__same", "__file").agg(*counts)
    verdict = by_file.groupBy("__same").agg(
        (F.min("least") == F.max("most")).alias("__single"), (F.sum("n")).alias("n"),
        F.max(F.col("n") > F.col("starts")).alias("__mixed"))
    # of a group: do starts repeat over all its files?
    distinct = rows.where("start IS NOT NULL").groupBy("__same").agg(F.countDistinct("start").alias("starts"))
    repeated = written(verdict.join(distinct, "__same").where("n > starts").select("__same", "__single", "__mixed"), "repeated")
    rows = rows.join(repeated, "__same", "left")
    alone = F.col("start").isNull() | F.coalesce("__single", F.lit(False))
    lost = ~alone & F.coalesce("__mixed", F.lit(False))
    made = (*made, "__single", "__mixed")
    told = rows.where(~lost).withColumns({
        "SPECID": F.when(alone, own).when(F.col("__mixed").isNotNull(), F.xxhash64("__same", "__file")).otherwise(key),
        "start": F.coalesce("start", F.lit(0))}).drop(*made)
    return told, rows.where(lost).select(*spectra.columns)


def unusable_spectra(spectra: DataFrame) -> DataFrame:
    """Rows that ``find_candidates`` leaves out: uneven or missing arrays, and pieces of
    several spectra that nothing tells apart."""
    valid, bad = C.split_valid(spectra)
    mixed = observed_spectra(valid)[1] if "start" in spectra.columns else None
    return bad if mixed is None else bad.unionByName(mixed)


def named_again(df: DataFrame) -> DataFrame:
    """Undo ``observed_spectra``; the key stays as the last column, SPECTRUM."""
    rest = [c for c in df.columns if c not in ("SPECID", "__object")]
    return df.select(F.col("__object").alias("SPECID"), *rest, F.col("SPECID").alias("SPECTRUM"))


def find_candidates(spectra: DataFrame, params: JobParams) -> DataFrame:
    """Candidate table of array-form spectra.

    Columns other than the arrays are metadata.  Every spectrum is treated by itself,
    also where several share a SPECID; SPECTRUM tells them apart.  Unusable spectra are
    left out here; ``run`` writes them to ``unusable_spectra``.  Truth columns are added where they are
    required, and in candidates mode if Z_TRUE is there.
    """
    if params.mode == "merge":
        raise ValueError("merge mode does not look for candidates")
    if params.truth_needed:
        C.require_truth(spectra)
    valid, _ = C.split_valid(spectra)
    valid, _ = observed_spectra(valid)
    metadata = valid.drop("wave", "flux", "ivar", "start", "source").dropDuplicates(["SPECID"])
    pixels = P.to_pixels(valid)
    # peaks feed the candidates, the metrics and the no-peak rows
    peaks = written(peak_finder(params.peak_finder, params.peak_finder_options)(pixels), "peaks")
    trials = C.trial_redshifts(peaks, params.lines, params.try_lines)
    table = C.measured_candidates(pixels, trials, params.lines)
    if params.pixels_as_metrics:
        near = C.pixel_metrics(pixels, peaks, params.num_pixels)
        table = table.join(near, ["SPECID", "peak_pix"])
    table = C.attach_metadata(C.with_unpeaked(table, metadata, peaks), metadata)
    if params.truth_needed or (params.mode == "candidates" and "Z_TRUE" in table.columns):
        table = C.with_truth(table, params.z_precision, params.lines)
    return named_again(table)


def train_model(table: DataFrame, params: JobParams) -> Model:
    if "training" not in params.mode:
        raise ValueError(f"a model is trained in training mode only, not in {params.mode}")
    forests = E.train(table, model_features(params), params.split, params.num_trees,
                      params.max_depth, params.seed, params.forest_options)
    return Model(forests, params)


# ``depth`` is there for forests that are given as trees
INFO = "side STRING, labels ARRAY<INT>, features ARRAY<STRING>, params STRING, depth INT"


def save_model(model: Model, path: str) -> None:
    """Forests, node tables, labels and parameters under one folder."""
    spark = SparkSession.getActiveSession()
    for side, forest in model.forests.items():
        if isinstance(forest, E.NodeForest):
            nodes = forest.nodes
        else:
            forest.model.write().overwrite().save(f"{path}/{side}")
            nodes = E.read_nodes(spark, f"{path}/{side}", side)
        nodes.drop("forest").write.mode("overwrite").parquet(f"{path}/nodes/forest={side}")
    rows = [(side, list(f.labels), list(f.features), model.params.to_json(),
             f.depth if isinstance(f, E.NodeForest) else None) for side, f in model.forests.items()]
    spark.createDataFrame(rows, INFO).coalesce(1).write.mode("overwrite").json(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> Model:
    info = spark.read.schema(INFO).json(f"{path}/info").collect()
    forests = {}
    for r in info:
        labels, features, side = tuple(r["labels"]), tuple(r["features"]), r["side"]
        if r["depth"] is None:
            forests[side] = E.Forest(RandomForestClassificationModel.load(f"{path}/{side}"),
                                     labels, features)
        else:
            forests[side] = E.NodeForest(spark.read.parquet(f"{path}/nodes/forest={side}"),
                                         labels, features, r["depth"])
    return Model(forests, JobParams.from_json(info[0]["params"]))


def stored_trees(spark: SparkSession, path: str, params: JobParams) -> Model:
    """Model of a JSON document of trees, with the parameters it was trained with."""
    return Model(readers.read_model_json(spark, path, model_features(params)), params)


def classify(table: DataFrame, model: Model) -> DataFrame:
    tie = ("branch", "peak_pix", "try_order", *[c for c in ("SPECTRUM",) if c in table.columns])
    return E.classify(table, model.forests, tie)


def merge_candidates(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return readers.read_candidates(spark, paths)


def merge_files(spark: SparkSession, params: JobParams, output: str, paths: Sequence[str],
                model: Model | None = None, truth: DataFrame | None = None) -> Result:
    """``run`` over candidate files; the table ``files`` tells what each of them gave.

    Files that are damaged, or gave a part of their rows, do not end the job: look for
    states other than ``read`` and ``empty``.
    """
    files = readers.candidate_files(spark, paths)
    writers.write_candidates(files, f"{output}/files")
    listed = spark.read.schema(files.schema).parquet(f"{output}/files")
    if listed.where("rows_read > 0").isEmpty():
        raise ValueError(f"no candidates can be read; see {output}/files")
    result = run(params, output, candidates=merge_candidates(spark, paths), model=model, truth=truth)
    result.files = listed
    return result


def format_spectra(catalogue: DataFrame, files: DataFrame, sky: DataFrame,
                   margin: float = P.SKY_MARGIN, confident_only: bool = False, noise: float = 1,
                   rebin_width: float = 0, extend: float = 0, tray: str | None = None,
                   forbidden: Sequence[tuple[float, float]] = (), single_plate: int = 0,
                   plates: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Survey catalogue and spectra -> array-form spectra with metadata.

    Catalogue filters come first, so only the chosen spectra are joined; then
    masks, noise, rebinning and filter selection, in this order.  Every file row is a
    spectrum by itself, also where a catalogue row has several; of rows with ``start``,
    those that ``unusable_spectra`` gives for the joined rows are left out.
    """
    if plates is not None:
        good = readers.good_plates(plates, single_plate)
        catalogue = catalogue.join(good, "PLATE", "left_semi")
    elif single_plate:
        catalogue = catalogue.where(F.col("PLATE") == single_plate)
    if confident_only:
        catalogue = P.keep_confident(catalogue)
    spectra, _ = observed_spectra(P.catalogue_spectra(catalogue, files))
    arrays = ("wave", "flux", "ivar")
    metadata = spectra.select(*[c for c in spectra.columns if c not in (*arrays, "start")])
    pixels = P.mask_sky(P.to_pixels(spectra), sky, margin)
    if forbidden:
        pixels = P.mask_ranges(pixels, forbidden)
    pixels = P.add_noise(pixels, noise, seed)
    if rebin_width > 0:
        pixels = P.rebin(pixels, rebin_width, extend)
    if tray:
        pixels = P.drop_tray_filters(pixels, tray)
    if rebin_width > 0 or tray:
        pixels = X.numbered_pixels(pixels.select("SPECID", *arrays))
    packed = writers.to_spectra(pixels.select("SPECID", "pix", *arrays))
    return named_again(packed.join(metadata.dropDuplicates(["SPECID"]), "SPECID")).drop("SPECTRUM")


def format_arms(pixels: DataFrame, catalogue: DataFrame | None = None,
                magnitudes: DataFrame | None = None, fibres: DataFrame | None = None,
                order: Sequence[str] = ("SPECID",), red: str = "red") -> DataFrame:
    """Two-arm pixels (with ``sens``) -> array-form spectra with Z_TRUE, GMAG and RMAG.

    Spectra whose red arm is one constant are left out, and with ``fibres`` (SPECID,
    fib_status) those of fibres that are not active.  ``catalogue`` (SPECID, Z) and
    ``magnitudes`` (SPECID, GMAG, RMAG) give their first row in ``order`` per target;
    what they lack is NULL.
    """
    if fibres is not None:
        active = P.keep_active_fibres(fibres).select("SPECID")
        pixels = pixels.join(active, "SPECID", "left_semi")
    corrected = X.correct_sensitivity(pixels).where(F.col("arm") == red)
    varied = corrected.groupBy("SPECID").agg(
        F.min("flux").alias("lo"), F.max("flux").alias("hi")).where("lo < hi")
    spectra = writers.to_spectra(X.arm_spectra(pixels.join(varied, "SPECID", "left_semi")))
    none = F.lit(None).cast("double")
    if catalogue is None:
        spectra = spectra.withColumn("Z_TRUE", none)
    else:
        spectra = P.attach_first_match(spectra, catalogue.withColumnRenamed("Z", "Z_TRUE"),
                                       "SPECID", order, ["Z_TRUE"])
    if magnitudes is None:
        return spectra.withColumns({"GMAG": none, "RMAG": none})
    return P.attach_first_match(spectra, magnitudes, "SPECID", order, ["GMAG", "RMAG"])


def format_exposures(pixels: DataFrame, fibres: DataFrame, metadata: Sequence[str],
                     single: bool = False, order: Sequence[str] = ("exposure",),
                     points: int = 4000) -> DataFrame:
    """Pixels of several exposures and bands (with ``mask``) -> array-form spectra.

    ``metadata`` columns, upper-cased, come from the target's first row of ``fibres``.
    """
    first = P.metadata(P.first_per_key(fibres, ["SPECID"], order), metadata)
    spectra = writers.to_spectra(X.exposure_spectra(pixels, single, points))
    return spectra.join(first, "SPECID", "left")


def format_photometry(objects: DataFrame, filters: DataFrame, metadata: Sequence[str] = (),
                      trays_only: bool = False) -> DataFrame:
    """Photometric objects -> array-form spectra along the chosen filters."""
    kept = ["FLUX", "RELERR", "FLAGS", "MASK_FLAGS", "TILE_ID", "NUMBER"]
    named = [F.col(c).alias(f"__m{i}") for i, c in enumerate(metadata)]
    pixels = P.photometric_pixels(objects.select(*kept, *named),
                                  P.select_filters(filters, trays_only))
    spectra = writers.to_spectra(pixels, *[f"__m{i}" for i in range(len(metadata))])
    return spectra.withColumnsRenamed({f"__m{i}": c.upper() for i, c in enumerate(metadata)})


@dataclass
class Result:
    """What a run produced; parts a mode does not make are None."""

    candidates: DataFrame | None = None
    model: Model | None = None
    catalogue: DataFrame | None = None
    report: DataFrame | None = None
    sweep: DataFrame | None = None
    optimal: DataFrame | None = None
    finder: DataFrame | None = None
    unusable: DataFrame | None = None
    files: DataFrame | None = None


def run(params: JobParams, output: str, spectra: DataFrame | None = None,
        candidates: DataFrame | Sequence[DataFrame] | None = None, model: Model | None = None,
        truth: DataFrame | None = None) -> Result:
    """Run one mode; tables are written under ``output`` and read back from there.

    Existing ``candidates`` are merged with those found in ``spectra``.
    """
    if model is not None:
        params = params.adopting(model.params)
    tables = [] if candidates is None else (
        [candidates] if isinstance(candidates, DataFrame) else list(candidates))
    if spectra is not None and params.mode != "merge":
        tables.append(find_candidates(spectra, params))
    if not tables:
        raise ValueError("neither spectra nor candidates were given")
    merged = nan_to_null(C.merged(tables))
    session = merged.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        writers.write_candidates(df, f"{output}/{name}")
        return session.read.schema(df.schema).parquet(f"{output}/{name}")

    table = saved(merged, "candidates")
    unusable = None
    if spectra is not None and params.mode != "merge":
        unusable = saved(unusable_spectra(spectra), "unusable_spectra")
    if params.mode in ("merge", "candidates"):
        return Result(candidates=table, unusable=unusable)
    if "training" in params.mode:
        trained = train_model(table, params)
        save_model(trained, f"{output}/model")
        return Result(candidates=table, model=trained, unusable=unusable)
    if model is None:
        raise ValueError(f"mode {params.mode} needs a trained model")
    scored = saved(classify(table, model), "classified")
    result = Result(candidates=scored, model=model, unusable=unusable)
    if params.save_catalogue:
        result.catalogue = saved(writers.catalogue(scored, params.prob_cut), "catalogue")
    if params.mode == "test" and params.run_stats and truth is not None:
        result.report = S.probability_report(truth, scored, params.report_cuts)
        result.sweep = saved(S.threshold_sweep(scored, truth), "threshold_sweep")
        result.optimal = saved(S.optimal_threshold(result.sweep), "optimal_threshold")
        result.finder = saved(S.peak_finder_completeness(scored, truth), "peak_finder_study")
    return result
