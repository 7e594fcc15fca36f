"""Readers: spectra, candidates, catalogues, lines, small text inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpeak.functions.columns import nan_to_null
from lumenpeak.functions.constants import LINE_COLUMNS
from lumenpeak.functions.shared import written
from lumenpeak.operators.forest import NodeForest, tree_depth

_ARRAY = T.StructType([T.StructField("np.ndarray", T.StructType([
    T.StructField("data", T.ArrayType(T.DoubleType())), T.StructField("dtype", T.StringType())]))])


def spectra_json_schema(metadata: str) -> T.StructType:
    """Schema of a spectra file; ``metadata`` is a DDL list such as "specid BIGINT"."""
    meta = T.StructType.fromDDL(metadata)
    one = T.StructType([T.StructField(n, _ARRAY) for n in ("flux", "ivar", "wave")]
                       + [T.StructField("metadata", meta)])
    return T.StructType([T.StructField("spectra_list", T.ArrayType(one))])


def read_spectra_json(spark: SparkSession, paths: str | Sequence[str] | None,
                      metadata: str) -> DataFrame | None:
    """Spectra of one or more JSON files in array form; None without input.

    Files are read in parallel.  Each is one JSON document: convert large
    collections once to a table with ``write_spectra``.
    """
    if not paths:
        return None
    schema = spectra_json_schema(metadata)
    names = [f.name for f in T.StructType.fromDDL(metadata)]
    files = [paths] if isinstance(paths, str) else list(paths)
    documents = spark.read.schema(schema).option("multiLine", True).json(files)
    return spectra_from_documents(documents.withColumn("source", F.input_file_name()), names,
                                  "source")


def spectra_from_documents(documents: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    one = documents.select(*keep, F.explode("spectra_list").alias("s"))

    def data(name: str) -> Column:
        return F.col(f"s.{name}.`np.ndarray`.data").alias(name)

    return nan_to_null(one.select(
        *[F.col(f"s.metadata.`{n}`").alias(n.upper()) for n in names],
        data("wave"), data("flux"), data("ivar"), *keep))


def parse_spectra_json(texts: DataFrame, column: str, metadata: str, *keep: str) -> DataFrame:
    """The same from a column of JSON text."""
    names = [f.name for f in T.StructType.fromDDL(metadata)]
    parsed = texts.withColumn("__d", F.from_json(column, spectra_json_schema(metadata)))
    return spectra_from_documents(parsed.select(*keep, "__d.spectra_list"), names, *keep)


def _node_arrays(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, T.StructType([T.StructField("np.ndarray", T.StructType(
        [T.StructField("data", T.ArrayType(kind))]))]))


def read_model_json(spark: SparkSession, path: str,
                    features: Sequence[str]) -> dict[str, NodeForest]:
    """Forests by redshift side of a stored model, whose trees are parallel arrays.

    ``clf_high`` and ``clf_low``, or ``clf`` alone, hold ``classes`` and ``trees``; a tree's
    ``proba`` is (nodes, 1, classes).  ``features`` are the columns by position.  The
    document becomes a node table once; its labels alone reach the driver.
    """
    doubles = T.ArrayType(T.ArrayType(T.DoubleType()))
    tree = T.StructType([*[_node_arrays(n, T.IntegerType()) for n in (
        "children_left", "children_right", "feature")],
        _node_arrays("threshold", T.DoubleType()), _node_arrays("proba", doubles)])
    forest = T.StructType([_node_arrays("classes", T.IntegerType()),
                           T.StructField("trees", T.ArrayType(tree))])
    sides = {"clf_high": "high", "clf_low": "low", "clf": "all"}
    document = spark.read.schema(T.StructType([T.StructField(n, forest) for n in sides])).option(
        "multiLine", True).json(path)
    given = document.select(F.explode(F.array(*[
        F.struct(F.lit(side).alias("forest"), F.col(f"{n}.classes.`np.ndarray`.data").alias("labels"),
                 F.col(f"{n}.trees").alias("trees")) for n, side in sides.items()])).alias("f")).select(
        "f.*").where("trees IS NOT NULL")

    def data(name: str) -> Column:
        return F.col(f"t.{name}.`np.ndarray`.data").alias(name)

    arrays = given.select("forest", F.posexplode("trees").alias("tree", "t")).select(
        "forest", "tree", F.arrays_zip(*[data(n) for n in tree.names]).alias("z"))
    nodes = written(arrays.select("forest", "tree", F.posexplode("z").alias("node", "n")).select(
        "forest", "tree", "node", F.col("n.children_left").alias("left"),
        F.col("n.children_right").alias("right"), "n.feature", "n.threshold",
        F.flatten("n.proba").alias("proba")), "model-nodes")
    forests = {}
    for row in given.select("forest", "labels").collect():  # at most three
        own = nodes.where(F.col("forest") == row["forest"])
        forests[row["forest"]] = NodeForest(own, tuple(row["labels"]), tuple(features),
                                            tree_depth(own))
    if not forests:
        raise ValueError(f"no forest in {path}")
    return forests


def read_spectra(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Spectra tables, one after the other, with the file each row came from."""
    files = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.parquet(*files).withColumn("source", F.input_file_name())


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def read_candidates(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Candidate tables as one, names upper-cased, missing columns NULL.  Files that cannot
    be read are skipped; ``candidate_files`` lists them."""
    files = [paths] if isinstance(paths, str) else list(paths)
    return nan_to_null(upper_names(
        spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True)
        .parquet(*files)))


FEW_FILES = 10_000
# Files that are listed but gave nothing are looked into up to this size.
LOOKED_INTO = (1 << 31) - 1


def candidate_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, bytes, rows, rows_read, state): every file under the paths and what it gave.

    ``rows`` is what the file's footer promises, ``rows_read`` what can be read with all
    columns.  State ``read``: all rows; ``partial``: some; ``empty``: a sound file without
    rows; ``damaged``: no readable footer, or no readable row.  Files of no bytes are passed
    over by Spark and not listed.  Counting reads all columns
    once, in place; nothing is shuffled but counts per file.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").load(files).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"))
    name = F.col("_metadata.file_path")
    try:
        table = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(*files)
    except AnalysisException as error:  # not one file has a footer
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        promised = given = spark.createDataFrame([], "file STRING, n BIGINT")
    else:
        # without columns only footers are read
        promised = table.groupBy(name.alias("file")).agg(F.count("*").alias("n"))
        given = table.select(name.alias("file"), F.xxhash64(*table.columns).alias("h")).groupBy("file").agg(
            (F.count_if(F.col("h") >= 0) + F.count_if(F.col("h") < 0)).alias("n"))  # a plain count reads no column
    counted = written(listed.join(promised.withColumnRenamed("n", "rows"), "file", "left").join(
        given.withColumnRenamed("n", "rows_read"), "file", "left"), "files")
    silent = counted.where("rows_read IS NULL").select("file")
    # of files that gave nothing, their first and last four bytes tell a sound file
    content = spark.read.format("binaryFile").load(files).where(F.col("length") <= LOOKED_INTO).join(
        F.broadcast(silent) if silent.count() <= FEW_FILES else silent, F.col("path") == F.col("file"), "left_semi")
    mark = F.lit(b"PAR1")
    sound = content.where((F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
                          & (F.col("length") >= 12)).select(F.col("path").alias("file"), F.lit(True).alias("sound"))
    n, seen = F.coalesce("rows", F.lit(0)), F.coalesce("rows_read", F.lit(0))
    return counted.join(sound, "file", "left").select(
        "file", "bytes", n.alias("rows"), seen.alias("rows_read"),
        F.when((seen > 0) & (seen >= n), "read").when(seen > 0, "partial")
        .when(F.col("sound") & (n == 0), "empty").otherwise("damaged").alias("state"))


def truth_catalogue(table: DataFrame, columns: Sequence[str], specid: str,
                    ztrue: str) -> DataFrame:
    """Chosen columns upper-cased, plus SPECID and Z_TRUE as copies of two of them."""
    return table.select(*[F.col(c).alias(c.upper()) for c in columns],
                        F.col(specid).alias("SPECID"), F.col(ztrue).alias("Z_TRUE"))


def frame_from_columns(texts: DataFrame, column: str, fields: str, index: str = "idx",
                       keep: Sequence[str] = ()) -> DataFrame:
    """Column-oriented JSON {col: {row: value}} -> one row per row label.

    ``fields`` is a DDL list.  Every value is exploded once and regrouped per
    row label.
    """
    schema = T.StructType.fromDDL(fields)
    keep = list(keep)
    outer = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), T.StringType()))
                          for f in schema])
    parsed = texts.select(*keep, F.from_json(column, outer).alias("__d"))
    cells = parsed.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.col("__d")[f.name].alias("cells"))
        for f in schema])).alias("__c")).select(
        *keep, "__c.name", F.explode("__c.cells").alias(index, "value"))
    return cells.groupBy(*keep, index).agg(*[
        F.max(F.when(F.col("name") == f.name, F.col("value"))).cast(f.dataType).alias(f.name)
        for f in schema])


def read_catalogue_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Truth catalogue stored as {"pd.DataFrame": "<column-oriented JSON>"}."""
    outer = T.StructType([T.StructField("pd.DataFrame", T.StringType())])
    text = spark.read.schema(outer).option("multiLine", True).json(path)
    return frame_from_columns(text.select(F.col("`pd.DataFrame`").alias("text")), "text",
                              fields).drop("idx")


def read_lines(spark: SparkSession, path: str) -> list[tuple]:
    """Line table (14 or so rows) from column-oriented JSON, in declared order."""
    names = spark.read.schema("WAVE MAP<STRING, DOUBLE>").option("multiLine", True).json(
        path).select(F.map_keys("WAVE").alias("names")).first()["names"]
    text = spark.read.text(path, wholetext=True)
    fields = ", ".join(f"{c} DOUBLE" for c in LINE_COLUMNS[1:])
    rows = {r["idx"]: r for r in frame_from_columns(text, "value", fields).collect()}
    return [(n, *[rows[n][c] for c in LINE_COLUMNS[1:]]) for n in names]


def read_sky_lines(spark: SparkSession, path: str) -> DataFrame:
    """One sky wavelength per text line."""
    return sky_lines(spark.read.text(path))


def sky_lines(text: DataFrame) -> DataFrame:
    return text.select(F.trim("value").try_cast("double").alias("wave")).where(
        "wave IS NOT NULL")


def good_plates(plates: DataFrame, single_plate: int = 0) -> DataFrame:
    """Distinct plates of good quality; one plate only if asked for."""
    good = plates.where("platequality = 'good'").select(F.col("plate").cast("int").alias("PLATE"))
    if single_plate:
        good = good.where(F.col("PLATE") == single_plate)
    return good.distinct()


def read_magnitudes(spark: SparkSession, path: str, columns: Sequence[str],
                    types: dict[str, str] | None = None) -> DataFrame:
    """Whitespace-delimited table with a header line."""
    header = " ".join(columns)
    text = spark.read.text(path)
    squeezed = F.trim(F.regexp_replace("value", r"\s+", " "))
    return split_columns(text.where(squeezed != header), columns, types)


def split_columns(text: DataFrame, columns: Sequence[str],
                  types: dict[str, str] | None = None) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return text.where(F.trim("value") != "").select(*[
        parts[i].cast((types or {}).get(c, "double")).alias(c) for i, c in enumerate(columns)])
