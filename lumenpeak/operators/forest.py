"""Features, labels, random forests, scoring, predicted class and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import (RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpeak.functions.shared import written
from lumenpeak.functions.constants import (CLASS_LABELS, LINES, MAX_DEPTH, MISSING_FEATURE,
                                           NUM_TREES, RANDOM_STATE, SPLIT_REDSHIFT,
                                           WRONG_REDSHIFT_CLASS)
from lumenpeak.operators.candidates import pixel_metric_columns

# Trees travel to the executors in groups of at most this many bytes of nodes, and a
# single tree may not be larger than the second bound.
BROADCAST_MODEL_BYTES = 64 << 20
TREE_BYTES = 512 << 20


# --- features and labels ----------------------------------------------------


def feature_columns(lines: Sequence[tuple] = LINES, num_pixels: int = 0,
                    extra: Sequence[str] = ()) -> list[str]:
    """Signal-to-noise, ratio2 and ratio of every line, pixel fluxes, significance, extras."""
    names = [line[0].upper() for line in lines]
    columns = [f"{n}_{kind}" for kind in ("RATIO_SN", "RATIO2", "RATIO") for n in names]
    if num_pixels:
        columns += pixel_metric_columns(num_pixels)
    return columns + ["PEAK_SIGNIFICANCE"] + [c.upper() for c in extra]


def filled(column: str | Column) -> Column:
    """Missing feature -> the fixed fill value."""
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c), MISSING_FEATURE).otherwise(c)


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: filled(c) for c in columns})


def training_class() -> Column:
    """CLASS_PERSON, or its wrong-redshift class where CORRECT_REDSHIFT is false."""
    wrong = ~F.coalesce(F.col("CORRECT_REDSHIFT"), F.lit(False))
    chain = reduce(
        lambda c, item: c.when(wrong & (F.col("CLASS_PERSON") == item[0]), item[1]),
        WRONG_REDSHIFT_CLASS.items(), F.when(F.lit(False), F.lit(None).cast("int")))
    return chain.otherwise(F.col("CLASS_PERSON")).cast("int")


def split_side(split: bool = True, at: float = SPLIT_REDSHIFT) -> Column:
    """Which forest a row belongs to; NULL for rows without a trial redshift (NULL or
    NaN) and, where one forest takes all, for negative ones."""
    z = F.col("Z_TRY").cast("double")
    z = F.when(~F.isnan(z), z)
    if not split:
        return F.when(z >= 0, "all")
    return F.when(z >= at, "high").when(z < at, "low")


# --- training ---------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """A fitted forest and the class label behind each of its probabilities."""

    model: RandomForestClassificationModel
    labels: tuple[int, ...]
    features: tuple[str, ...]

    def importances(self) -> list[tuple[str, float]]:
        return list(zip(self.features, (float(v) for v in self.model.featureImportances.toArray())))

    def tree_importances(self) -> list[list[float]]:
        return [[float(v) for v in tree.featureImportances.toArray()]
                for tree in self.model.trees]


@dataclass(frozen=True)
class NodeForest:
    """A forest given as trees: a table with the columns of ``read_nodes``."""

    nodes: DataFrame
    labels: tuple[int, ...]
    features: tuple[str, ...]
    depth: int


def tree_depth(nodes: DataFrame) -> int:
    """Splits on the longest way from a root to a leaf, found level by level."""
    inner = written(nodes.where("left >= 0").select("tree", "node", "left", "right"), "inner-nodes")
    most = inner.count()
    level, depth = inner.where("node = 0"), 0
    while not level.isEmpty():
        depth += 1
        if depth > most:
            raise ValueError("a node of a tree is below itself")
        below = level.select("tree", F.explode(F.array("left", "right")).alias("node"))
        level = written(below.join(inner, ["tree", "node"]), "level")
    return depth


def class_counts(df: DataFrame) -> dict[int, int]:
    """Rows per training class (at most one row per class reaches the driver)."""
    return {r["label_class"]: r["n"] for r in
            df.groupBy(training_class().alias("label_class")).agg(F.count("*").alias("n"))
            .collect() if r["label_class"] is not None}


def balanced_weight(counts: dict[int, int]) -> dict[int, float]:
    """n / (classes * n_class): every class carries the same total weight."""
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def _lookup(column: Column, table: dict) -> Column:
    return reduce(lambda c, item: c.when(column == item[0], F.lit(item[1])), table.items(),
                  F.when(F.lit(False), F.lit(None)))


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector, filling missing values."""
    names = [f"__f{i}" for i in range(len(features))]
    wide = df.withColumns({n: filled(c) for n, c in zip(names, features)})
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def train_forest(df: DataFrame, features: Sequence[str], num_trees: int = NUM_TREES,
                 max_depth: int = MAX_DEPTH, seed: int = RANDOM_STATE) -> Forest:
    """Class-balanced random forest on the training classes."""
    counts = class_counts(df)
    labels = tuple([c for c in CLASS_LABELS if c in counts]
                   + sorted(c for c in counts if c not in CLASS_LABELS))
    index = {c: float(i) for i, c in enumerate(labels)}
    target = training_class()
    rows = (assembled(df, features)
            .select("features", _lookup(target, index).alias("label"),
                    _lookup(target, balanced_weight(counts)).alias("weight"))
            .where("label IS NOT NULL"))
    model = RandomForestClassifier(
        numTrees=num_trees, maxDepth=max_depth, seed=seed, weightCol="weight",
        featureSubsetStrategy="sqrt").fit(rows)
    return Forest(model, labels, tuple(features))


def train(df: DataFrame, features: Sequence[str], split: bool = True, num_trees: int = NUM_TREES,
          max_depth: int = MAX_DEPTH, seed: int = RANDOM_STATE,
          options: dict[str, dict[str, int]] | None = None) -> dict[str, Forest]:
    """Forests for high and low trial redshift, or one for all of them.

    ``options`` gives a side its own num_trees or max_depth.
    """
    rows = df.where("Z_TRY >= 0")
    sides = ("high", "low") if split else ("all",)
    common = {"num_trees": num_trees, "max_depth": max_depth}
    return {side: train_forest(rows.where(split_side(split) == side), features, seed=seed,
                               **{**common, **(options or {}).get(side, {})}) for side in sides}


# --- scoring ----------------------------------------------------------------


KEYS = ("SPECID", "peak_pix", "try_order")


def class_probabilities(df: DataFrame, forests: dict[str, Forest | NodeForest]) -> DataFrame:
    """Add PROB_CLASS{c}; each row is scored by the forest of its redshift side.

    Rows without a trial redshift (NULL or NaN) keep NULL probabilities.  ``branch`` (0 high or
    all, 1 low, 2 none) is the order in which ties are broken.
    """
    split = "all" not in forests
    labels = sorted({c for f in forests.values() for c in f.labels}, key=_label_order)
    parts = []
    for branch, (side, forest) in enumerate(sorted(forests.items())):
        rows = df.where(split_side(split) == side)
        if isinstance(forest, NodeForest):
            vectors = rows.withColumn("__x", F.array(*[filled(c) for c in forest.features]))
            scored, values = with_scores(vectors, forest.nodes, len(forest.labels), "__p", "__x",
                                         forest.depth), F.col("__p")
        else:
            scored = forest.model.transform(assembled(rows, forest.features))
            values = vector_to_array("probability")
        parts.append(scored.withColumns({
            f"PROB_CLASS{c}": (values[forest.labels.index(c)] if c in forest.labels
                               else F.lit(None).cast("double")) for c in labels})
            .withColumn("branch", F.lit(branch))
            .select(*df.columns, *[f"PROB_CLASS{c}" for c in labels], "branch"))
    parts.append(df.where(split_side(split).isNull()).withColumns(
        {f"PROB_CLASS{c}": F.lit(None).cast("double") for c in labels})
        .withColumn("branch", F.lit(2)))
    return reduce(DataFrame.unionByName, parts)


def _label_order(label: int):
    return (CLASS_LABELS.index(label) if label in CLASS_LABELS else len(CLASS_LABELS), label)


def predicted_class(labels: Sequence[int]) -> Column:
    """Label of the largest positive probability, the first label on ties, else -1."""
    probs = [F.col(f"PROB_CLASS{c}") for c in labels]
    best = F.greatest(*probs) if len(probs) > 1 else probs[0]
    chain = reduce(lambda c, item: c.when((item[1] == best) & (best > 0), item[0]),
                   zip(labels, probs), F.when(F.lit(False), F.lit(None).cast("int")))
    return F.coalesce(chain, F.lit(-1))


def quasar_probability(columns: Sequence[str]) -> Column:
    """Sum of the quasar class probabilities that exist as columns."""
    have = [c for c in ("PROB_CLASS3", "PROB_CLASS30") if c in columns]
    if not have:
        return F.lit(None).cast("double")
    return reduce(lambda a, b: a + b, [F.col(c) for c in have])


def best_per_object(df: DataFrame, tie: Sequence[str], key: str = "SPECID",
                    value: str = "PROB") -> DataFrame:
    """(key, tie columns) of the highest value per key.

    A plain aggregation: map tasks reduce each key before anything is shuffled,
    so one object with very many candidates costs no more than any other.
    """
    known = F.when(~F.isnan(value), F.col(value))  # a NaN is no value
    order = F.struct(known.isNull().alias("missing"), (-known).alias("down"),
                     *[F.col(c) for c in tie])
    return (df.groupBy(key).agg(F.min(order).alias("__best"))
            .select(key, *[F.col("__best")[c].alias(c) for c in tie]))


def with_duplicates(df: DataFrame, tie: Sequence[str] = ("branch", "peak_pix", "try_order"),
                    key: str = "SPECID", value: str = "PROB") -> DataFrame:
    """Flag all but the best candidate of each object.

    ``tie`` orders equal probabilities and must identify a row within its object.
    """
    best = best_per_object(df, tie, key, value).select(
        F.col(key).alias("__key"), F.struct(*tie).alias("__best"))
    return (df.join(best, df[key].eqNullSafe(F.col("__key")), "left")
            .withColumn("DUPLICATED", ~F.struct(*tie).eqNullSafe(F.col("__best")))
            .drop("__key", "__best"))


def classify(df: DataFrame, forests: dict[str, Forest | NodeForest],
             tie: Sequence[str] = ("branch", "peak_pix", "try_order")) -> DataFrame:
    """Probabilities, CLASS_PREDICTED, PROB and DUPLICATED."""
    scored = class_probabilities(df, forests)
    first = forests.get("high") or forests.get("all") or next(iter(forests.values()))
    # written first: the flag reads the scores twice, the forests run once
    scored = written(scored.withColumn("CLASS_PREDICTED", predicted_class(first.labels))
                     .withColumn("PROB", quasar_probability(scored.columns)), "scored")
    return with_duplicates(scored, tie).drop("branch")


# --- node tables ------------------------------------------------------------

NODE_COLUMNS = ("forest", "tree", "node", "left", "right", "feature", "threshold", "proba")


def read_nodes(spark: SparkSession, path: str, forest: str) -> DataFrame:
    """Node table of a forest saved with its own writer.

    left = -1 marks a leaf; ``proba`` are the normalised class fractions.
    """
    saved = spark.read.parquet(f"{path}/data")
    leaf = F.col("nodeData.leftChild") < 0
    stats = F.col("nodeData.impurityStats")
    whole = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    return saved.select(
        F.lit(forest).alias("forest"), F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.when(~leaf, F.element_at("nodeData.split.leftCategoriesOrThreshold", 1))
        .alias("threshold"),
        F.transform(stats, lambda v: F.try_divide(v, whole)).alias("proba"))


def node_importances(spark: SparkSession, path: str) -> DataFrame:
    """(feature, importance) of a forest saved with its own writer, features by position.

    Gain times weight of the nodes that split on a feature, as shares of each tree,
    averaged over the trees.  Features that no node splits on have no row.
    """
    weight = F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, b: a + b)
    split = spark.read.parquet(f"{path}/data").where("nodeData.leftChild >= 0").groupBy(
        F.col("treeID").alias("tree"), F.col("nodeData.split.featureIndex").alias("feature")).agg(
        F.sum(F.col("nodeData.gain") * weight).alias("gain"))
    shares = split.withColumn("share", F.try_divide(
        F.col("gain"), F.sum("gain").over(Window.partitionBy("tree"))))
    total = shares.groupBy("feature").agg(F.sum("share").alias("share"))
    return total.select("feature", F.try_divide(
        F.col("share"), F.sum("share").over(Window.partitionBy())).alias("importance"))


def score_nodes(rows: DataFrame, nodes: DataFrame, num_classes: int,
                keys: Sequence[str] = KEYS,
                features: str = "features", max_depth: int = MAX_DEPTH,
                broadcast_bytes: int = BROADCAST_MODEL_BYTES) -> DataFrame:
    """Mean leaf probabilities over the trees of one forest: keys, p0, p1, ...

    ``rows``: keys and an ARRAY<DOUBLE> of features; goes left where x <= threshold.
    Every row of ``rows`` has a result; nothing is shuffled or joined.
    """
    scored = with_scores(rows.select(*keys, features), nodes, num_classes, "__p", features, max_depth,
                         broadcast_bytes)
    return scored.select(*keys, *[F.col("__p")[i].alias(f"p{i}") for i in range(num_classes)])


def with_scores(rows: DataFrame, nodes: DataFrame, num_classes: int, out: str,
                features: str = "features", max_depth: int = MAX_DEPTH,
                broadcast_bytes: int = BROADCAST_MODEL_BYTES) -> DataFrame:
    """Add ``out``, the mean leaf probabilities of each row.

    Trees travel to the executors as flat arrays, in groups whose size is checked
    first; a row passes the groups one after the other in its own task.  An Arrow
    batch walks one tree at a time, all its rows a level per step, and only the sums
    of their leaves are kept.
    """
    sizes = nodes.groupBy("tree").agg((F.max("node") + 1).alias("n")).orderBy("tree").collect()
    groups, room = [], 0
    for tree, n in sizes:
        size = n * (20 + 8 * num_classes)
        if size > TREE_BYTES:
            raise ValueError(f"tree {tree} takes {size} bytes, more than {TREE_BYTES}")
        if not groups or size > room:
            groups.append([])
            room = broadcast_bytes
        groups[-1].append(tree)
        room -= size
    context, kind = rows.sparkSession.sparkContext, T.ArrayType(T.DoubleType())
    for i, group in enumerate(groups):
        packed = context.broadcast(_flat_trees(nodes.where(F.col("tree").isin(group)), num_classes))
        schema = rows.schema if i else T.StructType([*rows.schema.fields, T.StructField(out, kind)])
        rows = rows.mapInArrow(_walker(packed, features, out, num_classes, max_depth, len(sizes)), schema)
    return rows


def _flat_trees(nodes: DataFrame, num_classes: int) -> list[tuple[np.ndarray, ...]]:
    """(left, right, feature, threshold, proba) of each tree, by node number."""
    table = nodes.select("tree", "node", "left", "right", F.coalesce("feature", F.lit(0)).alias("feature"),
                         F.coalesce("threshold", F.lit(0.0)).alias("threshold"), "proba").toArrow()
    tree = table["tree"].to_numpy()
    order = np.argsort(tree, kind="stable")
    columns = [table[c].to_numpy()[order] for c in ("node", "left", "right", "feature", "threshold")]
    empty = pa.scalar([0.0] * num_classes, table.schema.field("proba").type)
    proba = pc.list_flatten(pc.fill_null(table["proba"], empty)).to_numpy().reshape(-1, num_classes)[order]
    trees = []
    for rows in np.split(np.arange(len(tree)), np.flatnonzero(np.diff(tree[order])) + 1):
        node = columns[0][rows]
        size = int(node.max()) + 1
        flat = []
        for values, kind in zip(columns[1:], (np.int32, np.int32, np.int32, np.float64)):
            placed = np.zeros(size, kind)
            placed[node] = values[rows]
            flat.append(placed)
        leaves = np.zeros((size, num_classes))
        leaves[node] = proba[rows]
        trees.append((*flat, leaves))
    return trees


def _walker(trees, features: str, out: str, num_classes: int, max_depth: int, count: int):
    """Task that adds the shares of a group of ``trees`` (of ``count`` in all) to ``out``."""
    def sums(values: np.ndarray) -> np.ndarray:
        total, every = np.zeros((len(values), num_classes)), np.arange(len(values))
        for left, right, feature, threshold, proba in trees.value:
            node = np.zeros(len(values), np.int32)
            for _ in range(max_depth):
                inner = left[node] >= 0
                if not inner.any():
                    break
                goes = np.where(values[every, feature[node]] <= threshold[node], left[node], right[node])
                node = np.where(inner, goes, node)
            if (left[node] >= 0).any():
                raise ValueError("a tree is deeper than max_depth")
            total += proba[node]
        return total / count

    def work(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(features).flatten().to_numpy(zero_copy_only=False)
            made = sums(x.reshape(len(batch), -1))
            names = batch.schema.names
            if out in names:
                made = made + batch.column(out).flatten().to_numpy().reshape(made.shape)
            offsets = pa.array(np.arange(0, made.size + 1, num_classes, dtype=np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))
            kept = [c for c in names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, out])

    return work
