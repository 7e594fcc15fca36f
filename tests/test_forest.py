"""Labels, probabilities, duplicates and the two ways of walking exported trees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenpeak.operators import forest as E


def test_feature_list():
    names = E.feature_columns(num_pixels=2, extra=["r_mag"])
    assert names[:2] == ["LYB_RATIO_SN", "LYA_RATIO_SN"] and names[14] == "LYB_RATIO2"
    assert names[28] == "LYB_RATIO" and len(names) == 42 + 4 + 1 + 1
    assert names[42:] == ["FLUX_-2", "FLUX_-1", "FLUX_0", "FLUX_1", "PEAK_SIGNIFICANCE", "R_MAG"]


def test_labels_and_fill(spark):
    rows = [(30, False), (3, False), (4, False), (1, False), (3, True), (30, None)]
    df = spark.createDataFrame(rows, "CLASS_PERSON INT, CORRECT_REDSHIFT BOOLEAN")
    assert [r[0] for r in df.select(E.training_class()).collect()] == [305, 35, 45, 1, 3, 305]
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x DOUBLE")
    assert [r[0] for r in E.fill_missing(df, ["x"]).collect()] == [-9999.99, -9999.99, 2.0]


def test_predicted_class(spark):
    rows = [(0.5, 0.5, 0.0), (0.0, 0.0, 0.0), (None, None, None), (0.1, 0.2, 0.7),
            (None, 0.3, 0.3)]
    df = spark.createDataFrame(rows, "PROB_CLASS1 DOUBLE, PROB_CLASS3 DOUBLE, PROB_CLASS30 DOUBLE")
    got = df.select(E.predicted_class([1, 3, 30]), E.quasar_probability(df.columns)).collect()
    assert [r[0] for r in got] == [1, -1, -1, 30, 3]
    assert [r[1] for r in got] == [0.5, 0.0, None, pytest.approx(0.9), 0.6]


def test_duplicates(spark):
    rows = [(1, 0.5, 0, 1), (1, 0.5, 0, 2), (1, 0.9, 1, 3), (2, None, 2, 4), (2, 0.0, 1, 5),
            (3, None, 2, 6), (3, None, 2, 7), (4, 0.4, 1, 8), (4, 0.4, 0, 9)]
    df = spark.createDataFrame(rows, "SPECID BIGINT, PROB DOUBLE, branch INT, cand_id BIGINT")
    out = E.with_duplicates(df, ("branch", "cand_id"))
    kept = {r["SPECID"]: r["cand_id"] for r in out.where("NOT DUPLICATED").collect()}
    assert kept == {1: 3, 2: 5, 3: 6, 4: 9} and out.count() == 9


def table(spark, n=600):
    rng = np.random.default_rng(2)
    label = rng.choice([1, 3, 4, 30], n)
    return spark.createDataFrame(pd.DataFrame({
        "SPECID": np.arange(n) // 3, "peak_pix": np.arange(n), "try_order": 0,
        "A": label + rng.normal(0, 0.2, n), "B": rng.normal(0, 1, n),
        "Z_TRY": np.where(np.arange(n) % 20 == 0, np.nan, rng.uniform(0, 4, n)),
        "CLASS_PERSON": label, "CORRECT_REDSHIFT": rng.uniform(size=n) < 0.5})).withColumn(
        "Z_TRY", F.when(~F.isnan("Z_TRY"), F.col("Z_TRY")))


def test_training_and_exported_trees(spark, tmp_path):
    df = table(spark)
    forests = E.train(df, ["A", "B"], num_trees=8, max_depth=5)
    assert set(forests) == {"high", "low"}
    out = E.classify(df, forests)
    rows = out.collect()
    assert len(rows) == 600
    for r in rows:
        probs = [r[c] for c in out.columns if c.startswith("PROB_CLASS")]
        if r["Z_TRY"] is None:
            assert set(probs) == {None} and r["CLASS_PREDICTED"] == -1
        else:
            assert sum(p or 0.0 for p in probs) == pytest.approx(1.0)
    assert out.where("NOT DUPLICATED").groupBy("SPECID").count().where("count <> 1").count() == 0
    # classes are well separated in A, whether or not the redshift is right
    star = [r["CLASS_PREDICTED"] == 1 for r in rows
            if r["CLASS_PERSON"] == 1 and r["Z_TRY"] is not None]
    assert np.mean(star) > 0.9

    forest = forests["high"]
    assert sum(v for _, v in forest.importances()) == pytest.approx(1.0)
    forest.model.write().save(str(tmp_path / "high"))
    nodes = E.read_nodes(spark, str(tmp_path / "high"), "high")
    assembled = E.assembled(df.where("Z_TRY >= 2.1"), forest.features)
    want = {r["peak_pix"]: r["p"] for r in forest.model.transform(assembled).select(
        "peak_pix", vector_to_array("probability").alias("p")).collect()}
    vectors = assembled.select("SPECID", "peak_pix", "try_order",
                               vector_to_array("features").alias("features"))
    for size in (E.BROADCAST_MODEL_BYTES, 0):  # all trees at once, and one by one
        scored = E.score_nodes(vectors, nodes, len(forest.labels), max_depth=5,
                               broadcast_bytes=size).collect()
        assert len(scored) == len(want)
        for r in scored:
            np.testing.assert_allclose([r[f"p{i}"] for i in range(len(forest.labels))],
                                       want[r["peak_pix"]], atol=1e-9)


def test_single_forest(spark):
    forests = E.train(table(spark), ["A", "B"], split=False, num_trees=4, max_depth=3)
    out = E.class_probabilities(table(spark), forests)
    assert set(forests) == {"all"} and out.count() == 600
    assert {r[0] for r in out.select("branch").distinct().collect()} == {0, 2}


def test_balanced_weights():
    assert E.balanced_weight({1: 30, 3: 10}) == {1: 40 / 60, 3: 2.0}


def test_options_of_each_side(spark):
    forests = E.train(table(spark), ["A", "B"], num_trees=4, max_depth=3,
                      options={"low": {"num_trees": 2}})
    assert forests["high"].model.getNumTrees == 4 and forests["low"].model.getNumTrees == 2


def test_forests_given_as_trees(spark, tmp_path):
    """Trees score as the model they come from, whatever their depth, ties and repeats too."""
    df = table(spark)
    df = df.union(df.limit(5))  # repeated rows
    forests = E.train(df, ["A", "B"], num_trees=5, max_depth=4)
    trees = {}
    for side, forest in forests.items():
        forest.model.write().save(str(tmp_path / side))
        nodes = E.read_nodes(spark, str(tmp_path / side), side)
        assert E.tree_depth(nodes) == max(t.depth for t in forest.model.trees)
        trees[side] = E.NodeForest(nodes, forest.labels, forest.features, E.tree_depth(nodes))
    keys = ("SPECID", "peak_pix", "try_order")
    probs = sorted({f"PROB_CLASS{c}" for f in forests.values() for c in f.labels})

    def rows(given):
        return sorted(E.class_probabilities(df, given).select(
            *keys, *[F.round(p, 9).alias(p) for p in probs]).collect(), key=str)

    assert rows(trees) == rows(forests)
    loop = spark.createDataFrame([(0, 0, 0, 0)], "tree INT, node INT, left INT, right INT")
    with pytest.raises(ValueError, match="below itself"):
        E.tree_depth(loop)


def test_deep_and_odd_trees(spark):
    """Node numbers with gaps, a tree of one leaf, repeated rows, and a tree that is too deep."""
    nodes = spark.createDataFrame(
        [(0, 0, 2, 7, 0, 0.5, [0.0, 0.0]), (0, 2, -1, -1, None, None, [1.0, 0.0]), (0, 7, -1, -1, None, None, [0.0, 1.0]),
         (3, 0, -1, -1, None, None, [0.5, 0.5])],
        "tree INT, node INT, left INT, right INT, feature INT, threshold DOUBLE, proba ARRAY<DOUBLE>")
    rows = spark.createDataFrame([(1, [0.5]), (1, [0.5]), (2, [0.6]), (3, [float("nan")])], "SPECID BIGINT, features ARRAY<DOUBLE>")
    for size in (1 << 20, 0):
        out = sorted(map(tuple, E.score_nodes(rows, nodes, 2, ("SPECID",), broadcast_bytes=size).collect()))
        assert out == [(1, 0.75, 0.25), (1, 0.75, 0.25), (2, 0.25, 0.75), (3, 0.25, 0.75)]
    assert E.score_nodes(rows.limit(0), nodes, 2, ("SPECID",)).count() == 0
    with pytest.raises(Exception, match="deeper than max_depth"):
        E.score_nodes(rows, nodes, 2, ("SPECID",), max_depth=0).collect()
    with pytest.raises(ValueError, match="more than"):
        tree, E.TREE_BYTES = E.TREE_BYTES, 10
        try:
            E.score_nodes(rows, nodes, 2, ("SPECID",))
        finally:
            E.TREE_BYTES = tree
    plan = E.score_nodes(rows, nodes, 2, ("SPECID",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
