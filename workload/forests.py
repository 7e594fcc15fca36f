"""Feature, training and scoring queries (E)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenpeak.functions.constants import CLASS_LABELS
from lumenpeak.functions.shared import fresh_path
from lumenpeak.operators import forest as E
from lumenpeak.plans import jobs
from lumenpeak.plans.params import JobParams
from lumenpeak.sources import readers as R
from workload.peaks import METRIC_CTES, _wide_sql, wide_table
from workload.views import (ORDERS_CANDIDATES, SCORED, orders_candidates, query, rounded,
                            rounded_sql, scored, table, with_ctes)

FEATURES = E.feature_columns()


@query("e1_feature_list", with_ctes(*METRIC_CTES) + f"""
SELECT (i - 1)::INTEGER AS position, [{', '.join(f"'{c}'" for c in FEATURES)}][i] AS feature,
  n, present[i] AS n_present
FROM (SELECT count(*) AS n, [{', '.join(f'count("{c}")' for c in FEATURES)}] AS present
      FROM ({_wide_sql()})), range(1, {len(FEATURES) + 1}) t(i)""")
def e1(spark, sf):
    wide = wide_table(spark, sf)[1]
    counts = wide.agg(F.count("*").alias("n"), F.array(*[F.count(c) for c in FEATURES]).alias("p"))
    return counts.select("n", F.posexplode("p").alias("position", "n_present")).withColumn(
        "feature", F.element_at(F.array(*[F.lit(c) for c in FEATURES]), F.col("position") + 1))


@query("e2_filled_features", with_ctes(*METRIC_CTES)
       + "SELECT SPECID, peak_pix, try_order, "
       + ", ".join(f'coalesce("{c}", -9999.99e0) AS "{c}"' for c in FEATURES)
       + f" FROM ({_wide_sql()})")
def e2(spark, sf):
    wide = rounded(wide_table(spark, sf)[1]).select("SPECID", "peak_pix", "try_order", *FEATURES)
    return E.fill_missing(wide, FEATURES)


TRAINING_CLASS = """CASE WHEN NOT CORRECT_REDSHIFT AND CLASS_PERSON = 30 THEN 305
  WHEN NOT CORRECT_REDSHIFT AND CLASS_PERSON = 3 THEN 35
  WHEN NOT CORRECT_REDSHIFT AND CLASS_PERSON = 4 THEN 45 ELSE CLASS_PERSON END"""
SIDE = "CASE WHEN Z_TRY >= 2.1e0 THEN 'high' WHEN Z_TRY < 2.1e0 THEN 'low' END"


@query("e3_training_class", with_ctes(SCORED)
       + f"SELECT SPECID, cand_id, {TRAINING_CLASS} AS label_class FROM scored")
def e3(spark, sf):
    return scored(spark, sf).select("SPECID", "cand_id", E.training_class().alias("label_class"))


@query("e4_redshift_split", with_ctes(SCORED)
       + f"""SELECT {SIDE} AS side, {TRAINING_CLASS} AS label_class, count(*) AS n
FROM scored GROUP BY ALL""")
def e4(spark, sf):
    return scored(spark, sf).groupBy(
        E.split_side().alias("side"), E.training_class().alias("label_class")).agg(
        F.count("*").alias("n"))


@query("e5_class_weights", rounded_sql(with_ctes(SCORED) + f"""
SELECT label_class, n, sum(n) OVER () / (count(*) OVER () * n) AS weight
FROM (SELECT {TRAINING_CLASS} AS label_class, count(*) AS n FROM scored GROUP BY ALL)""",
                                        "weight"))
def e5_weights(spark, sf):
    rows = scored(spark, sf)
    weights = E.balanced_weight(E.class_counts(rows))
    label = E.training_class()
    return rounded(rows.groupBy(label.alias("label_class")).agg(F.count("*").alias("n"))
                   .withColumn("weight", E._lookup(F.col("label_class"), weights)), "weight")


MODEL_FEATURES = ("PEAK_SIGNIFICANCE", "Z_TRY", "PROB")


def training_table(spark, sf):
    """Candidates with one row without a trial redshift per ten."""
    return scored(spark, sf).withColumn("Z_TRY", F.when(F.col("cand_id") % 10 != 0,
                                                        F.col("Z_TRY"))).drop("DUPLICATED")


def fitted(rows, trees: int = 12, depth: int = 5):
    return E.train(rows, MODEL_FEATURES, num_trees=trees, max_depth=depth)


@query("e5_forest_fit", with_ctes(SCORED) + f"""
SELECT {SIDE} AS side, 12::BIGINT AS num_trees, count(DISTINCT {TRAINING_CLASS}) AS num_classes
FROM scored WHERE cand_id % 10 <> 0 GROUP BY ALL""")
def e5(spark, sf):
    """Forests of both redshift sides, read back from the node tables they export."""
    forests = fitted(training_table(spark, sf))
    parts = []
    for side, forest in forests.items():
        path = fresh_path(spark, f"forest-{side}")
        forest.model.write().save(path)
        parts.append(E.read_nodes(spark, path, side))
    nodes = parts[0].unionByName(parts[1])
    return nodes.groupBy(F.col("forest").alias("side")).agg(
        F.count_distinct("tree").alias("num_trees"),
        F.max(F.size("proba")).cast("bigint").alias("num_classes"))


@query("e6_class_probabilities", rounded_sql(with_ctes(SCORED) + """
SELECT SPECID, cand_id, CASE WHEN cand_id % 10 = 0 THEN 2 WHEN Z_TRY >= 2.1e0 THEN 0 ELSE 1 END
  AS branch, CASE WHEN cand_id % 10 <> 0 THEN 1.0e0 END AS total FROM scored""", "total"))
def e6(spark, sf):
    """Each scored row's probabilities add up to one; rows without redshift have none."""
    rows = training_table(spark, sf)
    out = E.class_probabilities(rows, fitted(rows))
    probs = [F.col(c) for c in out.columns if c.startswith("PROB_CLASS")]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in probs), F.lit(0.0))
    return rounded(out.select("SPECID", "cand_id", "branch", F.when(
        F.coalesce(*probs).isNotNull(), total).alias("total")), "total")


def saved_forest(spark, forest):
    path = fresh_path(spark, "forest")
    forest.model.write().save(path)
    return path


@query("e6_probabilities_by_nodes", with_ctes(SCORED) + """
SELECT SPECID, cand_id, true AS same FROM scored WHERE cand_id % 10 <> 0""")
def e6_nodes(spark, sf):
    """Probabilities equal the mean leaves of the exported trees, row by row, on both sides."""
    rows = training_table(spark, sf)
    return _same_by_nodes(spark, rows.where("Z_TRY >= 2.1")).union(_same_by_nodes(spark, rows.where("Z_TRY < 2.1")))


def _same_by_nodes(spark, rows):
    forest = E.train_forest(rows, MODEL_FEATURES, 12, 5)
    vectors = E.assembled(rows, forest.features)
    keys = ("SPECID", "cand_id")
    walked = E.score_nodes(
        vectors.select(*keys, vector_to_array("features").alias("features")),
        E.read_nodes(spark, saved_forest(spark, forest), "high"), len(forest.labels), keys,
        max_depth=5)
    mine = walked.select(*keys, F.array(*[F.col(f"p{i}") for i in range(len(forest.labels))]).alias("a"))
    given = forest.model.transform(vectors).select(*keys, vector_to_array("probability").alias("b"))
    same = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) < 1e-9), lambda ok: ok)
    return mine.join(given, list(keys)).select(*keys, same.alias("same"))


@query("e6_separable_classes", with_ctes(SCORED) + f"""
SELECT SPECID, cand_id, CASE WHEN cand_id % 10 = 0 THEN -1 ELSE {TRAINING_CLASS} END
  AS CLASS_PREDICTED FROM scored""")
def e6_separable(spark, sf):
    """Where one feature tells the classes apart, every candidate gets its own class."""
    rows = training_table(spark, sf).withColumn("SIGNAL", E.training_class().cast("double"))
    forests = E.train(rows, ("SIGNAL",), num_trees=12, max_depth=8)
    out = E.class_probabilities(rows, forests)
    return out.select("SPECID", "cand_id", E.predicted_class(
        [int(c.removeprefix("PROB_CLASS")) for c in out.columns if c.startswith("PROB_CLASS")]
    ).alias("CLASS_PREDICTED"))


@query("e6_missing_redshifts", with_ctes(SCORED) + """
SELECT kind, CASE WHEN kind = 'usual' AND cand_id % 10 <> 0 THEN CASE WHEN Z_TRY >= 2.1e0 THEN 0 ELSE 1 END ELSE 2 END AS branch,
  kind = 'usual' AND cand_id % 10 <> 0 AS scored, count(*) AS n
FROM (SELECT *, CASE cand_id % 7 WHEN 0 THEN 'nan' WHEN 1 THEN 'null' ELSE 'usual' END AS kind FROM scored) GROUP BY ALL""")
def e6_missing(spark, sf):
    """Candidates whose trial redshift, probability or features are NaN are as if they were missing."""
    rows = training_table(spark, sf)
    forests = E.train(rows, MODEL_FEATURES, num_trees=4, max_depth=3)
    nan, kind = F.lit(float("nan")), F.pmod("cand_id", F.lit(7))
    odd = rows.withColumns({c: F.when(kind == 0, nan).when(kind != 1, F.col(c)) for c in ("Z_TRY", "PROB", "PEAK_SIGNIFICANCE")})
    odd = odd.withColumn("kind", F.when(kind == 0, "nan").when(kind == 1, "null").otherwise("usual"))
    out = E.class_probabilities(odd, forests)
    first = next(c for c in out.columns if c.startswith("PROB_CLASS"))
    return out.groupBy("kind", "branch", F.col(first).isNotNull().alias("scored")).agg(F.count("*").alias("n"))


# five trees of five nodes from the nation table: 0 -> (1, 2), 1 -> (3, 4)
def nation_nodes(spark, sf):
    k = F.col("n_nationkey").cast("int")
    node = F.expr("CAST(n_nationkey DIV 5 AS INT)")
    weight = [1.0 + (k * (7 + i)) % 5 for i in range(3)]
    return table(spark, sf, "nation").select(
        F.lit("all").alias("forest"), (k % 5).alias("tree"), node.alias("node"),
        F.when(node == 0, 1).when(node == 1, 3).otherwise(-1).alias("left"),
        F.when(node == 0, 2).when(node == 1, 4).otherwise(-1).alias("right"),
        F.when(node < 2, (k + node) % 3).otherwise(-2).alias("feature"),
        F.when(node < 2, 0.5 + ((k * 3) % 10) / 4.0).alias("threshold"),
        F.array(*[w / (weight[0] + weight[1] + weight[2]) for w in weight]).alias("proba"))


NODES = """raw AS (SELECT n_nationkey AS k, n_nationkey % 5 AS tree, n_nationkey // 5 AS node,
    [1.0e0 + (n_nationkey * 7) % 5, 1.0e0 + (n_nationkey * 8) % 5, 1.0e0 + (n_nationkey * 9) % 5] AS w
  FROM nation),
nodes AS (SELECT tree, node, CASE node WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE -1 END AS l,
    CASE node WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE -1 END AS r, (k + node) % 3 + 1 AS f,
    0.5e0 + ((k * 3) % 10) / 4.0e0 AS t, w[1] / (w[1] + w[2] + w[3]) AS p0,
    w[2] / (w[1] + w[2] + w[3]) AS p1, w[3] / (w[1] + w[2] + w[3]) AS p2 FROM raw),
step0 AS (SELECT cand_id, SPECID, [Z_TRY, PROB * 3, PEAK_SIGNIFICANCE / 4] AS x, tree, 0 AS node
  FROM cand, (SELECT DISTINCT tree FROM nodes)),
step1 AS (SELECT s.* REPLACE (CASE WHEN l < 0 THEN s.node WHEN x[f] <= t THEN l ELSE r END AS node)
  FROM step0 s JOIN nodes n USING (tree, node)),
step2 AS (SELECT s.* REPLACE (CASE WHEN l < 0 THEN s.node WHEN x[f] <= t THEN l ELSE r END AS node)
  FROM step1 s JOIN nodes n USING (tree, node))"""
NODES_SQL = rounded_sql(with_ctes(ORDERS_CANDIDATES, NODES) + """
SELECT SPECID, cand_id, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2
FROM step2 JOIN nodes USING (tree, node) GROUP BY ALL""", "p0", "p1", "p2")


def _scored_by_nodes(spark, sf, **options):
    rows = orders_candidates(spark, sf).select("SPECID", "cand_id", F.array(
        F.col("Z_TRY"), F.col("PROB") * 3, F.col("PEAK_SIGNIFICANCE") / 4).alias("features"))
    return rounded(E.score_nodes(rows, nation_nodes(spark, sf), 3, ("SPECID", "cand_id"),
                                 max_depth=2, **options))


@query("e7_tree_scoring", NODES_SQL)
def e7(spark, sf):
    return _scored_by_nodes(spark, sf)


@query("e7_tree_scoring_by_groups", NODES_SQL)
def e7_groups(spark, sf):
    """The same for a model too large for one broadcast: every tree travels by itself."""
    return _scored_by_nodes(spark, sf, broadcast_bytes=0)


def node_document(nodes, classes):
    """The trees as one JSON document of parallel arrays, as a model is stored."""
    def array(name, value):
        return F.struct(F.struct(value.alias("data")).alias("np.ndarray")).alias(name)

    n = F.col("n")
    parts = F.sort_array(F.collect_list(F.struct("node", "left", "right", "feature", F.coalesce(
        "threshold", F.lit(-2.0)).alias("threshold"), F.array("proba").alias("proba"))))
    tree = F.struct(array("children_left", n["left"]), array("children_right", n["right"]),
                    array("feature", n["feature"]), array("threshold", n["threshold"]),
                    array("proba", n["proba"]))
    trees = nodes.groupBy("tree").agg(parts.alias("n")).select("tree", tree.alias("t"))
    listed = trees.agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "t"))),
                                   lambda x: x["t"]).alias("trees"))
    forest = F.struct(array("classes", F.lit(list(classes))), F.col("trees"))
    return listed.select(F.to_json(F.struct(forest.alias("clf"))))


@query("e12_model_of_trees", rounded_sql(with_ctes(ORDERS_CANDIDATES, NODES) + """
SELECT *, PROB_CLASS3 + PROB_CLASS30 AS PROB FROM (SELECT SPECID, cand_id, avg(p0) AS PROB_CLASS1,
  avg(p1) AS PROB_CLASS3, avg(p2) AS PROB_CLASS30
FROM step2 JOIN nodes USING (tree, node) GROUP BY ALL)""",
                                         "PROB_CLASS1", "PROB_CLASS3", "PROB_CLASS30", "PROB"))
def e12_trees(spark, sf):
    """A model given as a document of trees, read, saved with its parameters and loaded."""
    path = fresh_path(spark, "trees")
    node_document(nation_nodes(spark, sf), (1, 3, 30)).coalesce(1).write.text(path)
    forests = R.read_model_json(spark, path, ("FA", "FB", "FC"))
    folder = fresh_path(spark, "model")
    jobs.save_model(jobs.Model(forests, JobParams(split=False)), folder)
    rows = orders_candidates(spark, sf).select(
        "SPECID", "cand_id", "Z_TRY", F.col("Z_TRY").alias("FA"), (F.col("PROB") * 3).alias("FB"),
        (F.col("PEAK_SIGNIFICANCE") / 4).alias("FC"))
    out = E.classify(rows, jobs.load_model(spark, folder).forests, ("branch", "cand_id"))
    return rounded(out.select("SPECID", "cand_id", "PROB_CLASS1", "PROB_CLASS3", "PROB_CLASS30",
                              "PROB"), "PROB_CLASS1", "PROB_CLASS3", "PROB_CLASS30", "PROB")


PROBS = {1: 7919, 3: 6007, 4: 4001, 30: 3001}


def with_probs(spark, sf):
    k = F.col("cand_id")
    return orders_candidates(spark, sf).withColumns({
        f"PROB_CLASS{c}": F.when(k % 17 != 0, (k * m % 8) / 8.0) for c, m in PROBS.items()})


PROBS_CTE = "probs AS (SELECT *, " + ", ".join(
    f"CASE WHEN cand_id % 17 <> 0 THEN (cand_id * {m} % 8) / 8.0e0 END AS PROB_CLASS{c}"
    for c, m in PROBS.items()) + " FROM cand)"


@query("e8_predicted_class", with_ctes(ORDERS_CANDIDATES, PROBS_CTE) + """
SELECT SPECID, cand_id, CASE WHEN coalesce(m, 0) <= 0 THEN -1 WHEN PROB_CLASS1 = m THEN 1
  WHEN PROB_CLASS3 = m THEN 3 WHEN PROB_CLASS4 = m THEN 4 ELSE 30 END AS CLASS_PREDICTED
FROM (SELECT *, greatest(PROB_CLASS1, PROB_CLASS3, PROB_CLASS4, PROB_CLASS30) AS m FROM probs)""")
def e8(spark, sf):
    return with_probs(spark, sf).select(
        "SPECID", "cand_id", E.predicted_class(list(PROBS)).alias("CLASS_PREDICTED"))


@query("e9_quasar_probability", with_ctes(ORDERS_CANDIDATES, PROBS_CTE) + """
SELECT SPECID, cand_id, PROB_CLASS3 + PROB_CLASS30 AS both, PROB_CLASS30 AS one,
  NULL::DOUBLE AS none FROM probs""")
def e9(spark, sf):
    rows = with_probs(spark, sf)
    return rows.select(
        "SPECID", "cand_id", E.quasar_probability(rows.columns).alias("both"),
        E.quasar_probability(["PROB_CLASS30"]).alias("one"),
        E.quasar_probability([]).alias("none"))


@query("e10_duplicates", with_ctes(ORDERS_CANDIDATES) + """
SELECT SPECID, cand_id, PROB, row_number() OVER (PARTITION BY SPECID
  ORDER BY PROB DESC NULLS LAST, cand_id) > 1 AS DUPLICATED
FROM (SELECT * REPLACE (CASE WHEN cand_id % 17 <> 0 THEN PROB END AS PROB) FROM cand)""")
def e10(spark, sf):
    rows = orders_candidates(spark, sf).withColumn(
        "PROB", F.when(F.col("cand_id") % 17 != 0, F.col("PROB")))
    return E.with_duplicates(rows, ["cand_id"]).select("SPECID", "cand_id", "PROB", "DUPLICATED")


@query("e11_feature_importances", with_ctes(SCORED) + """
SELECT side, 3::BIGINT AS n_features, 1.0e0 AS total
FROM (SELECT DISTINCT CASE WHEN Z_TRY >= 2.1e0 THEN 'high' ELSE 'low' END AS side FROM scored)""")
def e11(spark, sf):
    forests = fitted(training_table(spark, sf))
    rows = [(side, name, value) for side, f in forests.items() for name, value in f.importances()]
    return rounded(spark.createDataFrame(rows, "side STRING, feature STRING, importance DOUBLE")
                   .groupBy("side").agg(F.count("*").alias("n_features"),
                                        F.sum("importance").alias("total")), "total")


@query("e11_importances_by_nodes", with_ctes(SCORED) + f"""
SELECT side, f AS feature, true AS same FROM (SELECT DISTINCT {SIDE} AS side FROM scored),
  (SELECT unnest([{', '.join(f"'{f}'" for f in MODEL_FEATURES)}]) AS f)""")
def e11_nodes(spark, sf):
    """Importances equal those that the gains in the exported nodes add up to."""
    forests, parts = fitted(training_table(spark, sf)), []
    for side, forest in forests.items():
        given = spark.createDataFrame(
            [(side, i, *pair) for i, pair in enumerate(forest.importances())],
            "side STRING, position INT, feature STRING, given DOUBLE")
        counted = E.node_importances(spark, saved_forest(spark, forest)).select(
            F.col("feature").alias("position"), "importance")
        parts.append(given.join(counted, "position", "left"))
    same = F.abs(F.coalesce("importance", F.lit(0.0)) - F.col("given")) < 1e-9
    return parts[0].unionByName(parts[1]).select("side", "feature", same.alias("same"))


@query("e12_stored_model", with_ctes(SCORED) + """
SELECT SPECID, cand_id, true AS same FROM scored WHERE cand_id % 10 <> 0""")
def e12(spark, sf):
    """A model scores alike before and after a round trip through its folder."""
    rows = training_table(spark, sf).where("Z_TRY IS NOT NULL")
    model = jobs.Model(fitted(rows), JobParams(mode="training", num_trees=12, max_depth=5))
    path = fresh_path(spark, "model")
    jobs.save_model(model, path)
    again = jobs.load_model(spark, path)
    assert again.params == model.params
    def score(m, name):
        out = E.class_probabilities(rows, m.forests)
        have = [F.col(f"PROB_CLASS{c}") for c in CLASS_LABELS if f"PROB_CLASS{c}" in out.columns]
        return out.select("SPECID", "cand_id", F.array(*have).alias(name))

    return score(model, "a").join(score(again, "b"), ["SPECID", "cand_id"]).select(
        "SPECID", "cand_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))
