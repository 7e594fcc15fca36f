"""Reader and writer queries (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenpeak.functions.constants import LINES
from lumenpeak.functions.lines import try_line_structs
from lumenpeak.functions.shared import fresh_path
from lumenpeak.operators import pixels as P
from lumenpeak.plans import jobs
from lumenpeak.sources import readers as R
from lumenpeak.sources import writers as W
from workload.preprocessing import FILES, catalogue_and_files, photometry, sky
from workload.views import (PIXELS, SCORED, TRUTH, lines_sql,
                            pixels, query, rounded, rounded_sql, scored, table, truth, with_ctes)

# --- readers ----------------------------------------------------------------


def array_spectra(spark, sf):
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("SPECID"), F.col("label").cast("bigint").alias("PLATE"),
        F.transform(values, lambda v, i: 3600.0 + 90.0 * i).alias("wave"), values.alias("flux"),
        F.transform(values, lambda v, i: 1.0 + i % 3).alias("ivar"))


ARRAY_SUMS = """SELECT SPECID, PLATE, count(*) AS n, sum(wave) AS wave, sum(flux) AS flux,
  sum(ivar) AS ivar FROM (SELECT vec_id AS SPECID, label::BIGINT AS PLATE, 3600.0e0 + 90.0e0 * i AS wave,
    embedding[i + 1]::DOUBLE AS flux, 1.0e0 + i % 3 AS ivar
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)) GROUP BY ALL"""


def array_sums(spectra):
    return rounded(P.to_pixels(spectra, "PLATE").groupBy("SPECID", "PLATE").agg(
        F.count("*").alias("n"), F.sum("wave").alias("wave"), F.sum("flux").alias("flux"),
        F.sum("ivar").alias("ivar")))


@query("a1_spectra_json", rounded_sql(ARRAY_SUMS, "wave", "flux", "ivar"))
def a1(spark, sf):
    """Spectra written as JSON text and parsed again, metadata names in mixed case."""
    def array(name):
        return F.struct(F.struct(F.col(name).alias("data"), F.lit("float64").alias("dtype"))
                        .alias("np.ndarray")).alias(name)

    one = F.struct(array("flux"), array("ivar"), array("wave"), F.struct(
        F.col("SPECID").alias("specid"), F.col("PLATE").alias("Plate")).alias("metadata"))
    texts = array_spectra(spark, sf).select(
        F.to_json(F.struct(F.array(one).alias("spectra_list"))).alias("text"))
    return array_sums(R.parse_spectra_json(texts, "text", "specid BIGINT, Plate BIGINT"))


@query("a1_spectra_json_files", rounded_sql(ARRAY_SUMS, "wave", "flux", "ivar"))
def a1_files(spark, sf):
    """Documents of up to 100 spectra, written one to a file and read in parallel."""
    def array(name):
        return F.struct(F.struct(F.col(name).alias("data")).alias("np.ndarray")).alias(name)

    one = F.struct(array("flux"), array("ivar"), array("wave"), F.struct(
        F.col("SPECID").alias("specid"), F.col("PLATE").alias("Plate")).alias("metadata"))
    path = fresh_path(spark, "documents")
    array_spectra(spark, sf).groupBy(F.expr("SPECID DIV 100")).agg(
        F.collect_list(one).alias("spectra_list")).select(
        F.to_json(F.struct("spectra_list"))).write.option("maxRecordsPerFile", 1).text(path)
    return array_sums(R.read_spectra_json(spark, path, "specid BIGINT, Plate BIGINT"))


@query("a2_several_spectra_files", rounded_sql(ARRAY_SUMS, "wave", "flux", "ivar"))
def a2(spark, sf):
    spectra = array_spectra(spark, sf)
    paths = [fresh_path(spark, "spectra") for _ in range(2)]
    W.write_spectra(spectra.where("PLATE < 5"), paths[0])
    W.write_spectra(spectra.where("PLATE >= 5"), paths[1])
    return array_sums(R.read_spectra(spark, paths))


@query("a3_candidates_table", """SELECT o_orderkey AS CAND_ID, o_custkey AS SPECID,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS LYA_RATIO FROM orders""")
def a3(spark, sf):
    path = fresh_path(spark, "candidates")
    nan = F.lit(float("nan"))
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cand_id"), F.col("o_custkey").alias("specid"),
        F.when(F.col("o_orderkey") % 6 == 0, nan).otherwise(F.col("o_totalprice"))
        .alias("lya_ratio")).write.parquet(path)
    return R.read_candidates(spark, path)


@query("a4_truth_catalogue", """SELECT c_custkey AS C_CUSTKEY, c_acctbal AS C_ACCTBAL,
  c_mktsegment AS C_MKTSEGMENT, c_custkey AS SPECID, c_acctbal AS Z_TRUE FROM customer""")
def a4(spark, sf):
    return R.truth_catalogue(table(spark, sf, "customer"),
                             ["c_custkey", "c_acctbal", "c_mktsegment"], "c_custkey", "c_acctbal")


@query("a5_catalogue_json", """SELECT c_custkey AS part, c_custkey::VARCHAR AS idx,
  c_acctbal AS Z_VI, c_nationkey AS PLATE, c_mktsegment AS NAME FROM customer""")
def a5(spark, sf):
    """Column-oriented JSON {column: {row: value}}, one document per customer."""
    label = F.col("c_custkey").cast("string")

    def column(name):
        return F.create_map(label, F.col(name))

    texts = table(spark, sf, "customer").select(F.col("c_custkey").alias("part"), F.to_json(
        F.struct(column("c_acctbal").alias("Z_VI"), column("c_nationkey").alias("PLATE"),
                 column("c_mktsegment").alias("NAME"))).alias("text"))
    return R.frame_from_columns(texts, "text", "Z_VI DOUBLE, PLATE INT, NAME STRING",
                                keep=["part"])


@query("a5_catalogue_file", """SELECT c_acctbal AS Z_VI, c_nationkey AS PLATE, c_mktsegment AS NAME
FROM customer""")
def a5_file(spark, sf):
    """Documents of up to 500 customers, written one to a file."""
    def column(name):
        return F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), name)))

    path = fresh_path(spark, "catalogue")
    table(spark, sf, "customer").groupBy(F.expr("c_custkey DIV 500")).agg(F.to_json(F.struct(
        column("c_acctbal").alias("Z_VI"), column("c_nationkey").alias("PLATE"),
        column("c_mktsegment").alias("NAME"))).alias("pd.DataFrame")).select(
        F.to_json(F.struct("`pd.DataFrame`"))).write.option("maxRecordsPerFile", 1).text(path)
    return R.read_catalogue_json(spark, path, "Z_VI DOUBLE, PLATE INT, NAME STRING")


@query("a6_line_table", with_ctes(TRUTH, lines_sql()) + """
SELECT line_index, LINE, count(*) AS n FROM lines, truth
WHERE WAVE * (1 + Z_TRUE) BETWEEN 3600 AND 10000 GROUP BY ALL""")
def a6(spark, sf):
    """Every line of a stored table by its declared position, and the objects that show it."""
    columns = [F.map_from_arrays(F.lit([line[0] for line in LINES]), F.lit([float(line[k]) for line in LINES]))
               .alias(name) for k, name in enumerate(R.LINE_COLUMNS[1:], 1)]
    path = fresh_path(spark, "lines")
    spark.range(1).select(F.to_json(F.struct(*columns))).coalesce(1).write.text(path)
    lines = R.read_lines(spark, path)
    every = try_line_structs([line[0] for line in lines], lines)
    return (truth(spark, sf).withColumn("l", F.explode(every))
            .where((F.col("l.rest_wave") * (1 + F.col("Z_TRUE"))).between(3600.0, 10000.0))
            .groupBy(F.col("l.assumed_index").alias("line_index"),
                     F.col("l.ASSUMED_LINE").alias("LINE")).agg(F.count("*").alias("n")))


@query("a7_sky_lines", """SELECT 3500.26e0 + s_suppkey * 0.806e0 AS wave FROM supplier
WHERE s_suppkey % 9 <> 4""")
def a7(spark, sf):
    """One wavelength per text line; a line that is no number is skipped."""
    k = F.col("s_suppkey")
    text = table(spark, sf, "supplier").select(F.when(k % 9 == 4, F.lit("# sky")).otherwise(
        F.concat(F.lit(" "), (3500.26 + k * 0.806).cast("string"))).alias("value"))
    path = fresh_path(spark, "sky")
    text.write.text(path)
    return R.read_sky_lines(spark, path)


@query("a8_good_plates", """SELECT DISTINCT (o_custkey % 700)::INTEGER AS PLATE FROM orders
WHERE o_orderpriority LIKE '1%'""")
def a8(spark, sf):
    plates = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 700).alias("plate"),
        F.when(F.col("o_orderpriority").startswith("1"), "good").otherwise("bad")
        .alias("platequality"))
    return R.good_plates(plates)


@query("a9_magnitude_text", """SELECT c_custkey AS TARGID, c_acctbal AS GMAG,
  c_nationkey::DOUBLE AS RMAG FROM customer""")
def a9(spark, sf):
    """A text table with a header line, written and read again."""
    text = table(spark, sf, "customer").select(F.concat(
        F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" \t "),
        F.col("c_acctbal").cast("string"), F.lit("   "), F.col("c_nationkey").cast("string"))
        .alias("value"))
    path, names = fresh_path(spark, "magnitudes"), ["TARGID", "GMAG", "RMAG"]
    spark.range(1).select(F.lit(" ".join(names)).alias("value")).union(text).write.text(path)
    return R.read_magnitudes(spark, path, names, {"TARGID": "bigint"})


@query("a10_wave_axis", rounded_sql("""SELECT SPECID, count(*) AS n, min(w) AS lo, max(w) AS hi,
  sum(w) AS total FROM (SELECT s_suppkey AS SPECID, 3600.0e0 + s_suppkey % 7 +
    unnest(range(50 + s_suppkey % 13)) * (0.5e0 + (s_suppkey % 4) / 10.0e0) AS w FROM supplier)
GROUP BY SPECID""", "lo", "hi", "total"))
def a10(spark, sf):
    k = F.col("s_suppkey")
    headers = table(spark, sf, "supplier").select(
        k.alias("SPECID"), (3600.0 + k % 7).alias("crval"), (0.5 + (k % 4) / 10.0).alias("cd"),
        (50 + k % 13).alias("n"))
    return rounded(P.wave_axis(headers, "SPECID").groupBy("SPECID").agg(
        F.count("*").alias("n"), F.min("wave").alias("lo"), F.max("wave").alias("hi"),
        F.sum("wave").alias("total")))


FILTERS = """filters AS (SELECT p_partkey AS idx,
  CASE WHEN p_size % 3 = 0 THEN 'u' ELSE 'J' END || p_size AS name, p_retailprice AS wave FROM part)"""


def filters(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"),
        F.concat(F.when(F.col("p_size") % 3 == 0, "u").otherwise("J"),
                 F.col("p_size").cast("string")).alias("name"), F.col("p_retailprice").alias("wave"))


@query("a11_filter_table", with_ctes(FILTERS) + "SELECT * FROM filters WHERE name LIKE 'J%'")
def a11(spark, sf):
    return P.select_filters(filters(spark, sf))


@query("a11_photometric_pixels", rounded_sql(with_ctes(FILTERS) + """
SELECT (label::VARCHAR || vec_id::VARCHAR)::BIGINT AS SPECID, pix, wave,
  embedding[idx + 1]::DOUBLE AS flux
FROM embeddings JOIN (SELECT idx, wave, row_number() OVER (ORDER BY idx) - 1 AS pix FROM filters
  WHERE name LIKE 'J%') ON idx < len(embedding)""", "flux"))
def a11_pixels(spark, sf):
    return rounded(P.photometric_pixels(photometry(spark, sf), P.select_filters(
        filters(spark, sf))).select("SPECID", "pix", "wave", "flux"), "flux")


@query("a12_log_wave", rounded_sql(with_ctes(PIXELS) + """
SELECT SPECID, min(w) AS lo, max(w) AS hi, sum(w) AS total
FROM (SELECT SPECID, pow(10.0e0, 3.55e0 + 0.0001e0 * pix) AS w FROM pixels) GROUP BY SPECID""",
                                   "lo", "hi", "total"))
def a12(spark, sf):
    logs = pixels(spark, sf).withColumn("loglam", 3.55 + 0.0001 * F.col("pix"))
    return rounded(logs.withColumn("w", P.log_wave()).groupBy("SPECID").agg(
        F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("w").alias("total")))


# --- writers ----------------------------------------------------------------


@query("b1_written_candidates", with_ctes(SCORED)
       + "SELECT SPECID, cand_id, Z_TRY, PROB, IS_CORRECT, DUPLICATED FROM scored")
def b1(spark, sf):
    path = fresh_path(spark, "candidates")
    W.write_candidates(scored(spark, sf).select("SPECID", "cand_id", "Z_TRY", "PROB",
                                                "IS_CORRECT", "DUPLICATED"), path)
    return spark.read.parquet(path)


@query("b2_catalogue", with_ctes(SCORED) + """
SELECT SPECID, cand_id, Z_TRY, PROB FROM scored WHERE NOT DUPLICATED AND PROB >= 0.9e0""")
def b2(spark, sf):
    return W.catalogue(scored(spark, sf), 0.9).select("SPECID", "cand_id", "Z_TRY", "PROB")


@query("b3_spectra_by_plate", rounded_sql(ARRAY_SUMS, "wave", "flux", "ivar"))
def b3(spark, sf):
    path = fresh_path(spark, "plates")
    packed = W.to_spectra(P.to_pixels(array_spectra(spark, sf), "PLATE"), "PLATE", chunk=24)
    W.write_spectra(packed, path, "PLATE")
    return array_sums(spark.read.parquet(path).withColumn("PLATE", F.col("PLATE").cast("bigint")))


def targets(spark, sf):
    return scored(spark, sf).withColumns({
        "APS_ID": F.col("SPECID"), "TARGETID": F.col("SPECID"),
        "TARGID": F.concat(F.lit("T"), F.col("SPECID").cast("string")),
        "CNAME": F.concat(F.lit("C"), F.col("SPECID").cast("string"))})


@query("b4_priors", with_ctes(SCORED) + """
SELECT SPECID AS TARGETID, 'gaussian' AS FUNCTION, Z_TRY AS Z, 0.15e0 AS SIGMA FROM scored
WHERE NOT DUPLICATED AND PROB >= 0.5e0""")
def b4(spark, sf):
    return W.priors(targets(spark, sf), 0.5)


@query("b5_quasar_ids", with_ctes(SCORED) + """
SELECT 'C' || SPECID AS CNAME, 'T' || SPECID AS TARGID, 'QSO' AS TARGCLASS, PROB, z AS Z
FROM scored JOIN (SELECT o_custkey AS id, o_totalprice AS z, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ON id = SPECID AND r = 1
WHERE NOT DUPLICATED AND PROB >= 0.5e0""")
def b5(spark, sf):
    refined = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("APS_ID"), F.col("o_totalprice").alias("Z"), "o_orderkey")
    return W.quasar_ids(targets(spark, sf), refined, ["o_orderkey"], 0.5)


@query("b6_alternatives", with_ctes(SCORED, """ranked AS (SELECT *, row_number() OVER (
  PARTITION BY SPECID ORDER BY PROB DESC NULLS LAST, cand_id) AS r FROM scored)""") + """
SELECT 'C' || g.SPECID AS CNAME, i, PROB, Z_TRY AS Z
FROM (SELECT SPECID, unnest(range(1, 16)) AS i FROM scored
      WHERE NOT DUPLICATED AND PROB >= 0.5e0) g
LEFT JOIN ranked r ON r.SPECID = g.SPECID AND r.r = i""")
def b6(spark, sf):
    lists = W.alternatives(targets(spark, sf), ["cand_id"], 0.5)
    return lists.select("CNAME", F.posexplode(F.arrays_zip("PROB", "Z")).alias("i", "v")).select(
        "CNAME", (F.col("i") + 1).cast("bigint").alias("i"), "v.PROB", "v.Z")


@query("b7_reduced_output", with_ctes(SCORED) + """
SELECT SPECID AS TARGETID, Z_TRY AS Z_SQ, PROB AS Z_SQ_CONF FROM scored WHERE NOT DUPLICATED""")
def b7(spark, sf):
    return W.reduced(targets(spark, sf))


@query("b8_stored_parameters", with_ctes(SCORED) + """
SELECT side, 6::BIGINT AS num_trees, n > 0 AS has_nodes FROM (
  SELECT CASE WHEN Z_TRY >= 2.1e0 THEN 'high' ELSE 'low' END AS side, count(*) AS n
  FROM scored WHERE cand_id % 10 <> 0 GROUP BY ALL)""")
def b8(spark, sf):
    """A model's folder holds its forests, its node tables and its parameters."""
    from lumenpeak.plans.params import JobParams
    from workload.forests import fitted, training_table

    path = fresh_path(spark, "model")
    params = JobParams(mode="training", num_trees=6, max_depth=3)
    jobs.save_model(jobs.Model(fitted(training_table(spark, sf), 6, 3), params), path)
    nodes = spark.read.parquet(f"{path}/nodes").groupBy(F.col("forest").alias("side")).agg(
        (F.count("*") > 0).alias("has_nodes"))
    info = jobs.load_model(spark, path)
    return nodes.withColumn("num_trees", F.lit(info.params.num_trees).cast("bigint"))


@query("b9_missing_inputs", with_ctes(FILES) + """
SELECT o_orderkey % 100 AS PLATE, o_orderkey % 1000 AS MJD, o_orderkey AS FIBERID,
  o_custkey AS SPECID FROM orders WHERE o_orderkey NOT IN (SELECT FIBERID FROM files)""")
def b9(spark, sf):
    return P.missing_inputs(*catalogue_and_files(spark, sf)).drop("LOADED")


@query("formatted_spectra", rounded_sql(with_ctes("""c AS (
  SELECT vec_id AS SPECID, label AS PLATE, unnest(range(len(embedding))) AS i, embedding
  FROM embeddings)""", """sky AS (SELECT 3650.0e0 + 240.0e0 * n_nationkey + n_nationkey % 3 AS sw
  FROM nation)""", """p AS (SELECT SPECID, PLATE, 3600.0e0 + 90.0e0 * i AS wave,
    embedding[i + 1]::DOUBLE AS flux, CASE WHEN EXISTS (SELECT 1 FROM sky WHERE
      abs(log10((3600.0e0 + 90.0e0 * i) / sw)) <= 1.5e-4) OR 3600.0e0 + 90.0e0 * i
      BETWEEN 4000 AND 4300 THEN 0.0e0 ELSE 1.0e0 + i % 3 END AS ivar FROM c)""") + """
SELECT SPECID, PLATE, count(*) AS n, sum(wave) AS wave, sum(flux) AS flux, sum(ivar) AS ivar
FROM p WHERE wave NOT IN (3900, 4000, 4300, 4400, 4700, 4800, 5100, 5200) AND wave < 7300
GROUP BY ALL""", "wave", "flux", "ivar"))
def formatted(spark, sf):
    """The formatting job: catalogue, masks, ranges and tray filters in one go."""
    spectra = array_spectra(spark, sf)
    catalogue = spectra.select("SPECID", "PLATE", (F.col("SPECID") % 1000).alias("MJD"),
                               F.col("SPECID").alias("FIBERID"))
    files = spectra.select("PLATE", (F.col("SPECID") % 1000).alias("MJD"),
                           F.col("SPECID").alias("FIBERID"), "wave", "flux", "ivar")
    out = jobs.format_spectra(catalogue, files, sky(spark, sf), tray="standard",
                              forbidden=[(4000.0, 4300.0)])
    return array_sums(out)


@query("formatted_repeats", """SELECT SPECID, PLATE, 2::BIGINT AS n_spectra, n::BIGINT AS pixels FROM (
  SELECT vec_id AS SPECID, label::BIGINT AS PLATE, len(embedding) AS n FROM embeddings)""")
def formatted_repeats(spark, sf):
    """Every file row twice: each is a spectrum by itself, none is merged with its copy."""
    spectra = array_spectra(spark, sf)
    keys = [F.col("PLATE"), (F.col("SPECID") % 1000).alias("MJD"), F.col("SPECID").alias("FIBERID")]
    files = spectra.select(*keys, "wave", "flux", "ivar")
    out = jobs.format_spectra(spectra.select("SPECID", *keys), files.union(files), sky(spark, sf))
    return out.groupBy("SPECID", "PLATE").agg(F.count("*").alias("n_spectra"), F.max(F.size("wave")).cast(
        "bigint").alias("pixels"))


@query("d1_pieces_of_two_files", """SELECT CASE vec_id % 3 WHEN 0 THEN 'unusable' ELSE 'found' END AS what,
  vec_id AS SPECID, (CASE vec_id % 3 WHEN 0 THEN 4 ELSE 2 END)::BIGINT AS n FROM (
  SELECT DISTINCT vec_id % 50 AS vec_id FROM embeddings)""")
def pieces_of_two_files(spark, sf):
    """Two observations of each object, equal in all metadata and cut in two pieces, come from
    two files; those of a third of the objects from one file, so nothing tells them apart."""
    spectra = array_spectra(spark, sf).select((F.col("SPECID") % 50).alias("SPECID"), "wave", "flux", "ivar").dropDuplicates(["SPECID"])
    both = spectra.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source")).withColumn(
        "source", F.when(F.col("SPECID") % 3 == 0, "a").otherwise(F.col("source")))
    arrays = ("wave", "flux", "ivar")
    pieces = [both.select("SPECID", "source", *[F.slice(c, at + 1, 30 if at == 0 else 1000).alias(c) for c in arrays],
                          F.lit(at).alias("start")) for at in (0, 30)]
    pieces = pieces[0].union(pieces[1])
    told, mixed = jobs.observed_spectra(pieces)
    found = told.groupBy(F.col("__object").alias("id")).agg(F.countDistinct("SPECID").alias("n"))
    return found.select(F.lit("found").alias("what"), F.col("id").alias("SPECID"), "n").union(
        mixed.groupBy("SPECID").agg(F.count("*").alias("n")).select(F.lit("unusable"), "SPECID", "n"))
