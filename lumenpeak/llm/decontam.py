"""Benchmark decontamination with a positional inverted index.

The index holds one posting (term, row, pos) for every corpus word that occurs in
the benchmark; other words cannot be part of a match.  A window of the benchmark is
looked up from its rarest term: the postings of that term give the candidate starts,
the postings of the second rarest, moved by their offset, are intersected with them,
and what is left is intersected with all other terms at once.  Every intersection is
an equi-join on (row, position), so no list of a frequent term meets in one task.

The closing posting of a row carries its number of words, its id and its text key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import measured, terms, text_key, unused

WINDOW = 13
END = "$"  # no word: stands behind the last word of a row
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes


def windows_of(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, terms) of all different windows, and (window, item) of their items.

    An item of fewer words is one window; an item without words has none.  Item ids
    are text from here on, NULL being the empty text.  Terms are 64-bit hashes.
    """
    hashed = F.transform(terms(F.col("text")), lambda w: F.xxhash64(w))
    read = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                        F.explode(F.array(hashed)).alias("all")).where(F.size("all") > 0)
    cut = read.select("item", "all", F.explode(F.sequence(
        F.lit(0), F.greatest(F.size("all") - size, F.lit(0)))).alias("at")).select(
        "item", F.slice("all", F.col("at") + 1, F.lit(size)).alias("terms")).withColumn(
        "window", F.xxhash64("terms"))
    cut = written(cut.distinct(), "windows")
    return cut.select("window", "terms").distinct(), cut.select("window", "item").distinct()


def build_index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Postings (term, row, pos, doc_id, key); the last two on closing postings only.

    Written in the order of the corpus, so building it needs no shuffle.
    """
    closing = F.xxhash64(F.lit(END))
    spark = docs.sparkSession
    vocabulary = windows.select(F.explode("terms").alias("term")).union(
        spark.range(1).select(closing.alias("term"))).distinct()
    _, known = measured(vocabulary, "vocabulary")
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key().alias("key"),
                       F.concat(terms(F.col("text")), F.array(F.lit(END))).alias("all"))
    tokens = read.select("row", "doc_id", "key", F.posexplode("all").alias("pos", "word")).select(
        F.xxhash64("word").alias("term"), "row", "pos", "doc_id", "key")
    last = F.col("term") == closing
    return written(tokens.join(known, "term", "left_semi").select(
        "term", "row", "pos", F.when(last, F.col("doc_id")).alias("doc_id"),
        F.when(last, F.col("key")).alias("key")), "postings")


def closing_postings(index: DataFrame) -> DataFrame:
    """(row, doc_id, key, n_words) of every row."""
    return index.where(F.col("term") == F.xxhash64(F.lit(END))).select(
        "row", "doc_id", "key", F.col("pos").cast("long").alias("n_words"))


def _ranked(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, len, ranked): terms of each window as (count, off, term), rarest first.

    Windows with a term that the corpus lacks are gone: they cannot occur.
    """
    _, counts = measured(index.groupBy("term").agg(F.count("*").alias("n")), "counts")
    spread = windows.select("window", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    return spread.join(counts, "term").groupBy("window", "len").agg(
        F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("ranked")).where(
        F.size("ranked") == F.col("len"))


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, window, start, len): every place where a window's words stand in order."""
    postings = index.select("term", "row", "pos")
    ranked, plans = measured(_ranked(index, windows), "plans")
    first, second = F.col("ranked")[0], F.get("ranked", F.lit(1))
    anchors = plans.select("window", "len", first["term"].alias("term"), first["off"].alias("off"),
                           second["term"].alias("term2"), second["off"].alias("off2"))
    starts = postings.join(anchors, "term").select(
        "row", "window", "len", (F.col("pos") - F.col("off")).alias("start"), "term2", "off2").where("start >= 0")
    _, seconds = measured(ranked.where("len > 1").select(second["term"].alias("term")).distinct(), "seconds")
    others = postings.join(seconds, "term", "left_semi")
    paired = starts.where("len > 1").withColumn("pos", F.col("start") + F.col("off2")).withColumnRenamed(
        "term2", "__t").join(others.withColumnRenamed("term", "__t"), ["row", "pos", "__t"])
    paired = written(paired.select("row", "window", "len", "start"), "paired")
    _, rows = measured(paired.where("len > 2").select("row").distinct(), "rows")
    rest = paired.where("len > 2").join(plans.select("window", F.slice("ranked", 3, WINDOW * 1000).alias("rest")),
                                        "window").select(
        "row", "window", "len", "start", F.explode("rest").alias("r")).select(
        "row", "window", "len", "start", F.col("r.term").alias("term"),
        (F.col("start") + F.col("r.off")).alias("pos"))
    found = rest.join(postings.join(rows, "row", "left_semi"), ["row", "pos", "term"]).groupBy(
        "row", "window", "len", "start").agg(F.count("*").alias("n")).where("n = len - 2")
    keep = ["row", "window", "start", "len"]
    return starts.where("len = 1").select(keep).union(paired.where("len = 2").select(keep)).union(
        found.select(keep))


def proximity_matches(index: DataFrame, windows: DataFrame, slack: int = 5, rarest: int = 3) -> DataFrame:
    """(row, window, start): places where a window's rarest terms stand close to it.

    The rarest term sets the start; each of the next ``rarest - 1`` terms must occur
    within ``slack`` positions of where the window has it.  Positions are compared
    through bins of that width, so the join stays an equi-join.
    """
    postings = index.select("term", "row", "pos")
    _, plans = measured(_ranked(index, windows), "plans")
    width = 2 * slack + 1
    starts = postings.join(plans.select("window", F.col("ranked")[0]["term"].alias("term"),
                                        F.col("ranked")[0]["off"].alias("off"),
                                        F.slice("ranked", 2, rarest - 1).alias("next")), "term").select(
        "row", "window", (F.col("pos") - F.col("off")).alias("start"), "next").where("start >= 0")
    wanted = starts.select("row", "window", "start", F.size("next").alias("n"), F.explode("next").alias("r")).select(
        "row", "window", "start", "n", F.col("r.term").alias("term"), F.col("r.off").alias("off"),
        (F.col("start") + F.col("r.off")).alias("at")).withColumn("bin", F.explode(F.array(
            F.floor((F.col("at") - slack) / width), F.floor((F.col("at") + slack) / width))))
    near = wanted.distinct().join(postings.withColumn("bin", F.floor(F.col("pos") / width)), ["row", "term", "bin"])
    near = near.where(F.abs(F.col("pos") - F.col("at")) <= slack)
    some = near.groupBy("row", "window", "start", "n").agg(F.countDistinct("off").alias("k")).where("k = n")
    return some.select("row", "window", "start").union(starts.where(F.size("next") == 0).select("row", "window", "start"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key per row of ``docs``.

    A document is contaminated if words are hit and they are at least a twentieth of
    its words.  NULL and empty texts have no words; repeated rows each have a result.
    """
    windows, owners = windows_of(items, size)
    windows = written(windows, "windows")
    index = build_index(docs, windows)
    matches = written(phrase_matches(index, windows), "matches")
    spans = matches.groupBy("row", "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    hits = spans.select("row", F.greatest(F.col("stop") - reached, F.lit(0)).alias("n")).groupBy("row").agg(
        F.sum("n").alias("n_hit"))
    per_item = matches.select("row", "window").distinct().join(owners, "window").select("row", "item").distinct()
    named = per_item.groupBy("row").agg(
        F.count("*").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return closing_postings(index).join(hits, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(NOTHING)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "key")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns.  The verdict
    depends on the text alone, so rows are left out by their text key."""
    key = unused(docs, "bad_text")
    bad = decontaminated(docs, items, size).where("contaminated").select(F.col("key").alias(key)).distinct()
    _, bad = measured(bad, "contaminated")
    return docs.join(bad, text_key() == F.col(key), "left_anti")
