"""Awkward rows that every operator has to take."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i} the" for i in range(6000))
DOCS = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (2, "one TWO three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b", 1),
    (2, "one TWO three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b", 1),
    (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "en", "b", 3), (None, "no id here", "en", "c", 2),
    (6, LONG, "en", "a", 9), (7, "é ß 漢字 \x1c  <b>|%% #x", "xx", None, 4), (8, "the MIT License.", "en", "c", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=DOCS):
    """With extra columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "fp", "row", "size", "cut", "ledger", "html", "rank", "shard", "__extra"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return documents(spark).where("false")
