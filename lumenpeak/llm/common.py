"""What the text operators share: word patterns, bindings, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
# Words between ASCII white space, and words of letters and digits (all that is
# not ASCII counts as a letter).
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# A join side derived from a table other than the corpus is broadcast up to this
# many rows of a few numbers (some tens of MB); beyond it Spark shuffles.
BROADCAST_ROWS = 500_000


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def text_key(text: str = "text") -> Column:
    """Digest that stands for a text where its rows must be found again."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0 ** -53)


def measured(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The written table, and the same marked for broadcast if its rows are few enough."""
    table = written(df, name)
    return table, F.broadcast(table) if table.count() <= limit else table


def frequent(total: int) -> Column:
    """Whether a key with ``n`` of ``total`` rows has more than a thousandth of them, and a
    thousand; fewer than a thousand keys have."""
    return F.col("n") > max(1000, total // 1000)


def counted(one: DataFrame, name: str, total: int) -> tuple[DataFrame, bool]:
    """The written table of counts ``n``, and whether a key is frequent."""
    watch = Observation()
    table = written(one.observe(watch, F.max(frequent(total).cast("int")).alias("often")), name)
    return table, bool(watch.get["often"])


def joined(rows: DataFrame, one: DataFrame, key: str, total: int, often: bool = True) -> DataFrame:
    """Inner join with a table that has one row a key and counts in ``n`` how many of the
    ``total`` rows have it.  Frequent keys are broadcast, so no task receives all rows of
    one; ``often``: there may be any.  ``n`` goes."""
    if not often or total <= 1000:
        return rows.join(one.drop("n"), key)
    hot, cold = F.broadcast(one.where(frequent(total)).drop("n")), one.where(~frequent(total)).drop("n")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).select(*rest.columns).union(rest)
