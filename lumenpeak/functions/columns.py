"""Column helpers: missing values, guarded ratios, exact cut lookup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float column; inside the engine missing is NULL."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats})


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as DOUBLE, NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def bound(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns (SQL expressions) that later expressions use many times.

    Spark merges neighbouring projections and would repeat the expressions at
    every use; generating one row from each row keeps them apart.
    """
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return df.selectExpr("*", f"inline(array(named_struct({fields})))")


def total(columns: Sequence[Column]) -> Column:
    """Left-to-right sum; the order is fixed so results are reproducible."""
    return reduce(lambda a, b: a + b, columns)


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# Up to this many cuts are compared one by one.
FEW_CUTS = 16


def cut_index(value: Column, cuts: Sequence[float], passes: str) -> Column:
    """Index of the first cut the value passes; len(cuts) if none, or if NULL or NaN.

    ``cuts`` are ordered from hardest to easiest, so a row that passes cut ``i``
    passes every later one, and counts per cut are running sums over the index.
    ``passes`` is the operator of ``value <op> cut``.  On an evenly stepped grid
    the index is computed and then settled by comparing with the cuts around it,
    so it is exact without trying every cut.
    """
    n = len(cuts)
    value = F.when(~F.isnan(value), value)  # a NaN passes no cut, whatever their number
    compare = {
        ">=": lambda v, c: v >= c,
        ">": lambda v, c: v > c,
        "<=": lambda v, c: v <= c,
        "<": lambda v, c: v < c,
    }[passes]
    if n <= FEW_CUTS:
        chain = F.when(value.isNull(), n)
        for i, c in enumerate(cuts):
            chain = chain.when(compare(value, F.lit(float(c))), i)
        return chain.otherwise(n)
    grid = literal_array(cuts)
    step = (cuts[-1] - cuts[0]) / (n - 1)
    if any(abs(c - (cuts[0] + i * step)) > abs(step) / 4 for i, c in enumerate(cuts)):
        return F.when(value.isNull(), n).otherwise(
            F.size(F.filter(grid, lambda c: ~compare(value, c))))
    guess = F.ceil(F.greatest(F.lit(0.0), F.least(
        F.lit(float(n - 1)), (value - float(cuts[0])) / float(step)))).cast("int")

    def good(i: Column) -> Column:
        return F.coalesce(compare(value, F.get(grid, i)), F.lit(False))

    return (F.when(good(guess - 1), guess - 1).when(good(guess), guess)
            .when(good(guess + 1), guess + 1).otherwise(n))


def with_cut_index(df: DataFrame, out: str, value: str, cuts: Sequence[float],
                   passes: str) -> DataFrame:
    return df.withColumn(out, cut_index(F.col(value), list(cuts), passes))
