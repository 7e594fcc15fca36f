"""The given tables seen as spectra, truth and candidates; in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpeak.functions.constants import LINES, TRY_LINES
from lumenpeak.operators import candidates as C
from lumenpeak.operators import forest as E
from lumenpeak.operators.halo import positions
from lumenpeak.operators.peaks import smoothing_kernel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under its operator id, with its SQL if it has one."""

    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Round doubles (all, unless named) so that summation order does not show."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def rounded_sql(sql: str, *columns: str, digits: int = DIGITS) -> str:
    items = ", ".join(f'(round("{c}", {digits}) + 0.0)::DOUBLE AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({items}) FROM ({sql})"


def num(value: float) -> str:
    """SQL double literal."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


# --- pixels: one spectrum per supplier ---------------------------------------

# Orders per numbering block: bounds the rows of one supplier sorted in a task.
ORDER_BLOCK = 65536


def pixels(spark: SparkSession, sf: str, block: int = ORDER_BLOCK) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("SPECID"), "l_orderkey", "l_linenumber", "l_partkey",
        "l_extendedprice", F.col("l_quantity").alias("flux"),
        (1.0 / (0.1 + F.abs("l_discount"))).alias("ivar"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    numbered = positions(rows, ["SPECID"], order, F.expr(f"l_orderkey div {block}"))
    return numbered.select("SPECID", "pix", (3600.0 + 10.0 * F.col("pix")).alias("wave"),
                           "flux", "ivar")


PIXELS = """pixels AS (
  SELECT SPECID, pix, 3600.0e0 + 10.0e0 * pix AS wave, flux, ivar FROM (
    SELECT l_suppkey AS SPECID,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
                              l_partkey, l_extendedprice) - 1 AS pix,
           l_quantity AS flux, 1.0e0 / (0.1e0 + abs(l_discount)) AS ivar
    FROM lineitem))"""

# width in pixels and least significance of the registered peak queries
WIDTH, MIN_SIG = 2.0, 45.0


def smoothed_sql(width: float) -> str:
    taps = smoothing_kernel(width)
    half = len(taps) // 2
    terms = []
    for k, t in enumerate(taps):
        off = k - half
        flux = ("flux" if off == 0 else f"lag(flux, {-off}) OVER w" if off < 0
                else f"lead(flux, {off}) OVER w")
        terms.append(f"coalesce({flux}, 0.0e0) * {num(t)}")
    return " + ".join(terms)


def peaks_sql(width: float = WIDTH, min_sig: float = MIN_SIG) -> str:
    """CTEs smoothed, framed and peaks over the CTE pixels."""
    from lumenpeak.operators.peaks import frame_sizes

    full, half = frame_sizes(width)

    def frame(lo: int, hi: int) -> str:
        def bound(v):
            return f"{-v} PRECEDING" if v < 0 else f"{v} FOLLOWING"

        return (f"(PARTITION BY SPECID ORDER BY pix ROWS BETWEEN {bound(lo)} AND {bound(hi)})")

    return f"""smoothed AS (
  SELECT *, {smoothed_sql(width)} AS smoothed FROM pixels
  WINDOW w AS (PARTITION BY SPECID ORDER BY pix)),
framed AS (
  SELECT SPECID, pix, wave, smoothed,
         lag(smoothed) OVER w AS before, lead(smoothed) OVER w AS after,
         avg(flux) OVER {frame(-half, half - 1)} AS peak,
         avg(flux) OVER {frame(-full, -half - 1)} AS blue,
         avg(flux) OVER {frame(half, full - 1)} AS red,
         sum(ivar) OVER {frame(-full, full - 1)} AS weight,
         pix >= {full} AND pix + {full} <= count(*) OVER (PARTITION BY SPECID) AS inside
  FROM smoothed WINDOW w AS (PARTITION BY SPECID ORDER BY pix)),
peaks AS (
  SELECT SPECID, pix, wave, (peak - (blue + red) / 2.0e0) * sqrt(weight) AS significance
  FROM framed
  WHERE smoothed > before AND smoothed > after AND inside AND weight <> 0
    AND (peak - (blue + red) / 2.0e0) * sqrt(weight) >= {num(min_sig)})"""


def lines_sql() -> str:
    rows = ", ".join(f"({i}, '{line[0]}', {', '.join(num(v) for v in line[1:])})"
                     for i, line in enumerate(LINES))
    return (f"lines(line_index, LINE, WAVE, \"START\", \"END\", BLUE_START, BLUE_END, RED_START, "
            f"RED_END) AS (VALUES {rows})")


def try_lines_sql() -> str:
    waves = {line[0]: (i, line[1]) for i, line in enumerate(LINES)}
    rows = ", ".join(f"({o}, '{n}', {waves[n][0]}, {num(waves[n][1])})"
                     for o, n in enumerate(TRY_LINES))
    return f"try_lines(try_order, ASSUMED_LINE, assumed_index, rest_wave) AS (VALUES {rows})"


TRIALS = f"""{try_lines_sql()},
trials AS (
  SELECT SPECID, pix AS peak_pix, try_order, ASSUMED_LINE, assumed_index,
         wave / rest_wave - 1.0e0 AS Z_TRY, significance AS PEAK_SIGNIFICANCE
  FROM peaks, try_lines WHERE wave / rest_wave - 1.0e0 >= 0)"""

MEMBERS = f"""{lines_sql()},
bands AS (
  SELECT line_index, 0 AS band, "START" AS lo, "END" AS hi FROM lines UNION ALL
  SELECT line_index, 1, BLUE_START, BLUE_END FROM lines UNION ALL
  SELECT line_index, 2, RED_START, RED_END FROM lines),
members AS (
  SELECT t.SPECID, t.peak_pix, t.try_order, b.line_index, b.band, p.wave, p.flux, p.ivar
  FROM trials t CROSS JOIN bands b JOIN pixels p
    ON p.SPECID = t.SPECID AND p.wave >= (1.0e0 + Z_TRY) * b.lo
   AND p.wave <= (1.0e0 + Z_TRY) * b.hi)"""

METRICS = """sums AS (
  SELECT SPECID, peak_pix, try_order, line_index,
         count(*) FILTER (band = 0) AS n0, count(*) FILTER (band = 1) AS n1,
         count(*) FILTER (band = 2) AS n2, avg(flux) FILTER (band = 0) AS f0,
         avg(flux) FILTER (band = 1) AS f1, avg(flux) FILTER (band = 2) AS f2,
         sum(ivar) FILTER (band = 0) AS v0, sum(ivar) FILTER (band = 1) AS v1,
         sum(ivar) FILTER (band = 2) AS v2
  FROM members GROUP BY ALL),
ratios AS (
  SELECT *, f1 + f2 AS cont, 2.0e0 * f0 / (f1 + f2) AS ratio FROM sums
  WHERE n0 > 0 AND n1 > 0 AND n2 > 0 AND n1 >= n0 // 2 AND n2 >= n0 // 2 AND f1 + f2 <> 0),
metrics AS (
  SELECT SPECID, peak_pix, try_order, line_index, ratio,
         CASE WHEN v0 <> 0 AND v1 <> 0 AND v2 <> 0 THEN (ratio - 1.0e0) /
           (sqrt(4.0e0 / v0 + ratio * ratio * (1.0e0 / v1 + 1.0e0 / v2) / 4.0e0) / abs(cont))
         END AS ratio_sn,
         abs((f2 - f1) / cont) AS ratio2
  FROM ratios)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- truth: one object per supplier or customer ------------------------------


def truth_columns(key: str) -> dict:
    k = F.col(key)
    m = k % 5
    return {
        "CLASS_PERSON": F.when(m == 0, 1).when(m == 2, 30).when(m == 3, 4).otherwise(3),
        "Z_TRUE": (k * 37 % 400) / 100.0,
        "R_MAG": 17.0 + (k * 13 % 60) / 10.0,
        "Z_CONF_PERSON": F.when(k % 4 == 0, 2).otherwise(3),
    }


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("SPECID")).withColumns(
        truth_columns("SPECID"))


def truth_sql_columns(key: str) -> str:
    return f"""CASE {key} % 5 WHEN 0 THEN 1 WHEN 2 THEN 30 WHEN 3 THEN 4 ELSE 3 END AS CLASS_PERSON,
  ({key} * 37 % 400) / 100.0e0 AS Z_TRUE, 17.0e0 + ({key} * 13 % 60) / 10.0e0 AS R_MAG,
  CASE WHEN {key} % 4 = 0 THEN 2 ELSE 3 END AS Z_CONF_PERSON"""


TRUTH = f"""truth AS (SELECT s_suppkey AS SPECID, {truth_sql_columns('s_suppkey')}
  FROM supplier)"""

# --- scored candidates: one per order, about ten per customer ----------------


def customer_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue of the quasars among the customers."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("SPECID")).withColumns(
        truth_columns("SPECID")).where(F.col("CLASS_PERSON").isin(3, 30))


CUSTOMER_TRUTH = f"""qso AS (SELECT * FROM (SELECT c_custkey AS SPECID,
  {truth_sql_columns('c_custkey')} FROM customer) WHERE CLASS_PERSON IN (3, 30))"""


def orders_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(n) for n in TRY_LINES])
    return (table(spark, sf, "orders").select(
        F.col("o_custkey").alias("SPECID"), k.alias("cand_id"),
        ((k * 31 % 400) / 100.0).alias("Z_TRY"), ((k * 7919 % 1000) / 1000.0).alias("PROB"),
        ((k * 17 % 1200) / 100.0).alias("PEAK_SIGNIFICANCE"),
        F.element_at(names, (k % 6 + 1).cast("int")).alias("ASSUMED_LINE"))
        .withColumns(truth_columns("SPECID")))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with truth and duplicate flags, by the library's own operators."""
    return E.with_duplicates(C.with_truth(orders_candidates(spark, sf)), ["cand_id"])


_NAMES = "[" + ", ".join(f"'{n}'" for n in TRY_LINES) + "]"
_QUASAR = "CLASS_PERSON IN (3, 30)"
ORDERS_CANDIDATES = f"""cand AS (SELECT o_custkey AS SPECID, o_orderkey AS cand_id,
  (o_orderkey * 31 % 400) / 100.0e0 AS Z_TRY, (o_orderkey * 7919 % 1000) / 1000.0e0 AS PROB,
  (o_orderkey * 17 % 1200) / 100.0e0 AS PEAK_SIGNIFICANCE,
  {_NAMES}[o_orderkey % 6 + 1] AS ASSUMED_LINE, {truth_sql_columns('o_custkey')} FROM orders)"""


def truth_flags_sql(source: str, out: str, p: float = 0.15) -> str:
    """CTEs adding DELTA_Z, CORRECT_REDSHIFT, IS_CORRECT, IS_LINE; needs the CTE lines."""
    return f"""{out}_a AS (SELECT *, Z_TRY - Z_TRUE AS DELTA_Z FROM {source}),
{out}_b AS (SELECT *, coalesce(CLASS_PERSON <> 1 AND DELTA_Z BETWEEN -{num(p)} AND {num(p)}, false)
  AS CORRECT_REDSHIFT FROM {out}_a),
{out}_c AS (SELECT *, CORRECT_REDSHIFT AND {_QUASAR} AS IS_CORRECT FROM {out}_b),
{out} AS (SELECT c.*, IS_CORRECT OR ({_QUASAR} AND EXISTS (
    SELECT 1 FROM lines a, lines o WHERE a.LINE = c.ASSUMED_LINE AND o.LINE <> a.LINE
    AND a.WAVE / o.WAVE * (1 + Z_TRY) - 1 - Z_TRUE BETWEEN -{num(p)} AND {num(p)})) AS IS_LINE
  FROM {out}_c c)"""


SCORED = f"""{lines_sql()},
{ORDERS_CANDIDATES},
{truth_flags_sql('cand', 'flagged')},
scored AS (SELECT *, row_number() OVER (PARTITION BY SPECID ORDER BY PROB DESC NULLS LAST, cand_id)
  > 1 AS DUPLICATED FROM flagged)"""
