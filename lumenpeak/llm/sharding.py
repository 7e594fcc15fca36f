"""A uniform shuffle into shards of exact sizes, from a drawn communication matrix.

How many rows each block sends to each shard is drawn first: the matrix of counts
has the blocks' sizes and the shards' sizes as margins and follows the multivariate
hypergeometric law, as a uniform permutation of all rows would have it.  Then each
block permutes its own rows and deals them out by its line of the matrix, and each
shard permutes what it got.  Only counts are ever looked at together.

Blocks are runs of at most 65,536 rows of one input partition.  The matrix is drawn
in two steps, between groups of blocks and then inside every group in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import let, uniform

SHARDS, SEED = 8, 7
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
BLOCK_BITS = 16  # rows of a block, as a power of two
GROUP = 256      # blocks whose lines of the matrix are drawn together
SLOT_ROWS = 65_536  # rows of a shard that are ordered together


def _ln_factorial(n: Column) -> Column:
    """Exact up to 20!, by Stirling's series (error below 1e-12) beyond."""
    x = n.cast("double")
    series = (x * F.ln(x) - x + 0.5 * F.ln(2 * 3.141592653589793 * x)
              + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))
    return F.when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, sample: Column, u: Column) -> Column:
    """How many of ``sample`` draws from good + bad are good: inverse of the law at ``u``.

    The law is summed over twelve standard deviations to both sides of the mean.
    """
    def choose(n: Column, k: Column) -> Column:
        return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)

    whole = F.greatest(good + bad, F.lit(1).cast("long"))
    mean = sample * good / whole
    spread = F.lit(12.0) * F.sqrt(mean * bad / whole) + 8

    def bounded(low_high: Column) -> Column:
        low, high = low_high["low"], low_high["high"]
        g, b, s, at = (low_high[n] for n in ("good", "bad", "sample", "u"))
        start = F.exp(choose(g, low) + choose(b, s - low) - choose(g + b, s))
        zero = F.struct(start.alias("p"), F.lit(0.0).alias("upto"), F.lit(-1).cast("long").alias("x"))

        def step(acc: Column, x: Column) -> Column:
            upto = acc["upto"] + acc["p"]
            ratio = ((g - x).cast("double") * (s - x)) / ((x + 1).cast("double") * (b - s + x + 1))
            return F.struct(
                (acc["p"] * F.coalesce(ratio, F.lit(0.0))).alias("p"), upto.alias("upto"),
                F.when((acc["x"] < 0) & (upto >= at), x).otherwise(acc["x"]).alias("x"))

        found = F.aggregate(F.sequence(low, high), zero, step, lambda acc: acc["x"])
        return let(found, lambda x: F.when(x < 0, high).otherwise(x))

    zero = F.lit(0).cast("long")
    low = F.greatest(F.greatest(zero, sample - bad), F.floor(mean - spread).cast("long"))
    high = F.least(F.least(good, sample), F.ceil(mean + spread).cast("long"))
    return let(F.struct(low.alias("low"), high.alias("high"), good.alias("good"), bad.alias("bad"),
                        sample.alias("sample"), u.alias("u")), bounded)


def _line(left: Column, n: Column, at: Column, level: int, seed: int) -> Column:
    """One line of the matrix: ``n`` rows dealt over what the shards still take."""
    zero = F.struct(n.alias("need"), F.aggregate(left, F.lit(0).cast("long"), lambda a, b: a + b).alias("rest"),
                    F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, shard: Column) -> Column:
        good = F.get(left, shard)
        bad = acc["rest"] - good
        drawn = hypergeometric(good, bad, acc["need"], uniform(F.lit(seed), F.lit(level), at, shard))
        return let(F.struct(drawn.alias("x"), acc["need"].alias("need"), bad.alias("bad"), acc["out"].alias("out")),
                   lambda d: F.struct((d["need"] - d["x"]).alias("need"), d["bad"].alias("rest"),
                                      F.concat(d["out"], F.array(d["x"])).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(left) - 1), zero, step, lambda acc: acc["out"])


def _lines(parts: Column, sizes: Column, level: int, seed: int) -> Column:
    """Lines for an array of (at, n) structs whose column sums are ``sizes``."""
    zero = F.struct(sizes.alias("left"), F.array().cast("array<array<bigint>>").alias("rows"))

    def step(acc: Column, part: Column) -> Column:
        line = _line(acc["left"], part["n"], part["at"], level, seed)
        return let(F.struct(line.alias("line"), acc["left"].alias("left"), acc["rows"].alias("rows")),
                   lambda d: F.struct(F.zip_with(d["left"], d["line"], lambda a, b: a - b).alias("left"),
                                      F.concat(d["rows"], F.array(d["line"])).alias("rows")))

    drawn = F.aggregate(parts, zero, step, lambda acc: acc["rows"])
    return let(F.struct(parts.alias("p"), drawn.alias("d")), lambda x: F.zip_with(
        x["p"], x["d"], lambda p, d: F.struct(p["at"].alias("at"), d.alias("line"))))


def matrix(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(block, line): rows that each block sends to each shard.

    ``counts`` is (block, n).  Shard sizes differ by at most one, larger ones first.
    """
    n_groups = max(1, -(-counts.count() // GROUP))
    grouped = counts.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n_groups)))
    parts = grouped.groupBy("g").agg(F.sum("n").alias("n"),
                                     F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), "n"))).alias("parts"))
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    sizes = let(total, lambda t: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (
        F.floor(t / shards) + (s < F.pmod(t, F.lit(shards))).cast("long")).cast("long")))
    top = parts.agg(F.sort_array(F.collect_list(F.struct(F.col("g").alias("at"), "n"))).alias("groups")).select(
        F.explode(_lines(F.col("groups"), sizes, 1, seed)).alias("r")).select(
        F.col("r.at").alias("g"), F.col("r.line").alias("sizes"))
    return parts.join(top, "g").select(F.explode(_lines(F.col("parts"), F.col("sizes"), 2, seed)).alias("r")).select(
        F.col("r.at").alias("block"), F.col("r.line").alias("line"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, and the columns ``keep``.

    The law is ``rows``: shard sizes differ by one row at most.  A NULL text has size
    1 and the checksum of no bytes.  Repeated rows are rows of their own.  The table
    of ids is written once, so row numbers hold when tasks run again.  Columns of the
    input that are named as one of the result's are not among those that may be kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.struct(*keep) if keep else F.lit(None)
    whole = written(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"), *([kept.alias("kept")] if keep else [])), "shard-rows")
    rows = whole.drop("kept").withColumn("block", F.shiftright("row", BLOCK_BITS))
    counts = written(rows.groupBy("block").agg(F.count("*").alias("n")), "shard-blocks")
    lines = written(matrix(counts, shards, seed), "shard-matrix")
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "row"), "row")
    upto = F.transform("line", lambda x, i: F.aggregate(
        F.slice("line", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    ranked = rows.withColumn("rank", F.row_number().over(local)).join(
        lines.select("block", upto.alias("upto")), "block")
    dealt = written(ranked.select(
        "doc_id", "size", "text_crc32", "row",
        F.size(F.filter("upto", lambda x: x < F.col("rank"))).alias("shard"),
        F.xxhash64(F.lit(seed), F.lit("shard"), "row").alias("key")), "shard-dealt")
    # slots: places of a random order, cut into even ranges of its key
    cells = F.lit(max(32, -(-dealt.count() // (shards * SLOT_ROWS)))).cast("long")
    cell = F.shiftright(F.shiftrightunsigned("key", 33) * cells, 31)
    dealt = dealt.withColumn("cell", cell)
    held = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "row"))
    placed = dealt.withColumn("inside", inside).join(
        held.select("shard", "cell", before.alias("before")), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row")
    if not keep:
        return placed.drop("row")
    # texts move once, to their row's place
    return placed.join(whole.select("row", "kept"), "row").select(*RESULT, *[F.col(f"kept.`{c}`").alias(c) for c in keep])


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``sharded`` with all columns of ``docs`` but those that the result has itself."""
    own = {c.lower() for c in RESULT}
    return sharded(docs, shards, seed, [c for c in docs.columns if c.lower() not in own])
