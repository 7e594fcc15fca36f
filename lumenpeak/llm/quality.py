"""Quality rules as a ledger of failure bits.

Every rule is evaluated once.  The ledger keeps the measurements of a document and
one bit per failed rule; versioned policies and their ablations then read bits only.
All of it is DataFrame expressions inside one row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpeak.llm.common import SPACES, WORD, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Measurements; the last three serve the rules only.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_noise", "n_wide")
SHOWN = MEASURES[:5]
# Lines whose symbols are no noise: headings and directives, rows of a table, and code.
MARKUP = r"^\s*#|^\s*\|.*\|\s*$|[(){};=]"
# Characters of scripts that are written without spaces.
WIDE = (r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
        r"\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]")

# rule -> SQL condition of a failure over the measurements; bit k is the k-th rule.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "4 * n_noise > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars - n_wide > 30 * n_words",
}
# policy version -> rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "v2": tuple(RULES),
}


def _repeat_words(w: Column) -> Column:
    """Words inside windows of five words that the text holds more than once."""
    def key(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

    keys = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), key)

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False))
                         | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def of(ks: Column) -> Column:
        ordered = F.sort_array(F.transform(ks, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(ks)) == F.size(ks), F.lit(0)).otherwise(
            let(ordered, repeated))

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(keys, of))


def measures(text: Column) -> Column:
    """Struct of all measurements of a text; NULL counts as empty.

    Windows of words are told apart by a 64-bit hash of their five words.  ``n_noise`` are
    the symbols outside of lines that are markup or code; ``n_wide``, of texts of long words
    only, the characters of scripts without spaces.
    """
    text = F.coalesce(text, F.lit(""))

    def length_without(c: Column, chars: str) -> Column:
        return F.length(F.translate(c, chars, ""))

    def of_lines(lines: Column) -> Column:
        other = F.array_join(F.filter(lines, lambda x: ~x.rlike(MARKUP)), "\n")
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"),
                        F.size(lines).alias("n"),
                        let(other, lambda x: F.length(x) - length_without(x, SYMBOLS)).alias("noise"))

    def wide(n_words: Column) -> Column:
        return F.when(length_without(text, SPACES) > 30 * n_words, F.length(text) - F.length(
            F.regexp_replace(text, WIDE, ""))).otherwise(F.lit(0))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    by_word = let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    return let(F.struct(by_word.alias("w"), let(lines, of_lines).alias("l")), lambda m: F.struct(*[
        c.cast("long").alias(name) for name, c in zip(MEASURES, (
            m["w"]["n"], length_without(text, SPACES),
            F.length(text) - length_without(text, SYMBOLS),
            m["l"]["dup"], m["w"]["repeat"], m["l"]["n"], m["l"]["noise"], wide(m["w"]["n"])), strict=True)]))


def with_ledger(docs: DataFrame, rules: dict[str, str] = RULES, text: str = "text") -> DataFrame:
    """``docs`` plus ``ledger``: the measurements and ``failure_bits``.

    NULL and empty texts have zero words.  Repeated rows are judged each by itself.
    Columns of the input stay as they are, except one named ``ledger``.
    """
    if len(rules) > 62:
        raise ValueError("a ledger holds at most 62 rules")
    # exploding one struct keeps later steps from repeating the expression
    df = docs.drop("ledger").select("*", F.explode(F.array(measures(F.col(text)))).alias("ledger"))

    def failing(sql: str) -> Column:
        named = re.sub(rf"\b({'|'.join(MEASURES)})\b", r"ledger.\1", sql)
        return F.coalesce(F.expr(named), F.lit(False)).cast("long")

    bits = F.lit(0).cast("long")
    for k, sql in enumerate(rules.values()):
        bits = bits + F.shiftleft(failing(sql), k)
    return df.withColumn("ledger", F.col("ledger").withField("failure_bits", bits))


def mask(policy: str | tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    order = list(rules)
    return sum(1 << order.index(n) for n in names)


def passes(policy: str | tuple[str, ...], bits: str = "ledger.failure_bits",
           rules: dict[str, str] = RULES) -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str | tuple[str, ...],
              rules: dict[str, str] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and
    that the policy would keep without it.

    Documents are counted per bit pattern first, so what follows is as many rows as
    there are patterns, whatever the corpus holds.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    order, whole = list(rules), mask(policy, rules)
    patterns = ledger.groupBy(F.col("ledger.failure_bits").bitwiseAND(
        F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"),
                                        F.lit(1 << order.index(n)).cast("long").alias("bit"))
                               for n in names]))
    b = F.col("r.bit")
    return patterns.select("bits", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(b) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == b, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(whole).cast("long") - b) == 0,
                     F.col("n")).otherwise(0)).alias("kept_without"))


def judged(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, measurements, base_failed, kept, failure_bits."""
    led = with_ledger(docs.select("doc_id", "text"))
    shown = [F.col(f"ledger.{m}").alias(m) for m in SHOWN]
    return led.select("doc_id", *shown, (~passes("base")).alias("base_failed"),
                      (passes("base") & passes(policy)).alias("kept"),
                      F.col("ledger.failure_bits").alias("failure_bits"))


def kept(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; one named ``ledger`` is kept, too."""
    led = with_ledger(docs.select("text", F.struct(*docs.columns).alias("row")))
    return led.where(passes("base") & passes(policy)).select("row.*")
