"""Quality rules, mixing, decontamination and sharding against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenpeak.llm import decontam, mixing, quality, sharding
from tests.llm.helpers import DOCS, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    inside = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def noise(text):
    """Symbols outside of headings, table rows and code."""
    lines = [x for x in (text or "").split("\n") if WORD.search(x) and not re.match(r"\s*(#|\|.*\|\s*$)", x) and not set(x) & set("(){};=")]
    return sum(len(re.findall(r"[#*$%&|<>]", x)) for x in lines)


def test_clean_texts_of_other_kinds_stay(spark):
    chinese = "\n".join("".join(chr(0x4E00 + (7 * i + 31 * j) % 900) for j in range(60)) for i in range(14))
    code = "\n".join(f"#define FLAG_{i} (1 << {i})" for i in range(20)) + "\nint main() {\n  return a & b | c;\n}"
    table = "# Heading one\n" + "\n".join(f"| name{i} | value{i * i} | note{i} |" for i in range(20))
    junk = [" ".join(f"word{i}###" for i in range(40)), " | ".join(f"word{i}" for i in range(60)), " ".join("x" * 40 + str(i) for i in range(30))]
    df = spark.createDataFrame(list(enumerate([chinese, code, table, *junk])), "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.judged(df).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}


def test_measures(spark):
    rng = random.Random(3)
    texts = [d[1] for d in DOCS] + [" ".join(rng.choice("ab") for _ in range(n)) for n in (4, 5, 6, 9, 30, 80)]
    texts += ["a b\nc\n\na b\nc\n c", "x y z u v x y z u v w x y z u v"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judged(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_policies_and_ablations(spark):
    led = quality.with_ledger(documents(spark))
    rows = {r.rule: r for r in quality.ablations(led, "v2").collect()}
    bits = [r.ledger.failure_bits for r in led.collect()]
    whole = quality.mask("v2")
    for i, rule in enumerate(quality.RULES):
        assert rows[rule].failed == sum(b >> i & 1 for b in bits)
        assert rows[rule].failed_alone == sum(b == 1 << i for b in bits)
        assert rows[rule].kept_without == sum(b & whole & ~(1 << i) == 0 for b in bits)
    assert quality.kept(documents(spark)).columns == documents(spark).columns
    assert quality.judged(empty(spark)).count() == 0


def filled(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) >= 2 * sizes[s]]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = [*"defgh", None, "É"]
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randrange(1, 40))), "en", rng.choice(sources[:rng.randrange(1, 8)]), 0)
            for i in range(400)]
    got = mixing.mixed(documents(spark, rows)).collect()
    sizes, taken, aim = Counter(), Counter(), {}
    of = {r[0]: r[3] for r in rows}
    for r in got:
        sizes[of[r.doc_id]] += r.size
        taken[of[r.doc_id]] += r.taken
        aim[of[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    want = filled(dict(sizes))
    for s in sizes:
        assert abs(aim[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 20  # half of the longest text
    again = mixing.mixed(documents(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_of_awkward_rows(spark):
    docs = documents(spark)
    assert mixing.mixed(docs).count() == len(DOCS)
    many = mixing.repeated(docs)
    assert many.columns == docs.columns
    words = many.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words == mixing.mixed(docs).agg(F.sum("taken")).first()[0]
    assert mixing.mixed(empty(spark)).count() == 0 == mixing.repeated(empty(spark)).count()


def items_in(text, items):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    term = re.compile(decontam.terms.__globals__["TERM"])
    words = term.findall((text or "").translate(low))
    hit, names = set(), set()
    for item, body in items:
        iw = term.findall((body or "").translate(low))
        for k in range(max(1, len(iw) - 12) if iw else 0):
            w = iw[k:k + 13]
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    names.add("" if item is None else str(item))
    return len(words), len(hit), sorted(names)


def test_decontamination(spark):
    import hashlib

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(40)] + [d[1] for d in DOCS]
    items = [(10, texts[0][:60]), (9, "b a c"), (9, texts[3]), (11, None), (12, "!!"), (None, "w7 the w8"), (13, texts[5][3:40]),
             (14, "c"), (14, "c")]
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    for r in decontam.decontaminated(docs, bench).collect():
        n, hit, names = items_in(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns
    assert decontam.decontaminated(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontam.decontaminated(empty(spark), bench).count() == 0


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha x beta gamma", "", "", 0), (2, "alpha beta gamma", "", "", 0),
                             (3, "alpha a b c d e f g h i j k beta gamma", "", "", 0)])
    windows, _ = decontam.windows_of(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = decontam.build_index(docs, windows)
    ids = {r.row: r.doc_id for r in decontam.closing_postings(index).collect()}
    assert {ids[r.row] for r in decontam.proximity_matches(index, windows, slack=3).collect()} == {1, 2}
    assert {ids[r.row] for r in decontam.phrase_matches(index, windows).collect()} == {2}


def test_sharding(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 5), "", "", 0) for i in range(1001)] + [(5000, "same", "", "", 0)] * 30
    got = sharding.sharded(documents(spark, rows).repartition(5), 8).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
    assert sharding.sharded(empty(spark)).count() == 0


def test_matrix_margins_and_law(spark):
    n = spark.range(600).selectExpr("id AS block", "CAST(id % 9 AS bigint) AS n")
    lines = {r.block: r.line for r in sharding.matrix(n, 5).collect()}
    assert all(sum(lines[b]) == b % 9 for b in range(600))
    columns = [sum(line[s] for line in lines.values()) for s in range(5)]
    total = sum(b % 9 for b in range(600))
    assert sum(columns) == total and max(columns) - min(columns) <= 1
    # the law itself: mean and variance of one draw over even quantiles
    u = spark.range(2000).select(sharding.hypergeometric(
        F.lit(300).cast("long"), F.lit(700).cast("long"), F.lit(50).cast("long"), (F.col("id") + 0.5) / 2000).alias("x"))
    mean, var = u.agg(F.avg("x"), F.var_pop("x")).first()
    assert abs(mean - 15) < 0.05 and abs(var - 50 * 0.3 * 0.7 * 950 / 999) < 0.2
