"""Lexical search, weighted fingerprints and the conversation trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenpeak.llm import convtrie, lexical, weighted
from tests.llm.helpers import DOCS, documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_search(docs, items, top):
    known = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(known), sum(sum(c.values()) for _, c in known)
    out = []
    for item, text in items:
        scored = []
        for doc, counts in known:
            length = 50 + (50 * sum(counts.values()) * n) // total
            score = 0
            for t in set(terms(text)):
                df = sum(t in c for _, c in known)
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += w * ((10 ** 9 * counts[t]) // (1000 * counts[t] + 20 * length))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return out


def same(rows, want):
    return sorted(map(str, rows)) == sorted(map(str, want))


@pytest.mark.parametrize("shard, cells", [(1 << 15, 1 << 22), (7, 8)])
def test_search_finds_the_best_with_ties(spark, monkeypatch, shard, cells):
    rng = random.Random(3)
    vocabulary = ["the", "a", *[f"w{i}" for i in range(30)], "É", "漢字"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 8])))) for i in range(120)]
    docs += [(200 + i, docs[0][1]) for i in range(60)]  # copies: ties by id
    docs += [(r[0], r[1]) for r in DOCS]
    items = [(1, "The w1 w2 w3! W1"), (1, "the"), (2, None), (3, ""), (None, "É-漢字"), (4, "nowhere"), (5, docs[0][1])]
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "CELLS", cells)
    frame = documents(spark, [(i, t, None, None, None) for i, t in docs]).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"q": F.lit(1), "doc_id": F.lit(2)})
    got = lexical.ranked(frame, asked, 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert same([tuple(r) for r in got.collect()], plain_search(docs, items, 5))


def test_search_in_blocks_of_queries_and_without_rows(spark, monkeypatch):
    docs, items = documents(spark), documents(spark).select(F.col("doc_id").alias("item_id"), "text")
    whole = sorted(map(str, lexical.ranked(docs, items).collect()))
    monkeypatch.setattr(lexical, "QUERY_TERMS", 2000)
    assert sorted(map(str, lexical.ranked(docs, items).collect())) == whole
    assert lexical.ranked(empty(spark), items).count() == 0
    assert lexical.ranked(docs, items.where("false")).count() == 0


def test_best_positions_stop_early():
    rng = np.random.default_rng(1)
    size = 5000
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.stop is not None:
                reads.append(min(key.stop, size))
            return super().__getitem__(key)

    lists = []
    for _ in range(3):
        impacts = rng.pareto(1.0, size) * 1000
        impacts[7] = 1e9  # one document leads every list
        order = np.argsort(-impacts, kind="stable")
        lists.append((order.view(Watched), impacts[order].astype(np.int64)))
    docs, scores = lexical.best(lists, size, 1)
    assert docs.tolist() == [7] and max(reads) < size // 10
    dense = sum(np.asarray(v)[np.argsort(np.asarray(d))] for d, v in lists)
    docs, scores = lexical.best(lists, size, 40)
    assert scores.tolist() == sorted(dense.tolist(), reverse=True)[:40]


# --- fingerprints ---------------------------------------------------------------------


def jaccard(a, b):
    x, y = ({t: weighted.weight(t, n) for t, n in weighted.weighted_terms(s).items()} for s in (a, b))
    return sum(min(x.get(t, 0), y.get(t, 0)) for t in x | y) / sum(max(x.get(t, 0), y.get(t, 0)) for t in x | y)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.9])
def test_samples_collide_as_often_as_the_weights_overlap(share):
    rng = random.Random(9)
    sampler = weighted.Sampler(2000)
    for words in (5, 60, 900):
        a = [f"word{rng.randrange(words)}" for _ in range(2 * words)]
        b = [w if rng.random() < share else f"other{rng.randrange(words)}" for w in a]
        a, b = " ".join(a), " ".join(b)
        want = jaccard(a, b)
        assert abs(weighted.likeness(*sampler.draw(a, b)) - want) < 4 * math.sqrt(want * (1 - want) / 2000) + 0.003


def test_gamma_variates_follow_their_law():
    x = weighted.gamma_quantiles(np.array([1e-9, 1e-4, 0.1, 0.5, 0.9, 0.999]))
    assert np.allclose(1 - np.exp(-x) * (1 + x), [1e-9, 1e-4, 0.1, 0.5, 0.9, 0.999], atol=1e-12, rtol=1e-5)
    sampler = weighted.Sampler(4000)
    seeds = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)
    arrival, steps = sampler.arrivals(seeds, np.full(50, 10))
    # the arrival time of a weight w is exponential with rate w
    times = np.exp(arrival.astype(float)).ravel()
    assert abs(times.mean() * 10 - 1) < 0.02 and abs((times < 0.01).mean() - (1 - math.exp(-0.1))) < 0.003


def plain_fingerprints(docs):
    from pyspark.sql import SparkSession

    texts = [t or "" for _, t in docs]
    marks = [r[0] for r in SparkSession.active().createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    rows = sorted(((i is not None, i or 0, m, i, t) for (i, _), t, m in zip(docs, texts, marks)), key=lambda r: r[:3])
    sampler, out = weighted.Sampler(), []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        n = len(r[4]) // 4
        changed = r[4][:len(r[4]) - n] + after[4][:n]
        own, other, following = (sampler.draw(t)[0] for t in (r[4], changed, after[4]))
        out.append((r[3], len(r[4]), hashlib.sha256(changed.encode()).hexdigest(), weighted.shown(own),
                    weighted.shown(other), float((own == other).mean()), float((own == following).mean())))
    return out


@pytest.mark.parametrize("piece", [1 << 23, 500])
def test_fingerprints_of_texts_and_their_edits(spark, monkeypatch, piece):
    monkeypatch.setattr(weighted, "PIECE", piece)
    docs = [(r[0], r[1]) for r in DOCS] + [(20 + i, f"doc {i} " + "é ß 漢字 " * i) for i in range(40)] + [(90, "漢" * 300)]
    frame = documents(spark, [(i, t, None, None, None) for i, t in docs]).withColumns(
        {"mark": F.lit("x"), "piece": F.lit("x"), "guest": F.lit("x"), "body": F.lit("x")}).repartition(4)
    rows = [tuple(r) for r in weighted.fingerprinted(frame).collect()]
    assert same(rows, plain_fingerprints(docs))
    assert len({r[3] for r in rows if r[0] in (3, 4, 5)}) == 1


def test_fingerprint_of_one_row_and_of_none(spark):
    one = documents(spark, [(1, "a b c d", None, None, None)])
    (row,) = weighted.fingerprinted(one).collect()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest()
    assert weighted.fingerprinted(empty(spark)).count() == 0


# --- conversation trie -----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_findclose(seed):
    rng = random.Random(seed)
    bits, open_ = [1], 1
    while open_ and len(bits) < 3000:
        up = rng.random() < (0.55 if len(bits) < 1500 else 0.4) or open_ == 1
        bits.append(int(up))
        open_ += 1 if up else -1
    bits += [0] * open_
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    bits = np.array(bits, np.int8)
    for block in (4, 64):
        opens = np.flatnonzero(bits)
        assert convtrie.Parens(bits, block).findclose(opens).tolist() == [want[i] for i in opens.tolist()]


def plain_trie(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [t[2:] for t in sorted(v)] for c, v in by.items()}
    made = {}
    for c, own in by.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        leader = None if c is None else by.get(c - int(math.fmod(c, 100)), [])
        made[c] = ([] if c is None else leader[:h]) + own[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in nodes.items()}
    out = []
    for k, members in nodes.items():
        below = [n for n in nodes if n[:len(k)] == k]
        children = [n for n in nodes if len(n) == len(k) + 1 and n[:len(k)] == k]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in nodes)]
        ends = ",".join(str(c) for c in sorted(c for c in members if c is not None and len(made[c]) == len(k)))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(members), len(children), len(leaves),
                    sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(seed=5, n=60):
    rng, rows = random.Random(seed), []
    for c in [*range(0, 260, 3), *range(400, 400 + n), 1000, 7_000_000_123]:
        for k in range(rng.randrange(1, 7)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", rng.choice(["hi", "hello there", "é漢", ""])))
    rows += [(None, 0, "user", "hi"), (None, 1, None, None), (501, None, "user", "hi"), (501, None, "user", "hi"),
             (502, 1, "b", "x"), (502, 1, "a", "y"), (503, 0, "user", "z" * 5000)]
    rows += [(600 + i, k, "user", t) for i in range(30) for k, t in enumerate(("same", "talk", "here", "and", "there", "now", "end"))]
    return rows


@pytest.mark.parametrize("shard, ids", [(1 << 14, 1 << 12), (1, 8), (3, 1 << 12)])
def test_trie(spark, monkeypatch, shard, ids):
    monkeypatch.setattr(convtrie, "SHARD", shard)
    monkeypatch.setattr(convtrie, "IDS", ids)
    rows = talks()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("x") for c in ("k", "s", "path", "digest", "len", "kind")}).repartition(5)
    got = convtrie.nodes(frame)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert same([tuple(r) for r in got.collect()], plain_trie(rows))


def test_trie_without_rows_and_without_turns(spark):
    frame = spark.createDataFrame([(c, 0, "user", "hi") for c in range(500, 530)], "conv_id long, turn long, role string, text string")
    assert convtrie.nodes(frame.where("false")).count() == 0
    rows = [tuple(r) for r in frame.where("conv_id > 500").collect()]  # no leader: many are turnless
    assert same([tuple(r) for r in convtrie.nodes(frame.where("conv_id > 500")).collect()], plain_trie(rows))
