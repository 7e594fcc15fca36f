"""SimHash, licences, toxicity, HTML, chat, WARC and the pipeline."""

import gzip
import hashlib
import os
import random
from collections import Counter
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import SMALL
from lumenpeak.llm import chat, components, licenses, mainhtml, nearcopies, simhash, toxicity, warc
from tests.llm.helpers import DOCS, documents, empty
from tests.llm.test_native import WORD, items_in, measured, noise

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def shingled(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def duplicates(texts):
    """Smallest index of every text's class: four bits or a Jaccard similarity of 0.8."""
    first = linked([brute(t) for t in texts])
    sets = [shingled(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if first[i] != first[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = [new if x == old else x for x in first]
    return first


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_near_copies_beyond_four_bits(spark):
    rng = random.Random(9)
    texts = []
    for k in range(25):  # copies of copies: the last ones are far from the first
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 80, 300)))]
        for step in range(5):
            texts.append(" ".join(words))
            words = edited(rng, words, max(1, len(words) * (step + 1) // 125))
    hot = [f"h{rng.randrange(5000)}" for _ in range(200)]  # many near copies of one text
    texts += [" ".join(edited(rng, hot, 2)) for _ in range(300)]
    half = [f"b{i}" for i in range(100)]  # half of the text is common: no copies, but for each second one
    for k in range(60):
        own = [f"o{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(half + own), " ".join(half + edited(rng, own, 2))]
    texts += ["one two three", "One two THREE", "one two four", "", None]
    want = duplicates(texts)
    bits = linked([brute(t) for t in texts])
    assert len(set(want)) < len(set(bits)) - 100 and len(set(want[-125:-5])) == 60
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    docs = documents(spark, rows).repartition(7)
    got = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert got == sorted(set(want))
    # a group of one text's copies where few pairs are near copies: none is linked wrongly, few links are missed
    texts = [" ".join(edited(rng, hot, 3)) for _ in range(300)]
    want = set(duplicates(texts))
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    got = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert want <= got and len(got) <= len(want) + 45
    assert nearcopies.filed(nearcopies.signed(empty(spark), simhash.fingerprint)).count() == 0


def test_no_neighbour_bound_loses_a_near_copy(spark):
    rng = random.Random(31)
    hot = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(edited(rng, hot, 3)) for _ in range(300)]
    want = sorted(set(duplicates(texts)))
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == want
    signed = nearcopies.signed(docs, simhash.fingerprint)
    none = spark.createDataFrame([], "u BIGINT, v BIGINT")
    classes = {few: sorted(map(tuple, components.components(nearcopies.links(docs, signed, none, few=few)).collect()))
               for few in (0, 10**9)}
    assert classes[0] == classes[10**9]
    # every pair of a bucket meets once, whatever the size of the blocks
    rows = nearcopies.filed(signed).withColumn("root", F.abs(F.col("fp") % 3))
    met = {}
    for r in rows.collect():
        met.setdefault(r.bucket, []).append((r.key, r.root, np.frombuffer(r.sig, np.uint16)))
    pairs = {(min(a, b), max(a, b)) for group in met.values() for i, (a, u, x) in enumerate(group)
             for b, v, y in group[:i] if u != v and (x == y).sum() >= nearcopies.AGREE}
    assert len(pairs) > 1000
    for block in (7, 1024):
        assert sorted((r.a, r.b) for r in nearcopies.meetings(rows, block).collect()) == sorted(pairs)


def near_texts():
    rng = random.Random(1)
    base = [" ".join(str(rng.randrange(900)) for _ in range(300)) for _ in range(6)]
    return [b[:k] + "Z" + b[k:] for b in base for k in range(0, 400, 45)] + base + [d[1] for d in DOCS]


def test_classes(spark):
    texts = near_texts()
    rows = [(i + 3, t, "en", "a", 0) for i, t in enumerate(texts)]
    fps = [brute(t) for t in texts]
    want = linked(fps)
    got = simhash.classes(documents(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i + 3, f"{f:016x}", w + 3) for i, (f, w) in enumerate(zip(fps, want))}
    assert len(set(want)) < len(want) - 20
    left = simhash.deduplicated(documents(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted({w + 3 for w in duplicates(texts)})
    again = documents(spark, rows[:20] * 2 + [(None, texts[0], "", "", 0)])
    assert sorted(r.doc_id for r in simhash.deduplicated(again).collect()) == sorted({w + 3 for w in duplicates(texts[:20])})
    assert simhash.classes(empty(spark)).count() == 0
    assert simhash.classes(documents(spark)).count() == len(DOCS)


def test_every_near_pair_collides():
    rng = random.Random(2)
    masks = simhash.masks()
    assert len(masks) == 31
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in masks)


def test_large_buckets_lose_nothing(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(14):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    want = linked(fps)
    for bucket in (2, 10**6):
        roots = {r.node: r.root for r in components.components(simhash.links(df, bucket=bucket)).collect()}
        groups = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
        assert len({*zip(groups, want)}) == len(set(groups)) == len(set(want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_components_hold_no_large_plan(spark, monkeypatch):
    rng = random.Random(12)
    pairs = [(5, i) for i in range(1000, 4000)] + [(9, i) for i in range(3999, 6000)]  # frequent centres
    pairs += [(i, rng.randrange(10_000, i)) for i in range(10_001, 10_400)] + [(20_000 + i, 20_001 + i) for i in range(30)]
    plans, write = [], components.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(components, "written", seen)
    stars = components.components(spark.createDataFrame(rng.sample(pairs, len(pairs)), "u long, v long"))
    got = {r.node: r.root for r in stars.collect()}
    want = {**{i: 5 for i in (5, 9, *range(1000, 6000))}, **{i: 10_000 for i in range(10_000, 10_400)},
            **{i: 20_000 for i in range(20_000, 20_031)}}
    assert got == want
    # what the driver plans is a join or an aggregation, and nothing more for what is settled
    assert max(p.count("Join") for p in plans) <= 4 and max(p.count("Aggregate") for p in plans) <= 4
    plans.clear()
    again = components.components(stars.selectExpr("root AS u", "node AS v"))
    assert {r.node: r.root for r in again.collect()} == want and len(plans) == 2


def test_licenses(spark):
    rng = random.Random(6)
    bag = "mit apache general public license the software x".split()
    texts = [" ".join(rng.choice(bag) for _ in range(rng.randrange(60))) for _ in range(60)] + [d[1] for d in DOCS]
    texts += ["Text. Licensed under CC BY-NC 4.0. More.", "mit license " * 3, licenses.TEMPLATES[0][1].upper()]
    got = licenses.scanned(documents(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).collect()
    for r in got:
        w = licenses.words_of(texts[r.doc_id])
        found = [(i, l) for p, l in licenses.BASE.items() for i in range(len(w))
                 if w[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == (min((i for i, _ in found), default=None), max((i for i, _ in found), default=None))
        assert r.base_labels == ",".join(sorted({l for _, l in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[-3].labels == "cc-by-nc" and got[-1].labels == "mit" and got[-2].n_base == 3
    assert licenses.scanned(empty(spark)).count() == 0


def test_matching_statistics():
    machine = licenses.build().machine
    texts = [licenses.words_of(t) for _, t in licenses.TEMPLATES]
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(7)
    for _ in range(30):
        words = []
        while len(words) < 60:
            t = rng.choice(texts)
            a = rng.randrange(len(t))
            words += t[a:a + rng.randrange(1, 9)] + ["zzz"] * rng.randrange(2)
        _, found = machine.scan(words)
        assert [stop for stop, _, _ in found] == [i + 1 for i, w in enumerate(words) if (w,) in runs]
        for stop, n, _ in found:
            assert tuple(words[stop - n:stop]) in runs
            assert stop - n == 0 or tuple(words[stop - n - 1:stop]) not in runs


def common_places(words, text):
    """Places of equal words that stand on a common run of two words or more."""
    same = {(i, j) for i, w in enumerate(words) for j, x in enumerate(text) if w == x}
    return sorted(p for p in same if (p[0] - 1, p[1] - 1) in same or (p[0] + 1, p[1] + 1) in same)


def best_cover(words, text, tells, gap=licenses.MAX_GAP):
    """Share of a template in the best chain, every pair of places against every pair before it."""
    marks = {j for j, w in enumerate(text) if w in tells or w in licenses.NAMING}
    best = {}
    for i, j in common_places(words, text):
        before = [n for (a, b), n in best.items() if a < i and b < j and i - a - 1 <= gap and not marks & set(range(b + 1, j))
                  and not any(w in tells for w in words[a + 1:i])]
        if before or not marks & set(range(j)):
            best[i, j] = 1 + max(before, default=0)
    return max((n for (_, j), n in best.items() if not any(m > j for m in marks)), default=0) / len(text)


def tells_of(texts):
    out = []
    for label, text in texts:
        own = set()
        for name, other in texts:
            words = sorted(text + other)
            alone = [w for w in set(words) if text.count(w) != other.count(w)]
            if name != label and sum(abs(text.count(w) - other.count(w)) for w in alone) <= 4:
                own |= set(alone)
        out.append(own)
    return out


def test_notices_behind_their_own_phrases():
    built = licenses.build()
    rng = random.Random(11)
    texts = [(label, licenses.words_of(t)) for label, t in licenses.TEMPLATES]
    tells = tells_of(texts)
    assert tells == built.tells
    label, mit = texts[0]
    got = licenses.scan_text("applies to the Software. " + licenses.TEMPLATES[0][1], built)
    assert (got[5], got[6], [s for s in got[7] if s["label"] == "mit"]) == (
        "mit", 1.0, [{"label": "mit", "start": 4, "stop": 66, "coverage": 1.0}])
    for label, text in texts:
        for at in range(0, len(text) - 1, 5):
            begin = text[at:at + rng.randrange(2, 5)] + ["zzz"] * rng.randrange(3)
            edited = [w for w in text if rng.random() > 0.06]
            for k in range(rng.randrange(4)):
                edited.insert(rng.randrange(len(edited) + 1), rng.choice([*text, "zzz", "nd", "lesser"]))
            for notice in (text, edited):
                words = begin + notice
                got = licenses.scan_text(" ".join(words), built)
                covers = [(best_cover(words, t, own), name) for (name, t), own in zip(texts, tells)]
                labels = {name for c, name in covers if c >= licenses.MIN_COVER}
                assert set(got[5].split(",")) - {""} == labels | set(got[4].split(",")) - {""}
                assert got[6] == (1.0 if got[1] else max((c for c, name in covers if name in labels), default=0.0))
                assert notice is edited or label in labels
    twice = licenses.scan_text("so " + " ".join(mit) + " zzz " + " ".join(mit), built)[7]
    assert [(s["start"], s["stop"]) for s in twice if s["label"] == "mit"] == [(1, 63), (64, 126)]


@pytest.mark.parametrize("text, labels", [
    ("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
    ("Licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd"), ("licensed, since 2019, under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("Licensed under CC BY-XX 4.0", "cc-by"), ("Released under the WTF License", ""), ("Released under the BSD License", "bsd"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under the GNU Lesser General Public License, version 3", "gpl,lgpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("Licensed under CC0 1.0", "cc0")])
def test_licences_that_read_much_the_same(text, labels):
    assert licenses.scan_text(text, licenses.build())[5] == labels


def test_a_template_inside_a_longer_run_of_another():
    got = licenses.scan_text('Licensed under the Apache License, Version 2.0 (the "License") hello', licenses.build())
    assert {"label": "apache", "start": 0, "stop": 8, "coverage": 1.0} in got[7]


@pytest.mark.parametrize("piece", [
    ("", "<span>", "</p></section>"), ("", "<b>", "</i></u>"), ("", "<a ", ""), ("", "<i><div><b></i>", ""),
    ("", '<a ">" ', ""), ("<script>", "</script ", ""), ("", "<!", ""), ("<ul>", "<li><b>", ""),
    ("<select>", "<span>", "<body>"), ("<table>", "<b>", "<td>x"), ("", "<div>", "</div>"), ("", "<a 'x", "\""),
    ("", "&amp;<p>", "</h1>"), ("", "<textarea", ">"), ("<head>", "<title><p>", "</title>")])
def test_broken_markup_takes_linear_time(piece):
    begin, one, two = piece
    n = 1_000_000 // (len(one) + len(two))
    started = time.process_time()
    page = mainhtml.Page(begin + one * n + two * n)
    page.features()
    assert time.process_time() - started < 5


@pytest.mark.parametrize("source, want", [
    ("<div>a<p>b</div>c", ["a", "b", "c"]), ("<p>a<b>b<div>c</b>d</div>e", ["ab", "cd", "e"]),
    ("<a title='x>y'>a</a><a title='b>c", ["ac"]), ("a < b <p>c", ["a < b", "c"]),
    ("<p>a<script>if (a</b) '</p>'</script >b</p>c", ["ab", "c"]), ("<ul><li>a<b>b<li>c</ul>d", ["ab", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<!-- <p>x --><p>y<!-- z", ["y"])])
def test_blocks_of_odd_markup(source, want):
    blocks, now = [], []
    for s in [*mainhtml.Page(source).segments, None]:
        if s is not None:
            now.append(s[1])
        elif "".join(now).strip():
            blocks.append(" ".join("".join(now).split()))
            now = []
    assert blocks == want


def test_marginals_are_exact():
    rng = np.random.default_rng(8)
    lengths = np.array([1, 5, 0, 7])
    scores, trans = rng.normal(0, 2, 13), np.array([[2.0, 0.3], [0.5, 1.4]])
    got, at = toxicity.marginals(scores, lengths, trans), 0
    for n in lengths:
        weight = np.zeros((n, 1 if n == 0 else n))
        total, one = 0.0, np.zeros(n)
        for state in range(1 << n):
            y = [state >> i & 1 for i in range(n)]
            w = np.exp(sum(scores[at + i] for i in range(n) if y[i])) * np.prod([trans[a, b] for a, b in zip(y, y[1:])])
            total, one = total + w, one + w * np.array(y)
        assert np.allclose(got[at:at + n], one / total if n else one)
        at += n


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id").union(documents(spark).select(docs.columns))
    got = toxicity.judged(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) > 3900 and all(0 <= r.score <= 1 for r in rows.values())
    fold = [(rows[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in fold)
    hit = sum(r.predicted == 1 for r, t in fold if t == 1)
    assert hit >= 0.85 * sum(t == 1 for _, t in fold)
    assert sum(r.predicted == 1 for r, t in fold if t == 0) <= 0.02 * len(fold)
    spanned = next(r for r in rows.values() if r.spans)
    text = docs.where(F.col("doc_id") == spanned.doc_id).first().text
    assert all(text[s.start:s.stop].strip() for s in spanned.spans)
    assert rows[4].predicted == 0
    assert toxicity.judged(empty(spark), labels.where("false")).count() == 0


def test_html(spark):
    import html
    import re

    def plain(h):
        body = h[h.index("<article>") + 9:h.rindex("</article>")]
        blocks = (re.sub(r"<[^>]*>", lambda m: " " if m[0][:3] == "<br" else "", b) for b in re.split(r"</?(?:p|h1)>", body))
        return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = mainhtml.fit(mainhtml.sample(pages))
    source = {r.page_id: r.html for r in pages.collect()}
    for r in mainhtml.extracted(pages, model).collect():
        assert r.text == plain(source[r.page_id]) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, None, "<p>a &lt; b <i>c</i>"),
                                 (4, "u", "<" * 2000 + "<p '>"), (5, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    assert [r.text for r in mainhtml.extracted(odd, model).collect()][:4] == ["", "", "", "a < b c"]
    assert mainhtml.extracted(pages.where("false"), model).count() == 0
    text = "<p>One sentence of the article. Another sentence, a little longer.</p>"
    page = (f"<body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><div class=post>{text}<h2>Sub</h2>"
            f"<table><tr><td>x<td>y</table><section class=comments>{text}</section></div><aside>{text}</aside><footer>f</footer>")
    body = "One sentence of the article. Another sentence, a little longer."
    assert mainhtml.extract(page, model) == [body, "Sub", "x", "y"]


def test_html_with_an_open_head():
    model = mainhtml.fit([])
    text = "<h1>A title</h1><p>One sentence of the article.</p><p>Another sentence, a little longer, for x.</p>"
    want = ["A title", "One sentence of the article.", "Another sentence, a little longer, for x."]
    heads = ("<head><meta charset=utf-8><title>No</title><link rel=x><script>no()</script><noscript><img src=x>No</noscript>",
             "<head><head><title>No</title><style>no</style>", "<head><template><p>No</p></template>", "<head><noscript>No", "<head>")
    for head in heads:
        for begin in ("<body>", "</head><body>", "</head>", ""):
            if begin or not head.endswith("<noscript>No"):
                for article in (f"<article>{text}</article>", f"<main>{text}</main>"):
                    assert mainhtml.extract(f"<!DOCTYPE html><html>{head}{begin}{article}</html>", model) == want, (head, begin)
    assert mainhtml.extract("<head><title>No</title>\n A sentence of text.<p>More.</p>", model) == ["A sentence of text.", "More."]
    formula = "<p>So <math><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mi>b</mi></mfrac></math> holds in the article.</p>"
    assert mainhtml.extract(f"<body><article>{formula}</article></body>", model) == ["So a=1b holds in the article."]


def test_tree_marginals_are_exact():
    model = mainhtml.Model()
    model.pair = [[0.4, -1.0], [0.2, 0.9]]
    parent, own = [-1, 0, 0, 1, 1], [0.3, -0.7, 0.2, 1.1, -0.4]
    weight = {}
    for state in range(32):
        y = [state >> i & 1 for i in range(5)]
        weight[state] = np.exp(sum(o for o, s in zip(own, y) if s) + sum(model.pair[y[parent[i]]][y[i]] for i in range(1, 5)))
    for i, odds in enumerate(model.messages(parent, own)[2]):
        one = sum(w for s, w in weight.items() if s >> i & 1)
        assert np.isclose(odds, np.log(one / (sum(weight.values()) - one)))


@pytest.mark.parametrize("text", ["", "\\", "[", "[\\", "<\\/s>", "[/TURN]", "</s>[INST] ok [/INST]", "\\[\\<\\\\", "é[TEXT]<s>"])
def test_escapes(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text
    assert not any(c in out for c in (chat.BEGIN, chat.TURN, chat.TEXT, chat.END, "</s>", "[INST]", "[/INST]"))


def test_chat(spark):
    rows = [(1, 0, "user", "[TEXT] a"), (1, 1, "assistant", "b[/TURN]"), (1, 1, "assistant", "b[/TURN]"), (2, None, None, None),
            (None, 3, "assistant", "\\"), (3, 0, "assistant", "x" * 100000)] + [(4, i, ("user", "assistant")[i % 2], f"t{i}<") for i in range(700)]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(said)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(turns), len(loss))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.formatted_chars == len(chat.marked_turns([{"role": r, "content": t} for r, t in turns]))
    assert chat.digests(chat.formatted(said.where("false"))).count() == 0


def test_templates_that_rewrite():
    def last_only(turns):  # a template that drops the texts of earlier assistant turns
        return "".join(f"<{t['role']}>" + (t["content"] if t["role"] == "user" or i == len(turns) - 1 else "") + "|" for i, t in enumerate(turns))

    assert chat.is_local(chat.marked_turns) and not chat.is_local(last_only)
    r = chat.Renderer(last_only, False)
    flags = [r.add(role, text)[4] for role, text in (("user", "hi"), ("assistant", "yes"), ("user", "so"), ("assistant", "end"))]
    assert flags == [False, False, True, False]
    a, b = chat.Renderer(chat.marked_turns, True), chat.Renderer(chat.marked_turns, False)
    for turn in (("user", "q[["), ("assistant", "[/"), ("assistant", ""), ("user", "z")):
        assert a.add(*turn) == b.add(*turn)


def test_warc(spark, tmp_path):
    same = "<p>" + "x" * 2000
    rows = [(1, "http://a\r\nb", same), (5, None, same), (5, None, same), (3, "u", same), (6, "u", "é"), (7, "u", "é"), (8, None, None),
            (None, "u", same)]
    rng = random.Random(9)
    rows += [(100 + i, "u", "".join(rng.choice("ab\r\n ") for _ in range(3000))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    body = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r.payload_bytes == len(body[r.page_id]) and r.payload_digest == hashlib.sha1(body[r.page_id]).hexdigest()
        revisit = r.page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == body[r.page_id]
    members = warc.normalised(warc.monolithic(warc.decided(pages)))
    done = warc.export(members, str(tmp_path / "out")).collect()
    assert sum(d.records for d in done) == len(rows)
    for d in done:
        data = (tmp_path / "out" / f"{d.archive}.warc.gz").read_bytes()
        for line in (tmp_path / "out" / f"{d.archive}.cdx").read_text().splitlines():
            name, kind, offset, length = line.split(" ")
            head, _, _ = warc.parse(gzip.decompress(data[int(offset):int(offset) + int(length)]))
            assert head["warc-record-id"] == name and head["warc-type"] == kind
    os.makedirs(tmp_path / "in")
    whole = b"".join(warc.record(i, "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None, False) for i in range(50))
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(whole))
    back = warc.read_back(warc.normalised(warc.from_files(spark, str(tmp_path / "in")))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in back) == [(i, i) for i in range(50)]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_stages_keep_columns_with_odd_names(spark):
    names = ("ledger", "__key", "__id", "bad_text", "judged_id", "judged_text", "row", "kept", "shard", "key")
    text = " ".join(f"word{i}" for i in range(40))
    docs = documents(spark, [(i, f"{text} {i % 3} {i % 3} end", "en", "a", 1) for i in range(6)]).withColumns(
        {c: F.lit(f"own {c}") for c in names})
    out = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, SMALL)
        assert out.columns == docs.columns
        assert all({r[0] for r in out.select(c).distinct().collect()} == {f"own {c}"} for c in names)
    last = corpus_pipeline.STAGES[4][1](spark, out, SMALL)
    assert last.count() == out.count() > 0 and last.select("ledger").distinct().first()[0] == "own ledger"


def test_toxicity_without_words_to_learn_from():
    tagger = toxicity.fit(["", "", " "], [0, 1, 0])
    assert tagger.tag(["", "some words"])[1] == pytest.approx([1 / 3, 1 / 3], abs=0.05)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows, stages = [r.asDict() for r in docs.collect()], corpus_pipeline.STAGES
    out = stages[0][1](spark, docs, SMALL)
    n = [(r, measured(r["text"])) for r in rows]
    rows = [r for r, (w, chars, sym, dup, rep) in n if w >= 10 and 100 * rep <= 20 * w and 4 * noise(r["text"]) <= w
            and 2 * dup <= len([x for x in (r["text"] or "").split("\n") if WORD.search(x)]) and 2 * w <= chars <= 30 * w]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r["doc_id"] for r in rows)
    out = stages[1][1](spark, out, SMALL)
    rows.sort(key=lambda r: r["doc_id"])
    roots = set(duplicates([r["text"] for r in rows]))
    rows = [r for i, r in enumerate(rows) if i in roots]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r["doc_id"] for r in rows)
    out = stages[2][1](spark, out, SMALL)

    def clean(text):
        words, hit, _ = items_in(text, items)
        return not (hit and 20 * hit >= words)

    rows = [r for r in rows if clean(r["text"])]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r["doc_id"] for r in rows)
    out = stages[3][1](spark, out, SMALL)
    assert out.columns == docs.columns
    final = stages[4][1](spark, out, SMALL)
    assert set(docs.columns) < set(final.columns)
    key = ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, final.select(key).collect())) == sorted(map(tuple, out.select(key).collect()))
    sizes = Counter(r.shard for r in final.select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert [k for k, _ in stages] and all(f(spark, docs.where("false"), SMALL).count() == 0 for _, f in stages)
