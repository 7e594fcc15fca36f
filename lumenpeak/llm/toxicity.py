"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so tokens of the sample are labelled first: a token of a
toxic document is toxic if its word, or its beginning, is found in toxic documents
far more often than in others.  The chain has two states; a word's own score is the
sum of the weights of its features (the word, its first 3 to 7 characters), and the
transitions make spans.  Weights maximise the conditional likelihood of the sample's
segments; forward-backward gives each token's marginal.

A document's score is a logistic function of its marginals (their largest, their sum
and their share), fitted on the same sample.  Only the text is ever read by a score.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpeak.functions.shared import written
from lumenpeak.llm.common import TERM, UPPER

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

# The sample to fit on: documents of each label, in the order of a hash of their ids,
# among those of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
# A feature marks tokens as toxic from so many toxic documents and this log ratio.
MIN_DOCS, MIN_RATIO = 5, 2.5
PREFIXES = range(3, 8)
SEGMENT, EPOCHS, RATE, RIDGE = 40, 60, 0.15, 2e-4
WORDS = re.compile(TERM)
LOWER = str.maketrans(UPPER, UPPER.lower())
SCHEMA = "doc_id {kind}, score double, spans array<struct<start:bigint,stop:bigint>>"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER))


def features(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in PREFIXES if k <= len(word)]]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> pd.DataFrame:
    """text, toxic of the bounded sample; nothing of the held-out fold is in it.

    An id that is labelled twice counts as toxic if one label says so.
    """
    each = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lot = F.xxhash64("doc_id")
    picked = [each.where(F.col("toxic") == k).orderBy(lot, "doc_id").limit(most) for k in (0, 1)]
    ids = written(picked[0].union(picked[1]), "toxic-sample")  # at most 2 * most rows
    read = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    rows = read.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(2 * most)
    return rows.select("text", "toxic").toPandas()


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state 1) of every token of many sequences that lie end to end in ``scores``.

    ``trans`` is the 2 x 2 table of transition factors.  All sequences advance
    together, the longest first, so the running ones are always a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    factor = np.exp(np.clip(scores, -30, 30))
    (t00, t01), (t10, t11) = trans
    forward, out = np.empty(len(scores)), np.empty(len(scores))
    running = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    p = np.full(len(size), 0.5)
    for t, n in enumerate(running):  # p: P(state 1 | words so far)
        at, q = begin[:n] + t, p[:n]
        if t:
            one, zero = (t01 + q * (t11 - t01)), (t00 + q * (t10 - t00))
        else:
            one = zero = 0.5
        one = one * factor[at]
        p[:n] = forward[at] = one / (one + zero)
    b1 = np.ones(len(size))  # backward factor of state 1 over that of state 0
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = begin[:n] + t
        odds = forward[at] * b1[:n]
        out[at] = odds / (odds + 1 - forward[at])
        e = factor[at] * b1[:n]
        b1[:n] = (t10 + t11 * e) / (t00 + t01 * e)
    return out


class Tagger:
    """Weights of the field and of the document score."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, final: np.ndarray):
        self.weights, self.bias, self.trans, self.final = weights, bias, trans, final
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        s = self.known.get(w)
        if s is None:
            if len(self.known) > 500_000:  # of a worker; words come back in as they are met
                self.known.clear()
            s = self.known[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
        return s

    def tag(self, texts: Sequence[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Marginals of every text's words, and the document scores."""
        known, scores, lengths = self.known, [], []
        for text in texts:
            ws = words_of(text)
            lengths.append(len(ws))
            scores.append(np.array([known[w] if w in known else self.word(w) for w in ws], np.float64))
        lengths = np.array(lengths, np.int64)
        flat = marginals(np.concatenate([*scores, np.empty(0)]), lengths, self.trans)
        parts = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
        return parts, 1 / (1 + np.exp(-(self.summary(parts) @ self.final)))

    @staticmethod
    def summary(parts: list[np.ndarray]) -> np.ndarray:
        rows = [(1.0, p.max(), math.log1p(p.sum()), math.sqrt(p.mean())) if len(p) else (1.0, 0.0, 0.0, 0.0)
                for p in parts]
        return np.array(rows, np.float64).reshape(-1, 4)


def fit(texts: Sequence[str], toxic: Sequence[int], seed: int = 1) -> Tagger:
    """Fit on labelled texts; without texts of both labels every score is low."""
    toxic = np.array(toxic, np.int64)
    docs = [words_of(t) for t in texts]
    seen = [Counter(), Counter()]
    for words, y in zip(docs, toxic):
        seen[y].update({f for w in set(words) for f in features(w)})
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    if not n0 or not n1:
        return Tagger({}, -5.0, np.ones((2, 2)), np.array([-5.0, 0, 0, 0]))

    def ratio(f: str) -> float:
        return math.log((seen[1][f] + 0.5) / (n1 + 1)) - math.log((seen[0][f] + 0.5) / (n0 + 1))

    marks = {f for f, n in seen[1].items() if n >= MIN_DOCS and ratio(f) >= MIN_RATIO}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    marked = np.array([any(f in marks for f in features(w)) for w in vocabulary] or [False])
    names = {f: i for i, f in enumerate(f for f in set(seen[0]) | set(seen[1]) if seen[0][f] + seen[1][f] >= 3)}
    pairs = [(i, names[f]) for w, i in vocabulary.items() for f in features(w) if f in names]
    of_word, of_feature = np.array(pairs, np.int64).reshape(-1, 2).T
    rng = np.random.default_rng(seed)
    segments, tags = [], []
    for words, y in zip(docs, toxic):
        ids = np.array([vocabulary[w] for w in words], np.int64)
        if not len(ids):
            continue
        here = np.flatnonzero(marked[ids]) if y else np.empty(0, np.int64)
        starts = np.unique(here[:: max(1, len(here) // 4)] - SEGMENT // 2) if y else rng.integers(0, max(1, len(ids) - SEGMENT), 2)
        for s in np.maximum(starts, 0).tolist():
            piece = ids[s:s + SEGMENT]
            segments.append(piece)
            tags.append(marked[piece].astype(float) if y else np.zeros(len(piece)))
    if not segments:  # labelled texts without words: the share of toxic ones is all there is to learn
        return Tagger({}, -5.0, np.ones((2, 2)), _logistic(np.tile([1.0, 0, 0, 0], (len(toxic), 1)), toxic))
    lengths = np.array([len(s) for s in segments], np.int64)
    ids, y = np.concatenate(segments), np.concatenate(tags)
    inner = np.ones(len(ids), bool)  # tokens with a token before them in their segment
    inner[np.cumsum(lengths) - lengths] = False
    prev = np.flatnonzero(inner) - 1
    w, bias, trans = np.zeros(len(names)), -2.0, np.zeros((2, 2))
    m, v = np.zeros(len(names) + 5), np.zeros(len(names) + 5)
    for step in range(1, EPOCHS + 1):
        per_word = np.bincount(of_word, w[of_feature], len(vocabulary)) + bias
        scores = per_word[ids]
        table = np.exp(trans)
        p = marginals(scores, lengths, table)
        both = _pairs(scores, lengths, table, p, prev)
        token = (y - p) / len(ids)
        by_word = np.bincount(ids, token, len(vocabulary))
        seen_pairs = np.array([[((1 - y[prev]) * (1 - y[prev + 1])).sum(), ((1 - y[prev]) * y[prev + 1]).sum()],
                               [(y[prev] * (1 - y[prev + 1])).sum(), (y[prev] * y[prev + 1]).sum()]])
        grad = np.concatenate([np.bincount(of_feature, by_word[of_word], len(names)) - RIDGE * w / 10,
                               [by_word.sum()], ((seen_pairs - both) / len(ids)).ravel() - RIDGE * trans.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, bias, trans = w + move[:-5], bias + move[-5], trans + move[-4:].reshape(2, 2)
    weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 0.02}
    tagger = Tagger(weights, float(bias), np.exp(trans), np.zeros(4))
    x = np.concatenate([tagger.summary(tagger.tag(list(texts[i:i + 500]))[0]) for i in range(0, len(texts), 500)])
    tagger.final = _logistic(x, toxic)
    return tagger


def _pairs(scores, lengths, trans, p, prev) -> np.ndarray:
    """Expected counts of the four transitions: P(next | this) follows from the
    marginals and the backward factors, which the marginals and the forward pass give."""
    factor = np.exp(np.clip(scores, -30, 30))
    first = np.cumsum(lengths) - lengths
    forward = np.empty(len(scores))
    width = int(lengths.max())
    q = np.full(len(lengths), 0.5)
    for t in range(width):
        live = lengths > t
        at = first[live] + t
        one, zero = ((trans[0, 1] + q[live] * (trans[1, 1] - trans[0, 1])), (trans[0, 0] + q[live] * (
            trans[1, 0] - trans[0, 0]))) if t else (0.5, 0.5)
        one = one * factor[at]
        q[live] = forward[at] = one / (one + zero)
    a = forward[prev]
    nxt = prev + 1
    # backward odds of the next token times its factor: from its marginal and prediction
    one, zero = (1 - a) * trans[0, 1] + a * trans[1, 1], (1 - a) * trans[0, 0] + a * trans[1, 0]
    lift1, lift0 = p[nxt] / one, (1 - p[nxt]) / zero
    return np.array([[((1 - a) * trans[0, 0] * lift0).sum(), ((1 - a) * trans[0, 1] * lift1).sum()],
                     [(a * trans[1, 0] * lift0).sum(), (a * trans[1, 1] * lift1).sum()]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method; labels of the rarer kind weigh as they are."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def scored(docs: DataFrame, tagger: Tagger, spans: bool = True) -> DataFrame:
    """doc_id, score and the offending spans (character offsets) of every row.

    NULL and empty texts have no words; their score is that of a text without any
    toxic word.  Repeated rows get equal scores.
    """
    kind = dict(docs.dtypes)["doc_id"]
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def spans_of(text: str | None, p: np.ndarray) -> list[dict]:
        if not spans or not len(p) or p.max() < 0.5:
            return []
        out: list[dict] = []
        for i, m in enumerate(WORDS.finditer(text.translate(LOWER))):
            if p[i] >= 0.5:
                if out and last == i - 1:
                    out[-1]["stop"] = m.end()
                else:
                    out.append({"start": m.start(), "stop": m.end()})
                last = i
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            parts, scores = tagger.tag(texts)
            found = [spans_of(t, p) for t, p in zip(texts, parts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(found, pairs)],
                                             ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA.format(kind=kind))


def judged(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of ``docs``."""
    picked = sample(docs, labels)
    tagger = fit(picked["text"].tolist(), picked["toxic"].tolist())
    return scored(docs, tagger).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"), "spans")
