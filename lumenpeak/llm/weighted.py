"""Document fingerprints by consistent weighted sampling.

The terms of a document are its words in lower case (ASCII); a term weighs its number
of occurrences times its length in bytes.  For each of ``SAMPLES`` samples a term gets two
gamma variates and a uniform one that depend on the term alone; they round its weight
down to a step on its own logarithmic scale and give it an arrival time.  The sample
is the term that arrives first, with its step.  Two documents draw the same
sample with a probability equal to the generalised Jaccard similarity of their weights:
the sum of the lesser weights over the sum of the greater ones.

A fingerprint holds 16 bits of each sample, so samples that differ agree by chance once
in 65,536 times.  It depends on the text only, not on the rest of the corpus.

Words of more than ``LONGEST`` characters, as scripts without spaces have them, count by
their runs of ``GRAM`` characters.
"""

from __future__ import annotations

import bisect
import hashlib
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

SAMPLES, SEED = 64, 12
LONGEST, GRAM = 24, 4
BLOCK = 512  # terms that are worked on at once
PIECE, PIECES = 1 << 23, 100_000  # characters of a piece of the id order, and most pieces
BATCH_BYTES = 1 << 23


def weighted_terms(text: str) -> Counter:
    """Occurrences of each term of a text, terms as UTF-8."""
    counts = Counter(text.encode("utf-8", "surrogatepass").lower().split())
    for word in [w for w in counts if len(w) > LONGEST]:
        chars = word.decode("utf-8", "surrogatepass")
        if len(chars) > LONGEST:
            n = counts.pop(word)
            for i in range(len(chars) - GRAM + 1):
                counts[chars[i:i + GRAM].encode("utf-8", "surrogatepass")] += n
    return counts


def weight(term: bytes, count: int) -> int:
    return count * len(term)


def gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Where the gamma distribution of shape 2 and scale 1 reaches the probabilities p."""
    low, high = np.full(len(p), -50.0), np.full(len(p), 5.0)  # logarithms
    for _ in range(60):
        mid = (low + high) / 2
        x = np.exp(mid)
        # 1 - (1 + x) exp(-x) loses all digits at small x, where x^2 / 2 - x^3 / 3 holds
        below = np.where(x < 1e-3, x * x / 2 - x ** 3 / 3, -np.expm1(-x) - x * np.exp(-x)) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.exp(high)


# Bits of a random number in float32 that pick an entry: exponent and ten digits, so that
# the lower tail, where the first arrivals lie, is as fine as the rest.
DIGITS, LEAST = 13, 94 << 10


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sampler:
    """Draws fingerprints.  A term and a sample give one 64-bit hash: 32 bits pick the
    gamma variate of the arrival, 16 that of the step, 16 are the uniform variate."""

    def __init__(self, samples: int = SAMPLES):
        self.samples, self.every = samples, np.arange(samples)
        self.steps = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.r = gamma_quantiles((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        picked = ((np.arange(LEAST, (127 << 10) + 1, dtype=np.uint32) << np.uint32(DIGITS))
                  + np.uint32(1 << (DIGITS - 1))).view(np.float32).astype(float)
        self.log_c = np.log(gamma_quantiles(np.minimum(picked, 1 - 2.0 ** -12))).astype(np.float32)

    def arrivals(self, seeds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logarithms of arrival times, steps) per term and sample."""
        h = _mixed(seeds[:, None] + self.steps)
        u = ((h >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -32)
        log_c = self.log_c.take((u.view(np.uint32) >> np.uint32(DIGITS)) - np.uint32(LEAST))
        low = h.astype(np.uint32)
        r = self.r.take(low >> np.uint32(16))
        beta = (low & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2.0 ** -16)
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + beta)
        return log_c - r * (t - beta + 1), t

    def draw(self, *texts: str) -> list[np.ndarray]:
        """Codes of the samples of each text; all zero without terms.  The order of terms
        does not matter; what texts share is worked out once."""
        held = [weighted_terms(t) for t in texts]
        best = [np.full(self.samples, np.inf, np.float32) for _ in texts]
        codes = [np.zeros(self.samples, np.uint16) for _ in texts]
        keys = list(dict.fromkeys(k for counts in held for k in counts.items()))
        for at in range(0, len(keys), BLOCK):
            part = keys[at:at + BLOCK]
            seeds = np.array([xxhash.xxh64_intdigest(t, SEED) for t, _ in part], np.uint64)
            arrival, t = self.arrivals(seeds, np.array([weight(*k) for k in part]))
            for i, counts in enumerate(held):
                rows = np.flatnonzero([counts.get(w) == n for w, n in part])
                if not len(rows):
                    continue
                mine = arrival if len(rows) == len(part) else arrival[rows]
                first = mine.argmin(axis=0)
                least = mine[first, self.every]
                sooner = np.flatnonzero(least < best[i])
                first = rows[first[sooner]]
                best[i][sooner] = least[sooner]
                drawn = seeds[first] ^ _mixed(t[first, sooner].astype(np.int64).view(np.uint64) + self.steps[sooner])
                codes[i][sooner] = (_mixed(drawn) >> np.uint64(48)).astype(np.uint16)
        return codes


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def shown(codes: np.ndarray) -> str:
    return codes.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _order(doc_id, mark: int) -> tuple:
    return (doc_id is not None, doc_id, mark) if doc_id is not None else (False, 0, mark)


def _pieces(docs: DataFrame) -> list[tuple]:
    """First (doc_id, mark) of each piece of the id order; pieces are of like size."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, min(-(-chars // PIECE), PIECES))
    firsts = keys.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("mark")).groupBy(
        F.spark_partition_id().alias("p")).agg(F.min_by(
            F.struct("doc_id", "mark"),
            F.struct(F.col("doc_id").isNotNull(), "doc_id", "mark")).alias("f")).collect()
    return sorted(((r.f.doc_id, r.f.mark) for r in firsts), key=lambda k: _order(*k))


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by rising doc_id (NULL first; rows of one id by a
    hash of their text), after the last the first; a single row follows itself.  NULL
    texts are empty; texts without words have a fingerprint of zeros, which is like
    that of any other such text.  An empty table gives no rows.

    Texts travel once, compressed, into pieces of the id order, where rows stream by in
    order: a task holds two texts.  The first row of a piece is also sent to the end of
    the piece before.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = _pieces(texts)
    order = [_order(*k) for k in starts]
    kind = dict(docs.dtypes)["doc_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["piece", "guest", "doc_id", "mark", "body"]
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, mark in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "mark"))):
                key = _order(doc_id, mark)
                piece = max(bisect.bisect_right(order, key) - 1, 0)
                body = zlib.compress(text.encode("utf-8", "surrogatepass"), 1)
                rows.append((piece, False, doc_id, mark, body))
                if key == order[piece]:
                    rows.append(((piece - 1) % len(order), True, doc_id, mark, body))
                held += len(body)
                if held > BATCH_BYTES:
                    yield table(rows, names, batch)
                    rows, held = [], 0
            if rows:
                yield table(rows, names, batch)

    def table(rows: list[tuple], names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.bool_(), batch.schema.field("doc_id").type, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        before = None  # piece, doc_id and text of the row before
        waiting = None  # result and codes of the row before that
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("piece", "guest", "doc_id", "body"))
            for piece, guest, doc_id, body in zip(*columns):
                if guest and before is None:  # the guests of a piece are equal rows
                    continue
                text = zlib.decompress(body).decode("utf-8", "surrogatepass")
                if before is not None:
                    _, last, said = before
                    changed = edited(said, text)
                    own, other = sampler.draw(said, changed)
                    if waiting is not None:
                        out.append((*waiting[0], likeness(waiting[1], own)))
                    waiting = ((last, len(said), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                shown(own), shown(other), likeness(own, other)), own)
                before = (piece, doc_id, text)
                if guest:
                    out.append((*waiting[0], likeness(waiting[1], *sampler.draw(text))))
                    before = waiting = None
            if out:
                kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    read = texts.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    dealt = read.mapInArrow(packed, f"piece int, guest boolean, doc_id {kind}, mark bigint, body binary")
    return dealt.repartition("piece").sortWithinPartitions(
        "piece", "guest", F.asc_nulls_first("doc_id"), "mark").mapInArrow(
        judged, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                "edited_fingerprint string, near_edited double, near_next double")
