"""Chat formatting by incremental rendering of a template that is a black box.

A template is a function from a list of {role, content} to text.  Rendering the
first k and the first k - 1 turns and comparing both outputs tells where turn k
stands; where the longer output does not start with the shorter one the template
has rewritten its history.  What surrounds a turn's own text is found by rendering
the turn with two different texts.

Turns stream through a task in order, and a template that proves local (a turn's
piece depends on the turn before at most; ``is_local`` tries it) is rendered over
the last turns only, so neither time nor memory grows with the square of a
conversation.  Other templates get all turns so far.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package

Template = Callable[[list[dict]], str]
BATCH = 4 << 20
BEGIN, TURN, TEXT, END = "<s>", "[TURN]", "[TEXT]", "[/TURN]"
PIECES = ("conv_id bigint, seq bigint, piece string, start bigint, loss_start bigint, loss_stop bigint, "
          "rewrites boolean")
DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint")


def escaped(text: str) -> str:
    """No control string survives: each starts with [ or <, which gets a \\ behind it."""
    return text.replace("\\", "\\\\").replace("[", "[\\").replace("<", "<\\")


def unescaped(text: str) -> str:
    return re.sub(r"(\\|\[|<)\\", r"\1", text)


def marked_turns(turns: list[dict]) -> str:
    """The built-in template."""
    return BEGIN + "".join(f"{TURN}{escaped(t['role'])}{TEXT}{escaped(t['content'])}{END}" for t in turns)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn that ``marked_turns`` wrote."""
    for part in text.removeprefix(BEGIN).split(END)[:-1]:
        role, _, content = part.removeprefix(TURN).partition(TEXT)
        yield unescaped(role), unescaped(content)


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def is_local(template: Template) -> bool:
    """Whether a turn's piece is the same behind the turn before it as behind all
    turns, tried on conversations of all short orders of roles."""
    import itertools

    def piece(turns: list[dict], k: int) -> str | None:
        before, after = template(turns[:k]), template(turns[:k + 1])
        return after[len(before):] if after.startswith(before) else None

    for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=4):
        turns = [{"role": r, "content": f"text {i} of {r}\n"} for i, r in enumerate(roles)]
        for k in range(1, 4):
            whole = piece(turns, k)
            if whole is None or whole != piece(turns[k - 1:k + 1], 1):
                return False
    return True


class Renderer:
    """Takes turns one by one and says what each adds to the output."""

    def __init__(self, template: Template, local: bool):
        self.template, self.local = template, local
        self.turns: list[dict] = []
        self.before, self.length, self.frames = template([]), 0, {}

    def _frame(self, role: str) -> tuple[int, int]:
        """Characters around the text in a piece of this role, at this place."""
        key = (role, self.turns[-1]["role"] if self.turns else None)
        if not self.local or key not in self.frames:
            a, b = (self.template([*self.turns, {"role": role, "content": c}]) for c in ("a", "b"))
            head = common(a, b)
            self.frames[key] = (head - common(self.before, a), common(a[::-1], b[::-1]))
        return self.frames[key]

    def add(self, role: str, content: str) -> tuple[str, int, int, int, bool]:
        """(piece, its start, start and stop of the text in the output, rewrites)."""
        head, tail = self._frame(role)
        after = self.template([*self.turns, {"role": role, "content": content}])
        same = common(self.before, after)
        rewrites = same < len(self.before)
        first = self.length == 0 and not self.turns
        piece = after if first else after[same:]
        start = 0 if first else self.length - (len(self.before) - same)
        lead = head + (same if first else 0)
        span = (start + lead, start + len(piece) - tail)
        self.length = start + len(piece)
        self.turns.append({"role": role, "content": content})
        self.before = after
        if self.local:  # the next piece needs this turn alone
            self.turns = self.turns[-1:]
            self.before = self.template(self.turns)
        return piece, start, *span, rewrites


def _emit(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def formatted(conversations: DataFrame, template: Template = marked_turns, learn: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, seq, piece, start, loss_start, loss_stop, rewrites.

    ``start`` is where the piece stands in the conversation's output; the loss span
    covers the text of ``learn`` turns and is NULL on others.  Rows are ordered by
    turn, equal turns by role and text.  NULL roles and texts are empty; rows without
    conv_id are one conversation.  Output partitions hold whole conversations in order.
    """
    local = is_local(template)
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("start", pa.int64()),
                        ("loss_start", pa.int64()), ("loss_stop", pa.int64()), ("rewrites", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, state, seq = object(), None, 0
            for b in batches:
                for c, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                    if c != conv:
                        conv, state, seq = c, Renderer(template, local), 0
                    piece, start, a, z, rewrites = state.add(role, text)
                    learned = role == learn
                    yield c, seq, piece, start, a if learned else None, z if learned else None, rewrites
                    seq += 1

        yield from _emit(rows(), schema, lambda r: len(r[2]) + 64)

    none = F.lit("")
    return conversations.select("conv_id", "turn", F.coalesce("role", none).alias("role"),
                                F.coalesce("text", none).alias("text")).repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text").mapInArrow(work, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from the output of ``formatted`` with the built-in
    template, per conversation; hashed piece by piece as they stream by."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv = state = None
            for b in batches:
                names = ("conv_id", "piece", "start", "loss_start", "loss_stop")
                for c, piece, start, a, z in zip(*(b.column(n).to_pylist() for n in names)):
                    if state is None or c != conv:
                        if state is not None:
                            yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                        conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text in read_turns(piece):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if a is not None:
                        under = unescaped(piece[a - start:z - start])
                        state[2] += len(under)
                        state[3].update(under.encode("utf-8", "surrogatepass"))
                    state[4] = start + len(piece)
            if state is not None:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _emit(rows(), schema, lambda r: 300)

    return pieces.mapInArrow(work, DIGESTS)
