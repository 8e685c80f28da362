r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only that reply is
trainable. An example is one row, or several ordered parts (``part``) where its context is longer than ``row_chars``;
every part holds whole turns, and the last one ends with the reply and has its span (``loss_start``, ``loss_end``).

Template: ``### role: text</turn>`` and a line feed a turn. Inside texts and roles every backslash, ``#`` and ``<`` gets
a backslash before it, inside roles also a colon and a line feed; so no text can hold ``###`` or ``</turn>``.

Examples repeat their context, so the output grows with the square of a conversation's turns; a task holds one
conversation's formatted text and one part at a time.

Defined cases: a null text or role is empty; turns go by number, nulls first, ties by role, then text; repeated rows
are turns of their own; turns after the last reply (or of a conversation without one) form rows of their own without a
trainable span, so that nothing is lost; rows with a null id are one conversation, and ids may be of any type that
sorts; a text of any length is one turn; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, small

TRAINED_ROLE = "assistant"
END = "</turn>"
_CONTROL = re.compile(r"[\\#<]")
_ROLE_CONTROL = re.compile(r"[\\#<:\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:\n]+|\\.)*): ((?:[^\\#<]+|\\.)*)</turn>\n", re.DOTALL)
#: Characters that one batch of examples holds, about.
_BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return _ROLE_CONTROL.sub(r"\\\g<0>", role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the escaped text's span of each turn of a formatted text from ``at`` on."""
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


_NAMES = ["conv_id", "example", "is_example", "part", "n_parts", "text", "loss_start", "loss_end"]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def expand(conversations: DataFrame, row_chars: int = 1_000_000) -> DataFrame:
    """Rows of examples, sorted by (conv_id, example, part) within partitions; one shuffle, of the turns.

    ``example`` counts from 0 within a conversation; what follows its last reply has the next number.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, id_type = object(), None  # equal to no id
        closed: list[str] = []  # parts of the context that are long enough
        open_: list[str] = []
        tail: list[str] = []
        example = size = held = 0
        rows: list[tuple] = []

        def put(is_example: bool, parts: list[str], loss: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, example
            for k, text in enumerate(parts):
                rows.append((conv, example, is_example, k, len(parts), text, *(loss if k + 1 == len(parts) else (0, 0))))
                held += len(text)
                if held > _BATCH_CHARS:
                    yield _record(rows, id_type)
                    rows, held = [], 0
            example += 1

        def finish() -> Iterator[pa.RecordBatch]:
            if tail:
                parts, lo, n = [], 0, 0
                for k, turn in enumerate(tail):
                    n += len(turn)
                    if n > row_chars or k + 1 == len(tail):
                        parts.append("".join(tail[lo : k + 1]))
                        lo, n = k + 1, 0
                yield from put(False, parts, (0, 0))

        for batch in small(batches):
            id_type = batch.schema.field(0).type
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != conv:
                    yield from finish()
                    conv, closed, open_, tail, example, size = c, [], [], [], 0, 0
                head, body = f"### {escape_role(role or '')}: ", escape(text or "")
                turn = f"{head}{body}{END}\n"
                open_.append(turn)
                if role == TRAINED_ROLE:
                    start = size + len(head)
                    yield from put(True, [*closed, "".join(open_)], (start, start + len(body)))
                    tail = []
                else:
                    tail.append(turn)
                size += len(turn)
                if size > row_chars:
                    closed.append("".join(open_))
                    open_, size = [], 0
            if rows:
                yield _record(rows, id_type)
                rows, held = [], 0
        yield from finish()
        if rows:
            yield _record(rows, id_type)

    cols = conversations.select("conv_id", "role", "text", F.col("turn").alias("__turn"))
    dealt = cols.repartition(shuffle_partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "__turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, example long, is_example boolean, part long, n_parts long, text string, loss_start long, loss_end long")


def _record(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, *_KINDS], strict=True)], _NAMES)


def read_back(rows: DataFrame, in_order: bool = False) -> DataFrame:
    """What the rows of expand() hold, one row a conversation; formatted_chars counts every row's text.

    Each example must begin with the whole of the one before it, so that its context is all preceding turns; the turns
    beyond that are parsed. Rows that were written and read again are sorted first; ``in_order`` takes them as
    expand() gives them, without a shuffle.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    cols = rows.select(*_NAMES)
    if not in_order:
        cols = cols.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "example", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, last = object(), None, pa.int64()
        before: list[str] = []  # parts of the example before
        now: list[str] = []

        def closed() -> list[tuple]:
            return [] if state is None else [(conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])]

        for batch in small(batches):
            done, last = [], batch.schema.field(0).type
            for c, example, is_example, part, n_parts, text, start, end in zip(*(batch.column(k).to_pylist() for k in _NAMES), strict=True):
                if state is None or c != conv:
                    done += closed()
                    conv, state, before, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], [], []
                if part != len(now):
                    raise ValueError(f"example {example}: part {part} isn't where it belongs")
                known = before[part] if is_example and part < len(before) else ""
                if not text.startswith(known) or is_example and part + 1 < len(before) and text != known or is_example and n_parts < len(before):
                    raise ValueError(f"example {example} doesn't begin with the one before")
                for role, content, _, _ in parse(text, len(known)):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                state[4] += len(text)
                now.append(text)
                if part + 1 == n_parts:
                    if is_example:
                        loss = unescape(text[start:end])
                        state[2] += len(loss)
                        state[3].update(loss.encode())
                        state[5] += 1
                        before = now
                    now = []
            if done:
                yield _digests(done, last, names)
        if state is not None:
            yield _digests(closed(), last, names)

    return cols.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def _digests(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
