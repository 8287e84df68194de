"""Chat formatting by token-level assembly.

A turn is written as `### role: text</turn>` and a line feed. The three control
strings around role and text are reserved ids (behind the vocabulary's), and role
and text are encoded by themselves, so nothing a user writes becomes a control
token. Control strings inside a text, and backslashes, get a backslash in front,
which reading back takes away. The loss mask follows from the prefix sums of the
segment lengths: it covers the text ids of assistant turns, nothing else.

Turns are encoded one by one where they lie; only then a conversation's turns meet.
`format_turns` keeps them as rows, sorted within a conversation, with running offsets, and
`read_back` streams them, so no conversation is held whole, however long it is.
`format_conversations` assembles each as one row, for conversations that fit in a row (2 GB).
The turns of one conversation, or of the null id, pass through one task one after another.

Defined cases: a null text or role is empty; null turns come first, rows of one turn
are ordered by role, then ids; a null conversation id is a conversation of its own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import bounded, in_slices, ref, texts
from .tokens import byte_bpe, vocabulary

START, SEPARATOR, END = "### ", ": ", "</turn>\n"
_IN_TEXT = re.compile(r"(\\|</turn>|###)")
_IN_ROLE = re.compile(r"(\\|</turn>|###|: )")
_BACK = re.compile(r"\\(\\|</turn>|###|: )")
SCHEMA = "conv_id long, n_turns long, ids binary, loss_start array<long>, loss_end array<long>"
TURNS = "conv_id long, seq long, offset long, ids binary, loss_start array<long>, loss_end array<long>"


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _encode_turns(path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = byte_bpe(path)
        roles = [t.decode("utf-8") for t in texts(batch.column("role"))]
        out = []
        for column, values in (("role_ids", [escape(r, role=True) for r in roles]),
                               ("text_ids", [escape(t.decode("utf-8")) for t in texts(batch.column("text"))])):
            ids, counts = bpe.encode(values)
            out.append(pa.array([x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])],
                                pa.binary()))
        return pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(roles), *out],
            ["conv_id", "turn", "role", "role_ids", "text_ids"])
    return run


def _assemble(size: int):
    start, separator, end = (np.array([size + i], "<u4") for i in range(3))

    def run(batches):
        for batch in batches:
            n_turns, all_ids, starts, ends = [], [], [], []
            for turns in batch.column("turns").to_pylist():
                segments, loss = [], []
                for t in turns:
                    segments += [start, np.frombuffer(t["role_ids"], "<u4"), separator,
                                 np.frombuffer(t["text_ids"], "<u4"), end]
                    loss += [False, False, False, t["role"] == "assistant", False]
                stop = np.cumsum([len(s) for s in segments])  # prefix sums: where each segment ends
                on = np.flatnonzero(loss)
                n_turns.append(len(turns))
                all_ids.append(np.concatenate(segments).tobytes())
                ends.append(stop[on])
                starts.append(stop[on - 1])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n_turns, pa.int64()), pa.array(all_ids, pa.binary()),
                 pa.array(starts, longs), pa.array(ends, longs)],
                ["conv_id", "n_turns", "ids", "loss_start", "loss_end"])
    return run


def _encoded(conversations: DataFrame, path: str, conv_col: str, turn_col: str, role_col: str,
             text_col: str) -> DataFrame:
    rows = conversations.select(ref(conv_col).cast("long").alias("conv_id"), ref(turn_col).cast("long").alias("turn"),
                                ref(role_col).alias("role"), ref(text_col).alias("text"))
    return rows.mapInArrow(in_slices(_encode_turns(path), "text"),
                           "conv_id long, turn long, role string, role_ids binary, text_ids binary")


def _place(size: int):
    """Turns in order to TURNS rows: places count on until the next conversation."""
    start, separator, end = (np.array([size + i], "<u4").tobytes() for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seq, offset = (), 0, 0
        for batch in batches:
            for part in bounded(batch, "text_ids"):
                out = []
                for conv, role, role_ids, text_ids in zip(*[part.column(c).to_pylist() for c in (
                        "conv_id", "role", "role_ids", "text_ids")]):
                    if conv != current:
                        current, seq, offset = conv, 0, 0
                    ids = b"".join((start, role_ids, separator, text_ids, end))
                    first, last = offset + len(role_ids) // 4 + 2, offset + len(ids) // 4 - 1
                    on = role == "assistant"
                    out.append((conv, seq, offset, ids, [first] if on else [], [last] if on else []))
                    seq, offset = seq + 1, offset + len(ids) // 4
                if out:
                    conv, seqs, offsets, ids, starts, ends = zip(*out)
                    long, longs = pa.int64(), pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(conv, long), pa.array(seqs, long), pa.array(offsets, long), pa.array(ids, pa.binary()),
                         pa.array(starts, longs), pa.array(ends, longs)],
                        ["conv_id", "seq", "offset", "ids", "loss_start", "loss_end"])
    return run


def format_turns(conversations: DataFrame, path: str | None = None, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """TURNS: one row per turn, numbered in its conversation; `offset` ids stand before it there, and
    its span of the loss mask, if any, counts from the conversation's start."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    turns = _encoded(conversations, path, conv_col, turn_col, role_col, text_col)
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_ids", "role_ids")
            .mapInArrow(_place(byte_bpe(path).size), TURNS))


def format_conversations(conversations: DataFrame, path: str | None = None, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """SCHEMA: one row per conversation, ids as little-endian unsigned 32-bit, and the
    loss mask as spans of ids. `path` is a byte-level BPE rank file."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    turns = _encoded(conversations, path, conv_col, turn_col, role_col, text_col)
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text_ids", "role_ids"))).alias("turns"))
    return whole.mapInArrow(_assemble(byte_bpe(path).size), SCHEMA)


def _text_of(ids: np.ndarray, path: str) -> str:
    """Escaped text of ids, reserved ones as their control strings."""
    bpe = byte_bpe(path)
    marks = [START, SEPARATOR, END]
    out, at = [], 0
    for cut in np.flatnonzero(ids >= bpe.size).tolist():
        out += [bpe.decode(ids[at:cut]), marks[ids[cut] - bpe.size]]
        at = cut + 1
    return "".join([*out, bpe.decode(ids[at:])])


def read_turns(ids: np.ndarray, path: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, from the ids alone."""
    bpe = byte_bpe(path)
    cuts = np.flatnonzero(ids >= bpe.size).reshape(-1, 3).tolist()
    return [(unescape(bpe.decode(ids[a + 1:b])), unescape(bpe.decode(ids[b + 1:c]))) for a, b, c in cuts]


class _Digest:
    """What the ids of one conversation hold, turn after turn."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.formatted = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, offset: int, starts: list[int], ends: list[int], path: str) -> None:
        for role, text in read_turns(ids, path):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8"))
            self.n += 1
        for a, b in zip(starts, ends):
            text = unescape(_text_of(ids[a - offset:b - offset], path))
            self.loss.update(text.encode("utf-8"))
            self.chars += len(text)
        self.formatted += len(_text_of(ids, path))

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of what the ids and masks hold, per conversation: n_turns, turns_sha256 (role, line
    feed, text, line feed), loss_chars and loss_sha256 (the unescaped text under the mask),
    formatted_chars. `formatted` is of `format_turns` or `format_conversations`."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    if "offset" in formatted.columns:
        rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    else:
        rows = formatted.withColumns({"seq": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    rows = rows.select("conv_id", "seq", "offset", "ids", "loss_start", "loss_end")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        conv, n, turns_sha, chars, loss_sha, formatted_chars = zip(*rows)
        longs = pa.int64()
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, longs), pa.array(n, longs), pa.array(turns_sha), pa.array(chars, longs),
             pa.array(loss_sha), pa.array(formatted_chars, longs)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches):
        digest = None
        for batch in batches:
            for part in bounded(batch, "ids"):
                out = []
                for conv, seq, offset, raw, starts, ends in zip(*[c.to_pylist() for c in part.columns]):
                    if seq == 0:  # a conversation's first row
                        if digest:
                            out.append(digest.row())
                        digest = _Digest(conv)
                    digest.add(np.frombuffer(raw, "<u4"), offset, starts, ends, path)
                if out:
                    yield batch_of(out)
        if digest:
            yield batch_of([digest.row()])
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")
