"""CSV records that go over line feeds, cut without reading a file in one task.

A file is read as lines, split by split. A line either leaves the reader where it was
(outside or inside a quoted field), or moves it: for each state at its start there is one at its end.
Such maps compose, so

1. every task composes the maps of its lines to one map per split (lines without a quote
   change nothing and are not looked at); one row per split;
2. the states are carried over the splits of each file, in order, one row per split;
3. every task cuts its lines again, now from the right state. Lines joined by line feeds
   are a record where the reader is outside at its end. What a split holds of a record that
   began before it, or goes on after it, is a fragment; fragments are joined by the
   split in which their record begins.

A quote opens a field only at the field's start; after that `""` is a quote and any other quote
closes it. A quote elsewhere is text. A file that ends inside a quoted field is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stored

# the map of a line: where it ends from outside (bit 0) and from inside (bit 1); 1 is inside
_OUT, _SAME, _SWAP, _IN = 0, 2, 1, 3
# states of a scan over the pieces of a line between quotes
_START, _TEXT, _QUOTED, _CLOSED = 3, 0, 1, 2
KEPT_SPLITS = 1 << 20  # states of splits kept in every task (9 bytes each); above, lines are dealt out by split


def _ends_inside(pieces: Column, sep: str, start: int) -> Column:
    """Whether a line is inside a quoted field at its end; `pieces` are its parts between quotes."""
    def step(state: Column, piece: Column) -> Column:
        # the piece, read in this state, and the quote after it
        opens = (state != _QUOTED) & (piece.endswith(sep) | ((piece == "") & state.isin(_START, _CLOSED)))
        return F.when(state == _QUOTED, _CLOSED).when(opens, _QUOTED).otherwise(_TEXT)
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.aggregate(before, F.lit(start), step) == _QUOTED


def line_map(line: Column, sep: str) -> Column:
    """The map of a line, as its number."""
    pieces = F.split(line, '"', -1)
    code = (F.when(_ends_inside(pieces, sep, _START), 1).otherwise(0)
            + F.when(_ends_inside(pieces, sep, _QUOTED), 2).otherwise(0))
    return F.when(F.contains(line, F.lit('"')), code).otherwise(_SAME).cast("int")


_FILE = ("f1", "f2")  # a file's path as 96 bits of hash


def file_lines(spark: SparkSession, path: str, encoding: str, sep: str) -> DataFrame:
    """f1, f2, split (its first byte), line (in order within a split), code (the line's map), value: lines end at
    line feeds."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    name = F.col("_metadata.file_path")
    rows = text.select(F.xxhash64(name).alias("f1"), F.hash(name).cast("long").alias("f2"),
                       F.col("_metadata.file_block_start").alias("split"), value.alias("value"))
    return rows.select(*_FILE, "split", F.monotonically_increasing_id().alias("line"),
                       line_map(F.col("value"), sep).alias("code"), "value")


def _after(codes: np.ndarray, state: int) -> np.ndarray:
    """The state after each line, from the state before the first."""
    moved = np.cumsum(codes == _SWAP)
    fixed = (codes == _OUT) | (codes == _IN)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(codes)), -1))
    at = np.maximum(last, 0)
    return np.where(last >= 0, (codes[at] == _IN) ^ ((moved - moved[at]) & 1 == 1), (state == 1) ^ (moved & 1 == 1))


def _runs(batch: pa.RecordBatch):
    """((f1, f2, split), first row, row after the last) of the runs of rows of one split."""
    key = np.stack([batch.column(c).to_numpy() for c in (*_FILE, "split")], 1)
    cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield tuple(key[i].tolist()), i, j


def _table(rows, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


_SPLITS = "f1 long, f2 long, split long, code int, opening long"


def _compose(batches):
    """One map per split, and how many of its lines, begun outside, end inside. A task reads the lines of a split in order."""
    held: dict = {}
    for batch in batches:
        codes = batch.column("code").to_numpy()
        for key, i, j in _runs(batch):
            a, b, n = held.get(key, (0, 1, 0))
            ends = [int(_after(codes[i:j], s)[-1]) for s in (0, 1)]
            held[key] = (ends[a], ends[b], n + int((codes[i:j] & 1).sum()))
    if held:
        yield _table([(*key, a + 2 * b, n) for key, (a, b, n) in held.items()], _SPLITS)


_STATES = "f1 long, f2 long, split long, inside boolean"


def _carry(batches):
    """Splits sorted by (file, split): whether each begins inside a quoted field. The last row of a file, without a split,
    tells how it ends."""
    file, state, out = None, 0, []
    for batch in batches:
        for f1, f2, split, code in zip(*[batch.column(c).to_pylist() for c in (*_FILE, "split", "code")]):
            if (f1, f2) != file:
                if file is not None:
                    out.append((*file, None, state == 1))
                file, state = (f1, f2), 0
            out.append((*file, split, state == 1))
            state = code >> state & 1
        if len(out) >= 1000:
            yield _table(out, _STATES)
            out = []
    if file is not None:
        out.append((*file, None, state == 1))
        yield _table(out, _STATES)


# records have a value alone; fragments all columns; a split has one row without a value
_CUT = "f1 long, f2 long, split long, begins boolean, ends boolean, header boolean, value string"


class _Cutter:
    """The records of one split, batch after batch."""

    def __init__(self, key: tuple, inside: bool):
        self.key, self.state = key, int(inside)
        self.open: list[str] = []      # lines of the record that is not ended
        self.began = not inside        # whether that record began in this split
        self.header = key[2] == 0      # whether the file's header is still to come
        self.fragments: list[tuple] = []

    def _fragment(self, value: str, ends: bool) -> None:
        header = self.header and self.began
        self.fragments.append((*self.key, self.began, ends, header, value))
        self.header &= not header

    def cut(self, codes: np.ndarray, lines: pa.Array) -> pa.Array:
        """Whole records of the lines, without the header; keeps the lines after the last one."""
        after = _after(codes, self.state)
        ends = np.flatnonzero(~after)
        self.state = int(after[-1])
        if not len(ends):
            self.open += lines.to_pylist()
            return lines[:0]
        if len(ends) == len(lines):
            records = lines
        else:
            grouped = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends + 1)), pa.int32()), lines[:int(ends[-1]) + 1])
            records = pc.binary_join(grouped, "\n")
        if self.open or not self.began:
            first = "\n".join([*self.open, records[0].as_py()])
            if self.began:
                records = pa.concat_arrays([pa.array([first], records.type), records[1:]])
            else:
                self._fragment(first, True)
                records = records[1:]
            self.began = True
        self.open = lines[int(ends[-1]) + 1:].to_pylist()
        while self.header and len(records):  # blank lines before the header are no records
            self.header = not records[0].as_py().strip()
            records = records[1:]
        return records

    def finish(self) -> None:
        if self.open:
            self._fragment("\n".join(self.open), False)


def _cut(inside: frozenset | None):
    """Lines, in order within each split, to whole records and the fragments of records that go over the ends of a
    split. `inside` holds the splits that begin inside a quoted field; without it a row without a line tells it
    before the lines of a split."""
    def run(batches):
        cutter = None

        def end():
            cutter.finish()
            return _table([*cutter.fragments, (*cutter.key, None, None, None, None)], _CUT)

        for batch in batches:
            codes = batch.column("code").to_numpy(zero_copy_only=False)
            for key, i, j in _runs(batch):
                if cutter is None or cutter.key != key:
                    if cutter is not None:
                        yield end()
                    cutter = _Cutter(key, codes[i] == 1 if inside is None else key in inside)
                    i += inside is None
                if j > i:
                    records = cutter.cut(codes[i:j].astype(np.int64), batch.column("value").slice(i, j - i))
                    if n := len(records):
                        none = [pa.nulls(n, t) for t in (*[pa.int64()] * 3, *[pa.bool_()] * 3)]
                        yield pa.RecordBatch.from_arrays([*none, records.cast(pa.string())],
                                                         [c.split()[0] for c in _CUT.split(", ")])
        if cutter is not None:
            yield end()
    return run


def _whole(batches):
    """Fragments sorted by (file, split, place) to records, without the header."""
    held, header, out = [], False, []
    for batch in batches:
        for begins, ends, is_header, value in zip(*[batch.column(c).to_pylist() for c in ("begins", "ends", "header", "value")]):
            if begins:
                held, header = [], is_header
            held.append(value)
            if ends:
                if not header:
                    out.append("\n".join(held))
                held = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
            out = []


class UnclosedQuote(ValueError):
    """A file ends inside a quoted field."""


def records_over_lines(spark: SparkSession, path: str, encoding: str, sep: str) -> DataFrame | None:
    """The records of the files as text (column value), without headers and blank lines, cut once and stored in the
    checkpoint folder; None where every line is a record."""
    lines = file_lines(spark, path, encoding, sep)
    splits = stored(lines.select(*_FILE, "split", "code").mapInArrow(_compose, _SPLITS))
    if not splits.agg(F.sum("opening")).first()[0]:
        return None
    # the order of a file's splits is one row per split
    states = stored(splits.repartition(*_FILE).sortWithinPartitions(*_FILE, "split").mapInArrow(_carry, _STATES))
    if states.where("split IS NULL AND inside").limit(1).count():
        raise UnclosedQuote("a file ends inside a quoted field")
    begun = states.where("split IS NOT NULL AND inside")
    known = begun.count()
    if known <= KEPT_SPLITS:
        inside = frozenset((r.f1, r.f2, r.split) for r in begun.select(*_FILE, "split").collect())
        rows = lines
    else:  # too many to keep in every task: each split's lines follow a row that tells its state
        inside = None
        told = states.where("split IS NOT NULL").select(
            *_FILE, "split", F.lit(-1).cast("long").alias("line"), F.col("inside").cast("int").alias("code"),
            F.lit("").alias("value"))
        rows = told.unionByName(lines).repartition(*_FILE, "split").sortWithinPartitions(*_FILE, "split", "line")
    cut = stored(rows.select(*_FILE, "split", "code", "value").mapInArrow(_cut(inside), _CUT))
    seen = cut.where("value IS NULL").select(*_FILE, "split").distinct()
    whole = states.where("split IS NOT NULL")
    if seen.count() != whole.count() or whole.join(seen, [*_FILE, "split"], "left_anti").limit(1).count():
        raise RuntimeError("the files were split differently in the two passes; load them again")
    records = cut.where("f1 IS NULL").select("value")
    if known:
        place = F.col("begins").cast("int")  # what ends a record comes before what begins one
        parts = cut.where("f1 IS NOT NULL AND value IS NOT NULL").repartition(*_FILE) \
            .sortWithinPartitions(*_FILE, "split", place).mapInArrow(_whole, "value string")
        records = records.unionByName(parts)
    end = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return records.select(end.alias("value")).where(F.trim(F.col("value"), F.lit(" \t\r\n\x0b\f")) != "")
