"""Sum-of-squares online packing of token sequences into windows.

Every task packs its own rows as they come. A document's whole windows are cut off
first; its rest is placed whole into the fill level that makes the sum of squared
counts of partially filled windows smallest (a new window counts as level 0; ties
go to the fuller window). `counts[h]` is the number of open windows filled to h.

At the end of the task, and whenever `MAX_OPEN` windows are open, the open windows
are laid one after the other and cut at the window size, so memory stays bounded.
The last rest of a task is cut at powers of two, which need no padding.

Rows out: id, start, length, tokens (little-endian unsigned 32-bit), doc_tokens,
sequence_id, offset. Sequence ids hold the task's partition number in their upper
32 bits.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
each; a null id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import bounded, ref, texts
from .tokens import vocabulary, word_bpe

WINDOW = 2048
END_ID = 1
MAX_OPEN = 4096
_BATCH = 2000
SCHEMA = ("id long, start long, length long, tokens binary, doc_tokens long, "
          "sequence_id long, offset long")


class Packer:
    """Pieces are (id, start, ids, doc_tokens); `put` and `close` give finished windows as lists of them."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.counts = np.zeros(window + 1)
        self.counts[window] = -0.5  # a full window leaves the sum: 2 * counts + 1 is 0
        self.levels: list[list[list]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """The fill level to put a rest of `size` on."""
        top = self.window - size
        held = self.counts[1:top + 1]
        after = self.counts[1 + size:top + size + 1]
        # counts[h] falls and counts[h + size] rises by one: 2 * (after - held) + 2
        cost = np.where(held > 0, 2 * (after - held) + 2, np.inf)[::-1]
        best = int(cost.argmin()) if len(cost) else -1
        if best >= 0 and cost[best] <= 2 * self.counts[size] + 1:
            return top - best
        return 0

    def _open(self, pieces: list, fill: int) -> None:
        self.levels[fill].append(pieces)
        self.counts[fill] += 1
        self.n_open += 1

    def put(self, doc, ids: np.ndarray) -> Iterator[list]:
        n, w = len(ids), self.window
        whole = n - n % w
        for at in range(0, whole, w):
            yield [(doc, at, ids[at:at + w], n)]
        if whole == n:
            return
        size = n - whole
        piece = (doc, whole, ids[whole:], n)
        h = self.level(size)
        pieces = []
        if h:
            pieces = self.levels[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if h + size == w:
            yield pieces
        else:
            self._open(pieces, h + size)
            if self.n_open >= self.max_open:
                rest, fill = yield from self._lay()
                if fill:
                    self._open(rest, fill)

    def _lay(self) -> Iterator[list]:
        """All open windows one after the other, cut at the window size; returns the rest."""
        rest, fill = [], 0
        for h in range(self.window - 1, 0, -1):
            for pieces in self.levels[h]:
                for doc, start, ids, n in pieces:
                    while len(ids):
                        part = ids[:self.window - fill]
                        rest.append((doc, start, part, n))
                        start, ids, fill = start + len(part), ids[len(part):], fill + len(part)
                        if fill == self.window:
                            yield rest
                            rest, fill = [], 0
            self.levels[h] = []
            self.counts[h] = 0
        self.n_open = 0
        return rest, fill

    def close(self) -> Iterator[list]:
        rest, fill = yield from self._lay()
        while fill:
            size, taken, room = 1 << (fill.bit_length() - 1), [], 1 << (fill.bit_length() - 1)
            while room:
                doc, start, ids, n = rest.pop(0)
                taken.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], n))
                room -= len(taken[-1][2])
            yield taken
            fill -= size


def _rows(windows: Iterator[list], first_id: int) -> Iterator[pa.RecordBatch]:
    def batch() -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[4:]]],
            ["id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"])
    out: list[tuple] = []
    for k, pieces in enumerate(windows):
        offset = 0
        for doc, start, ids, n in pieces:
            out.append((doc, start, len(ids), ids.tobytes(), n, first_id + k, offset))
            offset += len(ids)
        if len(out) >= _BATCH:
            yield batch()
            out = []
    if out:
        yield batch()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece, see the module. `path` is a word-BPE vocabulary file."""
    path = path or vocabulary("word_bpe_49k.json")

    def windows(batches) -> Iterator[list]:
        packer = Packer(window, max_open)
        for whole in batches:
            for part in bounded(whole, "text"):
                ids, counts = word_bpe(path).encode([t.decode("utf-8") for t in texts(part.column("text"))])
                for doc, own in zip(part.column("id").to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                    yield from packer.put(doc, np.append(own, np.uint32(end_id)))
        yield from packer.close()

    def run(batches):
        return _rows(windows(batches), TaskContext.get().partitionId() << 32)
    rows = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
