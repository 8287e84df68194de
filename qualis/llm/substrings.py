"""Substring dedup by level-wise doubling.

Windows of words are looked for at growing lengths, and only windows that repeat
(in two documents or more) at one length are extended to the next:

1. Anchors. Each window of `window` words names its smallest-hash sub-window of
   half the length (rounded up), so documents that share the window share the
   anchor. About a quarter of the positions are anchors.
2. The windows that hold a repeated anchor, twice as long (`window` itself), with
   128-bit keys. Their smallest document is found.
3. `longest_repeats` goes on: two repeated windows in a row make a candidate of
   twice the length, until no candidate survives.

Skew: rows first meet inside a task. For every key a slice sends on one row, and
settles its other documents itself (they are repeated, and not the first), so a
key that is in a third of all documents costs one row per Arrow slice. Identical
texts are settled by their SHA-256 first; only the first copy is searched.

Rows are keyed by a 64-bit hash of id and text, so repeated rows get equal
results. Defined cases: a null or blank text has no words; a null id counts as
larger than all others; rows of one id never cover each other; a text shorter than
the window loses nothing; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .text import LAST_ID, WordHashes, in_slices, ref, rolling, space_words, texts

WINDOW = 13
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_hashes = WordHashes(1)
_KEYED = "solved boolean, several boolean, k1 long, k2 long, ord long, rk long"


def _anchor_positions(anchors: np.ndarray, scope: int) -> np.ndarray:
    """For every window of `scope` sub-windows the position of its smallest (first if tied)."""
    n = len(anchors) - scope + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = anchors[:n].copy()
    at = np.arange(n)
    for j in range(1, scope):
        less = anchors[j:j + n] < best
        best[less] = anchors[j:j + n][less]
        at[less] = np.flatnonzero(less) + j
    return at


def _anchors_of(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash of every sub-window, and each window's anchor position."""
    half = (window + 1) // 2
    anchors = rolling(hashes, half, _M[0])
    return anchors, _anchor_positions(anchors, window - half + 1)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: where a new key starts, and whether a row shares its key with another."""
    same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    edge = np.zeros(1, bool)
    return np.concatenate((~edge, ~same)), np.concatenate((same, edge)) | np.concatenate((edge, same))


def _settle(k1: np.ndarray, k2: np.ndarray, order: np.ndarray, rk: np.ndarray) -> pa.RecordBatch | None:
    """Of the rows of each key the ones with the smallest order stay open; the others are solved."""
    if not len(k1):
        return None
    by = np.lexsort((order, k2, k1))
    k1, k2, order, rk = k1[by], k2[by], order[by], rk[by]
    new, several = _groups(k1, k2)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return pa.RecordBatch.from_arrays(
        [pa.array(order > first), pa.array(several), pa.array(k1.view(np.int64)),
         pa.array(k2.view(np.int64)), pa.array(order), pa.array(rk)],
        ["solved", "several", "k1", "k2", "ord", "rk"])


def _over_keys(rows: DataFrame) -> DataFrame:
    """Rows of _KEYED with the smallest order of their key and the number of its open rows.
    Solved rows only pass through, dealt by document, so that a hot key does not draw
    them together."""
    deal = Window.partitionBy("solved", F.when(F.col("solved"), F.col("rk")).otherwise(F.col("k1")), "k2")
    return rows.select("*", F.min("ord").over(deal).alias("first"), F.count("*").over(deal).alias("n"))


def _repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(rk, marks): the anchors of each document that another document has too."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hs = []
        for text in texts(batch.column("text")):
            anchors, at = _anchors_of(_hashes.of(space_words(text)), window)
            hs.append(np.unique(anchors[np.unique(at)]))
        h = np.concatenate(hs)
        if not len(h):
            return None
        rk = np.repeat(batch.column("rk").to_numpy(), [len(x) for x in hs])
        by = np.argsort(h, kind="stable")
        h, rk = h[by], rk[by]
        new, several = _groups(h)
        # repeated in this slice: known; one row of each key also goes on, for the other slices
        at = np.concatenate((np.flatnonzero(new), np.flatnonzero(several)))
        solved = np.arange(len(at)) >= new.sum()
        return pa.RecordBatch.from_arrays(
            [pa.array(solved), pa.array(h[at].view(np.int64)), pa.array(rk[at])], ["solved", "h", "rk"])
    rows = docs.mapInArrow(in_slices(run, "text"), "solved boolean, h long, rk long")
    deal = Window.partitionBy("solved", F.when(F.col("solved"), F.col("rk")).otherwise(F.col("h")))
    return (rows.withColumn("n", F.count("*").over(deal)).where("solved OR n > 1")
            .groupBy("rk").agg(F.collect_set("h").alias("marks")))


def _extended(docs: DataFrame, length: int, longer: int) -> DataFrame:
    """_KEYED rows, one per document: the windows of `longer` words that hold a marked
    anchor (length 0), or that begin and end with a marked window of `length` words."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        k1s, k2s, sizes = [], [], []
        for text, marks in zip(texts(batch.column("text")), batch.column("marks")):
            hashes = _hashes.of(space_words(text))
            if length:
                marked = np.isin(rolling(hashes, length, _M[0]).view(np.int64), marks.values.to_numpy())
                n = max(0, len(hashes) - longer + 1)
                on = np.flatnonzero(marked[:n] & marked[longer - length:][:n])
            else:
                anchors, at = _anchors_of(hashes, longer)
                on = np.flatnonzero(np.isin(anchors.view(np.int64), marks.values.to_numpy())[at])
            keys, pick = np.unique(rolling(hashes, longer, _M[0])[on], return_index=True)
            k1s.append(keys)
            k2s.append(rolling(hashes, longer, _M[1])[on][pick])
            sizes.append(len(keys))
        per_doc = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("ord", "rk")]
        return _settle(np.concatenate(k1s), np.concatenate(k2s), *per_doc)
    return docs.mapInArrow(in_slices(run, "text"), _KEYED)


def _base(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row with rk and ord (columns numbered, the text as `text`), dealt by rk; and
    the rk of the first row of each text. The steps read the same dealt rows, all
    columns, so that Spark shuffles the texts once and reuses the exchange."""
    order = F.coalesce(ref(id_col).cast("long"), F.lit(LAST_ID))
    key = F.xxhash64(ref(text_col))
    rows = docs.select(F.xxhash64(order, key).alias("rk"), order.alias("ord"),
                       *[ref(c).alias("text" if c == text_col else f"c{i}")
                         for i, c in enumerate(docs.columns)]).repartition("rk")
    first = (docs.groupBy(F.sha2(ref(text_col), 256).alias("c"), key.alias("th"))
             .agg(F.min(order).alias("ord")).select(F.xxhash64("ord", "th").alias("rk")).distinct())
    return rows, first


def _covered(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The rows of `_base` with `cover`, the keys of windows that start in a document
    with a smaller id (for the first copy of a text), and `is_first`."""
    rows, first = _base(docs, id_col, text_col)
    marks = _repeated_anchors(rows.join(first, "rk"), window)
    found = _over_keys(_extended(rows.join(marks, "rk"), 0, window))
    cover = found.where("solved OR ord > first").groupBy("rk").agg(F.collect_set("k1").alias("cover"))
    return rows.join(cover, "rk", "left").join(first.withColumn("is_first", F.lit(True)), "rk", "left")


def _removed(batch: pa.RecordBatch, window: int):
    """For every row its words and which of them to remove. A later copy of a text is
    covered wholly, as each of its windows starts in the first copy."""
    for text, cover, is_first in zip(texts(batch.column("text")), batch.column("cover"),
                                     batch.column("is_first").to_pylist()):
        words = space_words(text)
        n = len(words)
        if n < window or is_first and not cover.is_valid:
            yield words, np.zeros(n, bool)
        elif not is_first:
            yield words, np.ones(n, bool)
        else:
            keys = rolling(_hashes.of(words), window, _M[0]).view(np.int64)
            on = np.flatnonzero(np.isin(keys, cover.values.to_numpy()))
            edge = np.bincount(on, minlength=n + 1) - np.bincount(on + window, minlength=n + 1)
            yield words, np.cumsum(edge[:n]) > 0


def _joined(words: list[bytes], off: np.ndarray) -> bytes:
    return b" ".join([words[i] for i in np.flatnonzero(~off)] if off.any() else words)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(len(w), int(off.sum()), hashlib.sha256(_joined(w, off)).hexdigest())
               for w, off in _removed(batch, window)]
        n, gone, sha = zip(*out)
        return pa.RecordBatch.from_arrays(
            [batch.column("ord"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
            ["ord", "n_words", "n_removed", "kept_sha256"])
    out = (_covered(docs.select(ref(id_col), ref(text_col)), id_col, text_col, window)
           .mapInArrow(in_slices(run, "text"),
                       "ord long, n_words long, n_removed long, kept_sha256 string"))
    return out.select(F.when(F.col("ord") != LAST_ID, F.col("ord")).alias(id_col),
                      "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chars_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """The documents with the repeated windows cut out, all columns kept. A changed text
    is its kept words joined by one space, others stay as they are (null too);
    `chars_col`, where given, is set to the length of a changed text."""
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    chars_at = docs.columns.index(chars_col) if chars_col else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c) for c in names]
        values = columns[docs_at].to_pylist()
        chars = columns[chars_at].to_pylist() if chars_at is not None else None
        for i, (words, off) in enumerate(_removed(batch, window)):
            if off.any():
                values[i] = _joined(words, off).decode("utf-8")
                if chars is not None:
                    chars[i] = len(values[i])
        columns[docs_at] = pa.array(values, columns[docs_at].type)
        if chars is not None:
            columns[chars_at] = pa.array(chars, columns[chars_at].type)
        return pa.RecordBatch.from_arrays(columns, names)
    docs_at = docs.columns.index(text_col)
    return (_covered(docs, id_col, text_col, window)
            .mapInArrow(in_slices(run, "text"), docs.toDF(*names).schema).toDF(*docs.columns))


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """Per first copy with a repeated window: id and `repeat_words`, the greatest length
    (window, 2 * window, 4 * window, ...) at which it still shares a window with another
    document. Doubles until no candidate survives; every level is stored."""
    rows, first = _base(docs.select(ref(id_col), ref(text_col)), id_col, text_col)
    marks, length, longer, found = _repeated_anchors(rows.join(first, "rk"), window), 0, window, None
    while True:
        level = _over_keys(_extended(rows.join(marks, "rk"), length, longer))
        marks = stored(level.where("solved OR several OR n > 1")
                       .groupBy("rk").agg(F.min("ord").alias("o"), F.collect_set("k1").alias("marks")))
        here = marks.select("rk", "o", F.lit(longer).alias("repeat_words"))
        found = here if found is None else found.unionByName(here)
        if marks.isEmpty():
            break
        marks, length, longer = marks.drop("o"), longer, 2 * longer
    return (found.groupBy("rk").agg(F.max("o").alias("o"), F.max("repeat_words").alias("repeat_words"))
            .select(F.when(F.col("o") != LAST_ID, F.col("o")).alias(id_col), "repeat_words"))
