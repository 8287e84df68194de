"""Quality rules: repetition inside a text, measured with a suffix array of its words.

For every text the suffix array of its word sequence is built by prefix
doubling and the longest common prefixes (LCP) of neighbouring suffixes follow
from the doubling ranks. The LCP intervals are the text's repeated substrings:
the deepest interval holding a suffix has the LCP value max(lcp before, lcp
after), the length of the longest repeat starting there, and a repeat is maximal
where the suffix one word earlier does not repeat by one word more. The spans of
the maximal repeats of at least `min_repeat` words are united; a text fails if
they cover too large a fraction or if one repeat is too long.

All texts of an Arrow slice share one array: every word is tagged with its text
and every text ends in a symbol of its own, so no repeat crosses texts.

Defined cases: a null or blank text has no words, zero counts, and fails the
base rule (fewer than 50 words); repeated rows each get their row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import in_slices, map_whole, ref, space_words, texts

MIN_REPEAT = 12        # words; shorter repeats are not counted as repetition
MAX_COVERED = 0.40     # of the words
MAX_LONGEST = 0.25     # of the words
BASE_WINDOW = 3
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

SCHEMA = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, n_covered_words long, longest_repeat long, "
          "base_failed boolean, kept boolean")


def longest_repeats(keys: np.ndarray) -> np.ndarray:
    """For every position the length of the longest substring starting there that
    starts at another position too. The last key of every text must be unique."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels = [rank.astype(np.int32)]
    live, h = np.flatnonzero(counts[inverse] > 1), 1
    while live.size:
        # a suffix that shares h words with another has not reached its text's end
        key = rank[live] * n + rank[live + h]
        order = np.argsort(key, kind="stable")
        at, key = live[order], key[order]
        old = rank[at]
        step = np.arange(len(at))
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first_old = np.maximum.accumulate(np.where(new_old, step, 0))
        first = np.maximum.accumulate(np.where(new, step, 0))
        rank = rank.copy()
        rank[at] = old + first - first_old
        levels.append(rank.astype(np.int32))
        heads = np.flatnonzero(new)
        size = np.diff(np.concatenate((heads, [len(at)])))
        live = at[np.repeat(size > 1, size)]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1].copy(), suffixes[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][left] == levels[k][right])
        left[same] += 1 << k
        right[same] += 1 << k
    lcp = left - suffixes[:-1]
    longest = np.zeros(n, np.int64)
    longest[suffixes[:-1]] = lcp
    longest[suffixes[1:]] = np.maximum(longest[suffixes[1:]], lcp)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _dup_lines(text: str) -> int:
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dups += line in seen
            seen.add(line)
    return dups


def measure(values: list[bytes], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
            max_longest: float = MAX_LONGEST) -> dict[str, np.ndarray]:
    """The columns of SCHEMA after the id, for a list of UTF-8 texts."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    symbols, sizes = [], []
    for value in values:
        words = space_words(value)
        sizes.append(len(words))
        symbols.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    n = np.array(sizes, np.int64)
    ends = np.cumsum(n + 1)
    base, end_symbol = len(ids) + 1, len(ids)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for i, s in enumerate(symbols):
        flat[ends[i] - n[i] - 1:ends[i] - 1] = s + i * base
        flat[ends[i] - 1] = end_symbol + i * base
    longest = longest_repeats(flat)
    total = len(flat)
    starts3 = np.flatnonzero(longest >= BASE_WINDOW)
    in3 = _covered(starts3, np.full(len(starts3), BASE_WINDOW), total)
    # maximal: the suffix one word earlier does not hold this repeat as its tail
    before = np.concatenate(([0], longest[:-1]))
    maximal = np.flatnonzero((longest >= min_repeat) & (before <= longest))
    spans = _covered(maximal, longest[maximal], total)
    first = ends - n - 1
    add = (lambda x: np.add.reduceat(x.astype(np.int64), first) if total else np.zeros(0, np.int64))
    top = np.maximum.reduceat(np.where(longest >= min_repeat, longest, 0), first) if total else n
    repeat_words, covered = add(in3), add(spans)
    strings = [v.decode("utf-8") for v in values]
    base_failed = (n < 50) | (100 * repeat_words > 50 * n)
    kept = ~base_failed & (covered <= max_covered * n) & (top <= max_longest * n)
    return {
        "n_words": n,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in strings], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in strings], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in strings], np.int64),
        "n_repeat_words": repeat_words, "n_covered_words": covered, "longest_repeat": top,
        "base_failed": base_failed, "kept": kept,
    }


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **limits: float) -> DataFrame:
    """One row per document: SCHEMA, with the id under its own name."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = measure(texts(batch.column("text")), **limits)
        return pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out.values())],
                                          ["id", *out])
    rows = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text"))
    out = rows.mapInArrow(in_slices(run, "text"), SCHEMA)
    return out.withColumnRenamed("id", id_col)


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", **limits: float) -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(measure(texts(batch.column(at)), **limits)["kept"]))
    return map_whole(docs, in_slices(run, at))
