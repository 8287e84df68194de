"""Shared helpers: column references, words, bounded Arrow slices, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z became a-z
SLICE_BYTES = 4 << 20
CACHE_WORDS = 200_000
LAST_ID = (1 << 63) - 1  # a null id sorts after every other

# ASCII upper case to lower case, every other ASCII non-alphanumeric to a space; UTF-8 bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
              for b in range(256))


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded_words(text: bytes) -> list[bytes]:
    """Words of WORD in the text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def space_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: `bytes.split` cuts at exactly these six bytes."""
    return text.split()


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def bounded(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `limit` text bytes (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total + size > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def in_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str | int,
              limit: int = SLICE_BYTES):
    """A `mapInArrow` function applying `fn` to bounded slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
    return run


def map_whole(df: DataFrame, fn) -> DataFrame:
    """`mapInArrow` with all columns in and out, by position: it resolves column names
    unquoted, so they are plain (c0, c1, ...) meanwhile."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(fn, plain.schema).toDF(*df.columns)


class WordHashes(dict):
    """xxHash64 of words, remembered for words seen by this Python worker."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window of k word hashes (none if there are fewer words).

    The polynomial of the first k words by powers of an odd multiplier is mixed
    at the end, so that equal low bits of words do not show.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    m = np.uint64(multiplier)
    for j in range(1, k):
        out *= m
        out += hashes[j:j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out
