"""Stupid-backoff language-model scores, computed relationally.

Every word of the corpus counts: words and bigrams are counted by hash, and the tables
grow with the input. With c and N over the whole corpus and `own` the document's own
count of the bigram, so that a document does not vouch for itself,

    S(v | u) = (c(u v) - own) / c(u)    if another place has the bigram, else
               0.4 * c(v) / N

The score is the mean of ln S over the document's bigrams.

The tables are kept in blocks, not in rows:

1. documents are stored by slices of at most `SLICE_BYTES` of text: the hashes of a slice's words and
   its texts as numbers of those words;
2. a slice counts its own words and bigrams and sends the sorted 64-bit keys, as differences, with their
   counts, one block per range of keys. A range's blocks from all slices are one group of about
   `GROUP_KEYS` keys at most; merged, they are that part of the count table;
3. the counts go back to each slice, in the order of its keys, are joined to its bigrams there and
   summed per document.

A bigram that is in every document is one key per slice, and ranges of hashes are even, so no key
and no group is hot. Words and bigrams are told apart by 64 bits: of 10^13 bigrams about one in a
million shares its key with another.

Defined cases: a null or empty text has no words; fewer than two words have no bigram
and a null score; every row is a document, also one that is repeated; an empty table gives
no rows; other columns are not read; a text longer than a slice is a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .text import _FOLD, SLICE_BYTES, bounded, ref, texts

BACKOFF = 0.4
GROUP_KEYS = 1 << 20
_WORDS, _BIGRAMS = 0, 1


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, byte by byte (all lowest bytes, then the next, ...), compressed."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def _numbered(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as numbers of the slice's different words, the number of words of each text, and the hashes of the
    different words."""
    folded = pa.array([v.translate(_FOLD) for v in values], pa.large_binary()).cast(pa.large_string())
    split = pc.ascii_split_whitespace(folded)
    words = split.flatten()
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(there)))
    n_words = np.diff(ends[np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))])
    coded = words.filter(pa.array(there)).dictionary_encode()
    different = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n_words, hashes


class _Slice:
    """What a slice's word numbers tell."""

    def __init__(self, stream: np.ndarray, n_words: np.ndarray, hashes: np.ndarray):
        self.n_words, self.hashes = n_words, hashes
        k = len(hashes)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        inside = doc[1:] == doc[:-1]
        codes = (stream[:-1] * k + stream[1:])[inside]
        self.doc = doc[1:][inside]
        self.word_counts = np.bincount(stream, minlength=k)
        different, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
        self.u, self.v = np.divmod(different, max(1, k))
        self.at, self.counts = at, counts  # each place's bigram, each bigram's count
        keys = hashes[self.u] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.v]
        keys ^= keys >> np.uint64(29)
        self.keys = keys * np.uint64(0xBF58476D1CE4E5B9)

    def tables(self):
        """(kind, keys, their order, counts)."""
        for kind, keys, counts in ((_WORDS, self.hashes, self.word_counts), (_BIGRAMS, self.keys, self.counts)):
            yield kind, keys, np.argsort(keys, kind="stable"), counts


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """The place of each of `parts` even ranges of 64-bit keys in the sorted keys, and their end."""
    bounds = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


_SLICE = "slice long, ids array<long>, n_words array<int>, hashes binary, stream binary, tokens long, different long"


def _stored_slices(batches):
    number = TaskContext.get().partitionId() << 32
    pack = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for part in bounded(whole, "text", SLICE_BYTES):
            stream, n_words, hashes = _numbered(texts(part.column("text")))
            wide = "<u2" if len(hashes) <= 1 << 16 else "<u4"
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column("id")),
                 pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(n_words.astype(np.int32))),
                 pa.array([hashes.astype("<u8").tobytes()]), pa.array([pack.compress(stream.astype(wide).tobytes())]),
                 pa.array([len(stream)]), pa.array([len(hashes)])],
                ["slice", "ids", "n_words", "hashes", "stream", "tokens", "different"])
            number += 1


def _read_slice(n_words: pa.Array, hashes: bytes, stream: bytes) -> _Slice:
    h = np.frombuffer(hashes, "<u8")
    raw = zstandard.ZstdDecompressor().decompress(stream)
    return _Slice(np.frombuffer(raw, "<u2" if len(h) <= 1 << 16 else "<u4").astype(np.int64),
                  np.asarray(n_words, np.int64), h)


_BLOCK = "slice long, kind int, part int, keys binary, counts binary"


def _blocks(parts: tuple[int, int]):
    """A slice's own counts, one row per range of keys."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = _read_slice(batch.column("n_words")[row].values, batch.column("hashes")[row].as_py(),
                                  batch.column("stream")[row].as_py())
                slice_ = batch.column("slice")[row].as_py()
                out = []
                for kind, keys, order, counts in one.tables():
                    keys, counts = keys[order], counts[order]
                    at = _ranges(keys, parts[kind])
                    out += [(slice_, kind, p, _pack_sorted(keys[i:j]), _pack(counts[i:j]))
                            for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
                if out:
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                     ["slice", "kind", "part", "keys", "counts"])
    return run


_COUNTS = "slice long, kind int, part int, totals binary"


def _merged(batches):
    """Blocks sorted by (kind, part): the corpus counts of each block's keys, in their order."""
    group, held = None, []

    def out():
        keys = [_unpack_sorted(k) for _, k, _ in held]
        counts = np.concatenate([_unpack(c) for _, _, c in held])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, counts).astype(np.uint64)[at]  # exact below 2**53
        ends = np.cumsum([len(k) for k in keys])
        rows = [(s, *group, _pack(t)) for (s, _, _), t in zip(held, np.split(totals, ends[:-1]))]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          ["slice", "kind", "part", "totals"])
    for batch in batches:
        for s, kind, part, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("slice", "kind", "part", "keys", "counts")]):
            if held and (kind, part) != group:
                yield out()
                held = []
            group = (kind, part)
            held.append((s, keys, counts))
    if held:
        yield out()


def _scored(total: int):
    """Rows sorted by (slice, kind, part): a slice, then the counts of its words and of its bigrams."""
    def score(row, found):
        one = _read_slice(row["n_words"], row["hashes"], row["stream"])
        tables = []
        for kind, keys, order, _ in one.tables():
            c = np.empty(len(keys), np.float64)
            c[order] = np.concatenate(found[kind]) if found[kind] else np.zeros(0)
            tables.append(c)
        words, bigrams = tables
        n_docs, k = len(one.n_words), max(1, len(one.keys))
        cells, own = np.unique(one.doc * k + one.at, return_counts=True)  # bigrams of a document
        doc, g = np.divmod(cells, k)
        others = bigrams[g] - own
        s = np.where(others > 0, np.maximum(others, 1) / words[one.u[g]], BACKOFF * words[one.v[g]] / total)
        sums = np.bincount(doc, own * np.log(s), n_docs)
        n_bigrams = np.maximum(one.n_words - 1, 0)
        scores = pa.array(sums / np.maximum(n_bigrams, 1), mask=n_bigrams == 0)
        return pa.RecordBatch.from_arrays([row["ids"], pa.array(one.n_words), pa.array(n_bigrams), scores],
                                          ["id", "n_words", "n_bigrams", "score"])

    def run(batches):
        row, found = None, ([], [])
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for i, kind in enumerate(kinds):
                if kind >= 0:
                    found[kind].append(_unpack(batch.column("totals")[i].as_py()))
                    continue
                if row is not None:
                    yield score(row, found)
                found = ([], [])
                row = {"ids": batch.column("ids")[i].values, "n_words": batch.column("n_words")[i].values,
                       "hashes": batch.column("hashes")[i].as_py(), "stream": batch.column("stream")[i].as_py()}
        if row is not None:
            yield score(row, found)
    return run


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   group_keys: int = GROUP_KEYS) -> DataFrame:
    """Per row: id, n_words, n_bigrams, score (mean ln S)."""
    rows = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text"))
    slices = stored(rows.mapInArrow(_stored_slices, _SLICE))
    size = slices.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
                      F.coalesce(F.sum("different"), F.lit(0)).alias("different")).first()
    parts = tuple(max(1, -(-n // group_keys)) for n in (size.different, size.tokens))
    counts = (slices.select("slice", "n_words", "hashes", "stream").mapInArrow(_blocks(parts), _BLOCK)
              .repartition("kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_merged, _COUNTS))
    kept = slices.select("slice", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), "ids", "n_words", "hashes", "stream")
    both = kept.unionByName(counts, allowMissingColumns=True)
    scored = (both.repartition("slice").sortWithinPartitions("slice", "kind", "part")
              .mapInArrow(_scored(max(1, size.tokens)), "id long, n_words long, n_bigrams long, score double"))
    return scored.withColumnRenamed("id", id_col)
