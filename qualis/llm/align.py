"""Cross-tokenizer alignment: lockstep merging of two tokenisations of the same texts.

Tokenizer A encodes a blank and the text, tokenizer B the text, to which it adds the
blank itself; both give tokens whose bytes, joined, are blank and text. The ends of the
tokens are byte offsets. All documents of a slice are merged at once: a state vector holds
for each of them a pointer into its A and its B tokens. A step emits the link (A token,
B token) at the pointers, emits a cut where both tokens end at the same byte, moves the
pointer of the token that ends first (both at a cut) and compacts finished documents away.
So every pair of overlapping tokens is emitted once, and the cuts are the places where
both tokenizers end a token.

A long text is a lane among many: it is divided beforehand where one of a few A tokens
around every `LANE`-th ends together with a B token (looked up in B's ends); where none
does, the lane goes on. A division is a cut, so lanes are merged like documents.

Counts over all documents: a slice (at most `SLICE_BYTES` of text) stores its documents and its
distinct (A id, B id) pairs with the number of links of each. Only these pairs are
shuffled, summed by pair, and sent back to their slice; a pair that every document holds
is one row a slice. The highest count by B id is one number per id of B's vocabulary.

Defined cases: a null or empty text, and one whose tokens' bytes differ from blank and text,
has no tokens (zeros); rows are aligned one by one, so repeated rows and null ids are rows
of their own; an empty table gives no rows; other columns are not read; a text longer than a
slice is a slice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .text import bounded, ref, texts
from .tokens import json_byte_bpe, piece_bpe, vocabulary

SLICE_BYTES = 2 << 20
LANE = 256
TRIES = 8  # A tokens looked at around every LANE-th for a common end


@dataclass
class Aligned:
    """The merged tokens of a slice, document after document.

    Document d has A tokens a_at[d]:a_at[d + 1] and B tokens b_at[d]:b_at[d + 1]; a_cut and b_cut
    mark tokens that end at a cut; link k joins tokens link_a[k] and link_b[k]."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def documents_of(self, a_tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.a_at, a_tokens, "right") - 1


def _without(ids: np.ndarray, counts: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids and counts with no tokens in the documents `gone`."""
    if not gone.any():
        return ids, counts
    return ids[~np.repeat(gone, counts)], np.where(gone, 0, counts)


def _differing(ids: np.ndarray, counts: np.ndarray, path: str, is_a: bool, values: list[bytes]) -> np.ndarray:
    """Which documents' tokens, joined, are not the document's bytes. Equal lengths are enough
    where all that was encoded is known to come back (A: every byte is a token)."""
    at = np.concatenate(([0], np.cumsum(counts)))
    ends = np.concatenate(([0], np.cumsum(_sizes(path, is_a)[ids])))
    out = np.diff(ends[at]) != np.array([len(v) for v in values], np.int64)
    if not is_a and piece_bpe(path).lossy:
        parts = list(map(piece_bpe(path).pieces.__getitem__, ids.tolist()))
        out = np.array([b"".join(parts[i:j]) != v for i, j, v in zip(at[:-1].tolist(), at[1:].tolist(), values)], bool)
    return out


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_at: np.ndarray, b_at: np.ndarray):
    """Merges all lanes at once: lane l has tokens a_at[l]:a_at[l + 1] and b_at[l]:b_at[l + 1], and ends
    are offsets over all lanes. Returns the links (A tokens, B tokens) and the marks of cuts."""
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    live = a_at[1:] > a_at[:-1]
    i, j, last = a_at[:-1][live], b_at[:-1][live], a_at[1:][live]
    links_a, links_b = [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        x, y = a_ends[i], b_ends[j]
        step_a, step_b = x <= y, y <= x
        both = step_a & step_b
        a_cut[i[both]] = True
        b_cut[j[both]] = True
        i, j = i + step_a, j + step_b
        live = i < last
        if not live.all():
            i, j, last = i[live], j[live], last[live]
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), a_cut, b_cut
    return np.concatenate(links_a), np.concatenate(links_b), a_cut, b_cut


def _lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_at: np.ndarray, b_at: np.ndarray):
    """Starts of the lanes: the documents, divided about every LANE tokens where both end."""
    first = np.arange(LANE, len(a_ends) - TRIES, LANE)
    found = np.zeros(len(first), np.int64)
    at_b = np.zeros(len(first), np.int64)
    for t in range(TRIES):
        end = a_ends[first + t - 1]
        at = np.searchsorted(b_ends, end)
        hit = (found == 0) & (b_ends[np.minimum(at, len(b_ends) - 1)] == end)
        found[hit], at_b[hit] = first[hit] + t, at[hit] + 1
    a = np.concatenate((a_at, found[found > 0]))
    b = np.concatenate((b_at, at_b[found > 0]))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def align_texts(values: list[bytes], a_path: str, b_path: str) -> Aligned:
    """Both tokenisations of UTF-8 texts, merged."""
    bpe_a, bpe_b = json_byte_bpe(a_path), piece_bpe(b_path)
    spaced = [b" " + v if v else b"" for v in values]
    strings = [v.decode("utf-8") for v in spaced]
    a, n_a = bpe_a.encode(strings)
    b, n_b = bpe_b.encode(strings)
    gone = _differing(a, n_a, a_path, True, spaced) | _differing(b, n_b, b_path, False, spaced)
    a, n_a = _without(a, n_a, gone)
    b, n_b = _without(b, n_b, gone)
    a_at, b_at = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
    a_ends, b_ends = (np.cumsum(size[ids]) for size, ids in ((_sizes(a_path, True), a), (_sizes(b_path, False), b)))
    lanes = _lanes(a_ends, b_ends, a_at, b_at) if len(a) else (a_at, b_at)
    link_a, link_b, a_cut, b_cut = lockstep(a_ends, b_ends, *lanes)
    return Aligned(a, b, a_at, b_at, a_cut, b_cut, link_a, link_b)


@cache
def _sizes(path: str, is_a: bool) -> np.ndarray:
    return np.array([len(p) for p in (json_byte_bpe(path) if is_a else piece_bpe(path)).pieces], np.int64)


@cache
def _words(a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A before a comma and before a bar, ids of B before a comma and before a semicolon, as 8 bytes
    that end in zeros, and their lengths."""
    words = [b"%d%c" % (i, mark) for size, marks in ((a_size, b",|"), (b_size, b",;"))
             for mark in marks for i in range(size)]
    return np.array(words, "S8").view(np.uint64), np.array([len(w) for w in words], np.int64)


def group_texts(x: Aligned, a_size: int, b_size: int) -> list[bytes]:
    """Per document its groups as `a1,a2|b1;a3|b2,b3`."""
    a_last, b_last = np.flatnonzero(x.a_cut), np.flatnonzero(x.b_cut)
    groups_a = np.concatenate(([0], np.cumsum(x.a_cut)))[:-1]  # of each token
    groups_b = np.concatenate(([0], np.cumsum(x.b_cut)))[:-1]
    out = np.empty(len(x.a) + len(x.b), np.int64)
    before = np.concatenate(([0], b_last + 1))  # B tokens before a group
    out[np.arange(len(x.a)) + before[groups_a]] = x.a + np.where(x.a_cut, a_size, 0)
    out[np.arange(len(x.b)) + (a_last + 1)[groups_b]] = 2 * a_size + x.b + np.where(x.b_cut, b_size, 0)
    words, sizes = _words(a_size, b_size)
    joined = words[out].tobytes().translate(None, b"\x00")
    at = np.concatenate(([0], np.cumsum(sizes[out])))[x.a_at + x.b_at].tolist()
    return [joined[i:max(i, j - 1)] for i, j in zip(at, at[1:])]


def _list(values, offsets) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _aligned(a_path: str, b_path: str):
    def run(batches):
        for whole in batches:
            for part in bounded(whole, "text", SLICE_BYTES):
                x = align_texts(texts(part.column("text")), a_path, b_path)
                doc = x.documents_of(x.link_a)
                order = np.lexsort((x.link_b, x.link_a))
                link_at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows))))
                cuts = np.flatnonzero(x.a_cut)
                cut_doc = x.documents_of(cuts)
                cut_at = np.concatenate(([0], np.cumsum(np.bincount(cut_doc, minlength=part.num_rows))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), _list(x.a.astype(np.int32), x.a_at), _list(x.b.astype(np.int32), x.b_at),
                     _list((cuts + 1 - x.a_at[cut_doc]).astype(np.int32), cut_at),
                     _list((np.flatnonzero(x.b_cut) + 1 - x.b_at[cut_doc]).astype(np.int32), cut_at),
                     _list((x.link_a - x.a_at[doc])[order].astype(np.int32), link_at),
                     _list((x.link_b - x.b_at[doc])[order].astype(np.int32), link_at)],
                    ["id", "a_ids", "b_ids", "a_cuts", "b_cuts", "links_a", "links_b"])
    return run


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row: id, the ids of both tokenizers, the cuts (numbers of A and of B tokens before each, without
    the one at the start) and the links (numbers of the tokens, from 0), ordered."""
    rows = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text"))
    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_cuts", "b_cuts", "links_a", "links_b"))
    out = rows.mapInArrow(_aligned(*_paths(a_path, b_path)), f"id long, {lists}")
    return out.withColumnRenamed("id", id_col)


_DOC = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")
_SLICE = ("slice long, id array<long>, " + ", ".join(f"{c} array<long>" for c in _DOC)
          + ", groups_sha256 array<string>, pair array<long>, n array<long>, links binary")


def _slices(a_path: str, b_path: str):
    def run(batches):
        a_size, b_size = json_byte_bpe(a_path).size, piece_bpe(b_path).size
        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for part in bounded(whole, "text", SLICE_BYTES):
                x = align_texts(texts(part.column("text")), a_path, b_path)
                n_docs = part.num_rows
                coded = pa.array(x.a[x.link_a].astype(np.int64) * b_size + x.b[x.link_b]).dictionary_encode()
                at, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
                doc = x.documents_of(x.link_a)
                own, k = np.unique(doc * len(keys) + at.astype(np.int64), return_counts=True)
                own_doc, own_pair = np.divmod(own, max(1, len(keys)))
                links = pack.compress(own_pair.astype("<u4").tobytes() + k.astype("<u4").tobytes())
                hashed = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(x, a_size, b_size)]
                numbers = [np.diff(x.a_at), np.diff(x.b_at),
                           np.bincount(x.documents_of(np.flatnonzero(x.a_cut)), minlength=n_docs),
                           np.bincount(doc, minlength=n_docs), np.bincount(own_doc, minlength=n_docs)]
                ids = part.column("id")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), ids),
                     *[_list(v.astype(np.int64), [0, n_docs]) for v in numbers],
                     _list(hashed, [0, n_docs]), _list(keys, [0, len(keys)]),
                     _list(np.bincount(at, minlength=len(keys)).astype(np.int64), [0, len(keys)]), pa.array([links])],
                    ["slice", "id", *_DOC, "groups_sha256", "pair", "n", "links"])
                number += 1
    return run


def _settled(best, b_size: int):
    """A slice's documents with the counts of its pairs."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                pair, place, total = (np.asarray(one.column(c).flatten(), np.int64) for c in ("pair", "places", "totals"))
                count = np.empty(len(pair), np.int64)
                count[place] = total
                raw = np.frombuffer(unpack.decompress(one.column("links")[0].as_py()), "<u4")
                own, k = raw[:len(raw) // 2], raw[len(raw) // 2:].astype(np.int64)
                n_pairs = one.column("n_pairs").flatten().to_numpy()
                doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
                at_best = count == best.value[pair % b_size]

                def summed(values):
                    # integer sums, exact beyond 2**53
                    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(n_pairs)))])
                assert len(doc) == len(own)
                yield pa.RecordBatch.from_arrays(
                    [one.column("id").flatten(), *[one.column(c).flatten() for c in _DOC[:4]],
                     pa.array(summed(k * at_best[own])), pa.array(summed(k * count[own])),
                     one.column("groups_sha256").flatten()],
                    ["id", *_DOC[:4], "n_best", "count_sum", "groups_sha256"])
    return run


def alignment_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best (links of the id pair that, over all documents, links
    their B id most often), count_sum (over its links, the number of links of the same id pair anywhere)
    and groups_sha256 (of `group_texts`)."""
    a_path, b_path = _paths(a_path, b_path)
    b_size = piece_bpe(b_path).size
    rows = docs.select(ref(id_col).cast("long").alias("id"), ref(text_col).alias("text"))
    slices = stored(rows.mapInArrow(_slices(a_path, b_path), _SLICE))
    pairs = slices.select("slice", F.posexplode(F.arrays_zip("pair", "n")).alias("place", "p")) \
        .select("slice", "place", "p.pair", "p.n")
    counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("total")))
    best = np.zeros(b_size, np.int64)
    for r in counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("total").alias("m")).collect():
        best[r.b] = r.m  # one row per id of the vocabulary at most
    back = (pairs.select("slice", "place", "pair").join(counts, "pair").groupBy("slice")
            .agg(F.collect_list("place").alias("places"), F.collect_list("total").alias("totals")))  # one slice's pairs
    joined = slices.select("slice", "id", *_DOC, "groups_sha256", "pair", "links").join(back, "slice", "left")
    empty = F.array().cast("array<long>")
    ready = joined.withColumn("places", F.coalesce(F.col("places").cast("array<long>"), empty)) \
        .withColumn("totals", F.coalesce("totals", empty)).drop("slice")
    schema = "id long, " + ", ".join(f"{c} long" for c in (*_DOC[:4], "n_best", "count_sum")) + ", groups_sha256 string"
    out = ready.mapInArrow(_settled(docs.sparkSession.sparkContext.broadcast(best), b_size), schema)
    return out.withColumnRenamed("id", id_col)
