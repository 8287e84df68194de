"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to words and cut into windows of
`window` words (a shorter item is one window). All windows, as " w1 w2 ... ", go
into one automaton; every document is normalised the same way and scanned once.
Word positions in the normalised text give the hit words, and the original
text's word matches give their character offsets.

The windows are broadcast: their size is checked first. Benchmarks of more than
`max_bytes` are split by item into parts within the bound, each scanned with an
automaton of its own, and the parts' hits are united per document.

Defined cases: a null or blank text has no words and no hits; a null or blank item
has no window; an item id that is null counts as "null"; an item repeated counts
once per id; an empty benchmark hits nothing; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import folded_words, in_slices, map_whole, ref, texts

WINDOW = 10
MAX_BYTES = 16 << 20
_SPAN = "struct<first_word:long,end_word:long,char_start:long,char_end:long>"
SCHEMA = f"id long, th long, n_words long, items array<string>, spans array<{_SPAN}>"
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # as text.WORD, before A-Z are lowered
_automata: dict[str, ahocorasick.Automaton] = {}


def windows_of(text: bytes, window: int = WINDOW) -> set[bytes]:
    words = folded_words(text)
    n = max(1, len(words) - window + 1) if words else 0
    return {b" ".join(words[i:i + window]) for i in range(n)}


def _patterns(items: list, window: int) -> list[tuple[str, int, tuple[str, ...]]]:
    """(pattern, words, item ids) of all windows."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of((text or "").encode(), window):
            found.setdefault(w, set()).add("null" if item is None else str(item))
    return [(f" {w.decode('latin-1')} ", w.count(b" ") + 1, tuple(sorted(i))) for w, i in found.items()]


def _automaton(key: str, patterns: list) -> ahocorasick.Automaton:
    """Built once per Python worker."""
    if key not in _automata:
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (pattern, _, _) in enumerate(patterns):
            made.add_word(pattern, i)
        if patterns:
            made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def scan(text: bytes, automaton: ahocorasick.Automaton, patterns: list) -> tuple[int, list[str], list[tuple]]:
    """Number of words, item ids hit, and the united hit spans of one text."""
    words = folded_words(text)
    if not words or not patterns:
        return len(words), [], []
    line = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(line.decode("latin-1")))
    if not hits:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in hits])  # a match ends at the space after its last word
    items, spans = set(), []
    for end, (_, i) in zip(ends.tolist(), hits):
        items.update(patterns[i][2])
        spans.append((end - patterns[i][1], end))
    return len(words), sorted(items), _union(spans)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _with_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """The spans with the characters they take in the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORDS.finditer(text.decode("utf-8"))]
    return [{"first_word": a, "end_word": b, "char_start": at[a][0], "char_end": at[b - 1][1]} for a, b in spans]


def _parts(bench: DataFrame, item_col: str, text_col: str, max_bytes: int, window: int):
    """Broadcast pattern lists within the bound."""
    sc = bench.sparkSession.sparkContext
    items = bench.select(ref(item_col).alias("i"), ref(text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size * window // max_bytes) + 1  # every word is in up to `window` windows
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sc.broadcast(_patterns([tuple(r) for r in part.collect()], window))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items (ids, sorted as strings), spans, contaminated."""
    rows = docs.select(ref(id_col).cast("long").alias("id"), F.xxhash64(ref(text_col)).alias("th"),
                       ref(text_col).alias("text"))
    scans = []
    for patterns in _parts(bench, item_col, item_text_col, max_bytes, window):
        scans.append(rows.mapInArrow(in_slices(_scanner(patterns, uuid.uuid4().hex), "text"), SCHEMA))
    out = scans[0] if len(scans) == 1 else _united(scans)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"), "items", "spans",
                      (F.size("spans") > 0).alias("contaminated"))


def _scanner(patterns, key: str):
    span = pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "char_start", "char_end")])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(key, patterns.value)
        found = [(t, *scan(t, automaton, patterns.value)) for t in texts(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], pa.list_(pa.string())),
             pa.array([_with_offsets(f[0], f[3]) for f in found], pa.list_(span))],
            ["id", "th", "n_words", "items", "spans"])
    return run


def _united(scans: list[DataFrame]) -> DataFrame:
    """The hits of several automata, per document (rows that repeat a document stay)."""
    rows = scans[0]
    for other in scans[1:]:
        rows = rows.unionByName(other)

    def grow(out, s):
        last = F.try_element_at(out, F.lit(-1))
        merged = F.struct(last["first_word"].alias("first_word"),
                          F.greatest(last["end_word"], s["end_word"]).alias("end_word"),
                          last["char_start"].alias("char_start"),
                          F.greatest(last["char_end"], s["char_end"]).alias("char_end"))
        return F.when(s["first_word"] <= last["end_word"],
                      F.concat(F.slice(out, 1, F.size(out) - 1), F.array(merged))) \
            .otherwise(F.concat(out, F.array(s)))

    grouped = rows.groupBy("id", "th").agg(
        (F.count("*") / len(scans)).cast("int").alias("copies"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    spans = F.aggregate("spans", F.array().cast(f"array<{_SPAN}>"), grow)
    return (grouped.withColumn("spans", spans)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy"))


def clean_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", window: int = WINDOW,
                    max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents that no window occurs in, with all their columns."""
    at = docs.columns.index(text_col)
    for patterns in _parts(bench, item_col, item_text_col, max_bytes, window):
        docs = map_whole(docs, in_slices(_filter(patterns, uuid.uuid4().hex, at), at))
    return docs


def _filter(patterns, key: str, at: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(key, patterns.value)
        return batch.filter(pa.array([not scan(t, automaton, patterns.value)[2]
                                      for t in texts(batch.column(at))]))
    return run
