"""License scan by diagonal voting.

A text is cut into words once: they are counted, numbered by the templates' vocabulary, and
the stretches around template k-grams are kept. Every rolling k-gram of a stretch is hashed and
joined to the k-gram hashes of the license templates (a fixed table of a few hundred rows, so
broadcast); elsewhere in a text no k-gram can have a partner. A match at
document word p and template word t votes for the diagonal p - t. Each voted diagonal is
verified: the document's words along it are compared with the template's, word by word.
Neighbouring diagonals of one template (words put in or left out) are merged, and the
share of template words verified in the merged span is the template's coverage.

`PHRASES` are the base labels: a phrase counts wherever all its words stand. `TEMPLATES`
add labels when at least MIN_COVERED of their words are verified in one span. Sibling
templates differ by a word or two, so of spans that lie on the same words only the one with
the most verified words counts (ties: the fewest others; equal ones all count).

Defined cases: a null or empty text has no words and no labels; repeated rows (equal id
and text) get equal rows; a null id is kept; an empty table gives no rows; other columns
are not read. Counts and stretches are stored in the checkpoint folder; the rest is DataFrame functions.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .text import folded_words, in_slices, ref, texts as texts_of

K = 3
MAX_SHIFT = 3        # words; diagonals closer than this belong to one span
MIN_COVERED = 0.75
MIN_WORDS = 6
CUT = "k long, rk long, id long, n_words long, stretches array<struct<start int, w array<int>>>"

# --- Fixed values: phrases and the labels they stand for. ---
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# First words of public license texts and notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
             "lesser general public license as published by the free software foundation"),
    ("lgpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "lesser general public license as published by the free software foundation"),
    ("lgpl", "this work is licensed under the gnu lesser general public license version 3"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
            "was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non commercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
# --- End of fixed values. ---


def _gram_hashes(words: Column) -> Column:
    """Hash of the k words from each position on."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - K),
                        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)]))
    return F.when(F.size(words) >= K, grams)


def template_rows(phrases=None, texts=None) -> tuple[list[tuple], dict[str, int]]:
    """Rows of (t, base, label, words as numbers), and the numbers (from 1) of the words."""
    rows = [(base, label, text.split()) for base, table in
            ((True, PHRASES if phrases is None else phrases), (False, TEMPLATES if texts is None else texts))
            for label, text in table]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(w for *_, words in rows for w in words), 1)}
    return [(t, base, label, [numbers[w] for w in words]) for t, (base, label, words) in enumerate(rows)], numbers


def _windows(numbers: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(numbers, K) if len(numbers) >= K else np.zeros((0, K), np.int64)


def _stretches(rows: list[tuple], numbers: dict[str, int]):
    """A `mapInArrow` function from (k, rk, id, text) to `CUT`: words counted, and those less than a template's
    length from a template k-gram, as numbers (0: in no template). All diagonals through the k-gram lie there."""
    number = {w.encode(): i for w, i in numbers.items()}
    powers = (len(numbers) + 1) ** np.arange(K)
    grams = np.array([g for *_, words in rows for g in _windows(np.array(words, np.int64)) @ powers], np.int64)
    reach = max((len(words) for *_, words in rows), default=0)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [folded_words(text) for text in texts_of(batch.column(3))]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        found = np.fromiter(map(number.get, chain.from_iterable(words), repeat(0)), np.int64, sizes.sum())
        windows = _windows(found)
        at = np.flatnonzero(windows.all(axis=1))
        at = at[np.isin(windows[at] @ powers, grams)]
        row = np.searchsorted(ends, at, side="right")
        inside = at + K <= ends[row]
        at, row = at[inside], row[inside]
        start, stop = np.maximum(at - reach, (ends - sizes)[row]), np.minimum(at + reach, ends[row])
        new = np.append(True, start[1:] >= stop[:-1])[:len(at)]
        start, stop, row = start[new], stop[np.append(new[1:], True)[:len(at)]], row[new]
        parts = [found[a:b] for a, b in zip(start, stop)]
        numbered = pa.ListArray.from_arrays(np.append(0, np.cumsum(stop - start)).astype(np.int32),
                                            pa.array(np.concatenate([found[:0], *parts]).astype(np.int32)))
        each = pa.StructArray.from_arrays([pa.array((start - (ends - sizes)[row]).astype(np.int32)), numbered],
                                          ["start", "w"])
        lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32), each)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes), lists],
                                          ["k", "rk", "id", "n_words", "stretches"])
    return in_slices(cut, 3)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases=None, texts=None) -> DataFrame:
    """Per row: id, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start), base_labels, labels, score (greatest coverage)."""
    template, numbers = template_rows(phrases, texts)
    table = docs.sparkSession.createDataFrame(template, "t int, base boolean, label string, words array<int>")
    grams = table.select("t", F.col("words").alias("tw"), F.posexplode(_gram_hashes(F.col("words"))).alias("tp", "h"))
    id_ = ref(id_col).cast("long")
    rows = stored(docs.select(F.coalesce(id_, F.lit(-1 << 63)).alias("k"), F.xxhash64(id_, ref(text_col)).alias("rk"),
                              id_.alias("id"), ref(text_col).alias("text"))
                  .mapInArrow(_stretches(template, numbers), CUT))
    votes = (rows.select("k", "rk", F.explode("stretches").alias("s")).select("k", "rk", "s.start", "s.w")
             .select("k", "rk", "start", "w", F.posexplode(_gram_hashes(F.col("w"))).alias("p", "h"))
             .join(F.broadcast(grams), "h")
             .withColumn("diagonal", F.col("start") + F.col("p") - F.col("tp"))
             .select("k", "rk", "t", "tw", "diagonal",
                     F.slice("w", F.greatest(F.col("diagonal"), F.lit(0)) - F.col("start") + 1,
                             F.size("tw") + F.least(F.col("diagonal"), F.lit(0))).alias("dw")))
    diagonals = votes.groupBy("k", "rk", "t", "diagonal").agg(F.first("tw").alias("tw"), F.first("dw").alias("dw"))
    skip = F.greatest(-F.col("diagonal"), F.lit(0))
    verified = F.filter(F.sequence(F.lit(0), F.size("tw") - 1),
                        lambda i: (i >= skip) & F.get("tw", i).eqNullSafe(F.get("dw", i - skip)))
    order = Window.partitionBy("k", "rk", "t").orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > MAX_SHIFT).cast("int")
    spans = (diagonals.select("k", "rk", "t", "diagonal", F.size("tw").alias("m"), verified.alias("at"),
                              starts.alias("new"))
             .withColumn("span", F.sum("new").over(order)))
    words_at = spans.withColumn("tp", F.explode("at"))
    spans = (words_at.groupBy("k", "rk", "t", "span", "m").agg(
        F.count_distinct("tp").alias("n"), (F.min(F.col("tp") + F.col("diagonal"))
                                            + F.max(F.col("tp") + F.col("diagonal"))).alias("middle"),
        F.array_sort(F.collect_set(F.when(F.size("at") == F.col("m"), F.col("diagonal")))).alias("exact")))
    labelled = spans.join(F.broadcast(table.select("t", "base", "label")), "t")
    is_base = F.col("base") & (F.size("exact") > 0)
    added = ~F.col("base") & (F.col("n") >= MIN_COVERED * F.col("m")) & (F.col("n") >= MIN_WORDS)
    # spans of at least MIN_WORDS words whose middles (doubled) are less than that apart overlap
    near = Window.partitionBy("k", "rk").orderBy("middle").rangeBetween(1 - 2 * MIN_WORDS, 2 * MIN_WORDS - 1)
    rank = F.struct(F.col("n"), F.col("n") - F.col("m"))
    labelled = (labelled.where(is_base | added).withColumn("best", F.max(F.when(added, rank)).over(near))
                .withColumn("is_best", ~F.col("base") & (rank == F.col("best"))))
    added = F.col("is_best")
    found = labelled.groupBy("k", "rk").agg(
        F.sum(F.when(is_base, F.size("exact"))).alias("n_base"),
        F.min(F.when(is_base, F.array_min("exact"))).alias("first_word"),
        F.max(F.when(is_base, F.array_max("exact"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base | added, F.col("label")))), ",").alias("labels"),
        F.max(F.when(is_base, F.lit(1.0)).when(added, F.col("n") / F.col("m"))).alias("score"))
    return rows.select("k", "rk", "id", "n_words").join(found, ["k", "rk"], "left").select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
