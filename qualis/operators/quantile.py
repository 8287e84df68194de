"""Exact quantiles of many columns at once, without holding a column in one task.

Spark's exact `percentile`/`median` keep a map of every distinct value in the
final (single) task of a global aggregate, which breaks on a high-cardinality
column at scale. Here the k-th smallest value is found by radix selection:

* a double's 64 bits, complemented for negative numbers and with the sign bit set for
  others, are a pattern whose unsigned order is the order of the numbers;
* a pass counts, for all columns and ranks together, the values under each open prefix
  by their next 16 bits: every task adds up its own counts and sends one row per
  (column, prefix, digit); a running sum finds the digit that holds each rank and extends its prefix;
* a rank whose digit holds at most `FINISH_ROWS` values (as many as a pass has digits) is settled by reading them.

Four passes at most, whatever the data and however many columns and ranks there are; the first gives
the number of values too. The driver gets a row per rank and pass. Results are exact, with linear
interpolation between ranks as in `percentile`, numpy's default and DuckDB's `quantile_cont`.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.missing import normalized

BITS = 16
FINISH_ROWS = 1 << BITS
FINISH_TOTAL = 1 << 18  # of all ranks settled at once
_HELD = 1 << 20  # counts a task keeps before it merges them
_TOP = np.uint64(1 << 63)


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles c0, c1, ...; a missing value is null, -0.0 is 0.0."""
    return df.select(*[normalized(c, df.schema[c].dataType).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def patterns(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit patterns in the order of the numbers."""
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def numbers(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, np.uint64)
    return np.where(p & _TOP, p ^ _TOP, ~p).view(np.float64)


_COUNTS = "c int, prefix long, digit int, n long"


def _digits(prefixes: dict[int, list[int]], depth: int):
    """Counts of the digits after each column's prefixes of `depth` digits (one, empty, at depth 0)."""
    shift = np.uint64(64 - BITS * (depth + 1))
    mask = np.uint64((1 << BITS) - 1)

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        size = 0

        def merged(parts):
            digit, n = (np.concatenate(c) for c in zip(*parts))
            found, at = np.unique(digit, return_inverse=True)
            return found, np.bincount(at, n).astype(np.int64)

        for batch in batches:
            for c, own in prefixes.items():
                column = batch.column(c).drop_null()
                if not len(column):
                    continue
                p = patterns(column.to_numpy(zero_copy_only=False))
                head = p >> (shift + np.uint64(BITS)) if depth else None
                for prefix in own:
                    under = p if head is None else p[head == np.uint64(prefix)]
                    digit, n = np.unique((under >> shift) & mask, return_counts=True)
                    if len(digit):
                        held.setdefault((c, prefix), []).append((digit, n))
                        size += len(digit)
            if size > _HELD:
                held = {k: [merged(v)] for k, v in held.items()}
                size = min(_HELD // 2, sum(len(v[0][0]) for v in held.values()))
        for (c, prefix), parts in held.items():
            digit, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), c, np.int32)), pa.array(np.full(len(n), prefix, np.int64)),
                 pa.array(digit.astype(np.int32)), pa.array(n)], ["c", "prefix", "digit", "n"])
    return run


def _placed(counts: DataFrame, ranks: DataFrame) -> list:
    """Per rank (c, prefix, at: its place among the values under the prefix): the digit that holds it, the values below
    that digit, its own, and all under the prefix."""
    order = Window.partitionBy("c", "prefix").orderBy("digit")  # at most 2**BITS rows
    running = (counts.groupBy("c", "prefix", "digit").agg(F.sum("n").alias("n"))
               .withColumn("upto", F.sum("n").over(order)))
    return (running.join(F.broadcast(ranks), ["c", "prefix"])
            .where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
            .select("c", "rank", "digit", (F.col("at") - F.col("upto") + F.col("n")).alias("at"), "n").collect())


def kth_values(df: DataFrame, columns: Sequence[str], wanted: Mapping[int, Sequence[int]] | None = None,
               ranks_of=None) -> tuple[dict[int, int], dict[int, dict[int, float]]]:
    """Per column (by place) the number of its values, and the exact k-th smallest of them for each rank from 0.
    `wanted` gives the ranks, or `ranks_of(n)` those of a column of n values."""
    spark = df.sparkSession
    values = _values(df, columns)
    first = values.mapInArrow(_digits({c: [0] for c in range(len(columns))}, 0), _COUNTS)
    counts = first.groupBy("c", "digit").agg(F.sum("n").alias("n")).collect()  # at most 2**BITS rows a column
    by_column: dict[int, list] = {c: [] for c in range(len(columns))}
    for r in counts:
        by_column[r.c].append((r.digit, r.n))
    totals = {c: sum(n for _, n in rows) for c, rows in by_column.items()}
    # open ranks: (column, rank) -> (prefix, place among its values, values under it)
    pending: dict[tuple[int, int], tuple[int, int, int]] = {}
    for c, rows in by_column.items():
        if not totals[c]:
            continue
        rows.sort()
        ends = np.cumsum([n for _, n in rows])
        for rank in set(ranks_of(totals[c]) if wanted is None else wanted[c]):
            i = int(np.searchsorted(ends, rank, "right"))
            pending[c, rank] = (rows[i][0], rank - int(ends[i]) + rows[i][1], rows[i][1])
    found: dict[int, dict[int, float]] = {c: {} for c in by_column}
    depth = 1
    while pending and depth < 64 // BITS:
        few, total = {}, 0
        for k, v in sorted(pending.items(), key=lambda x: x[1][2]):
            total += v[2]
            if v[2] <= FINISH_ROWS and total <= FINISH_TOTAL:
                few[k] = v
        if few:
            _finish(values, few, depth, found)
            pending = {k: v for k, v in pending.items() if k not in few}
        if not pending:
            break
        prefixes: dict[int, list[int]] = {}
        for (c, _), (prefix, _, _) in pending.items():
            if prefix not in prefixes.setdefault(c, []):
                prefixes[c].append(prefix)
        ranks = spark.createDataFrame([(c, p, rank, at) for (c, rank), (p, at, _) in pending.items()],
                                      "c int, prefix long, rank long, at long")
        rows = _placed(values.mapInArrow(_digits(prefixes, depth), _COUNTS), ranks)
        pending = {(r.c, r["rank"]): (pending[r.c, r["rank"]][0] << BITS | r.digit, r["at"], r.n) for r in rows}
        depth += 1
    for (c, rank), (prefix, _, _) in pending.items():  # all 64 bits
        found[c][rank] = float(numbers(np.array([prefix], np.uint64))[0])
    return totals, found


def _under(ranges: list[tuple[int, int]], depth: int):
    """The patterns of the values under each (column, prefix)."""
    rest = np.uint64(64 - BITS * depth)

    def run(batches):
        for batch in batches:
            for c in {c for c, _ in ranges}:
                p = patterns(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
                head = p >> rest
                for i, (own, prefix) in enumerate(ranges):
                    if own == c and len(under := p[head == np.uint64(prefix)]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(under), i, np.int32)), pa.array(under.view(np.int64))],
                                                         ["i", "p"])
    return run


def _finish(values: DataFrame, few: dict, depth: int, found: dict) -> None:
    """Reads the values under the prefixes of `few` (at most FINISH_TOTAL) and settles their ranks."""
    ranges = sorted({(c, prefix) for (c, _), (prefix, _, _) in few.items()})
    rows = values.mapInArrow(_under(ranges, depth), "i int, p long").toArrow()
    i, p = rows.column("i").to_numpy(), rows.column("p").to_numpy().view(np.uint64)
    by_range = [np.sort(p[i == r]) for r in range(len(ranges))]
    for (c, rank), (prefix, at, _) in few.items():
        found[c][rank] = float(numbers(by_range[ranges.index((c, prefix))][at:at + 1])[0])


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns (NaN and null skipped), all in the same passes."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}

    def ranks(n: int) -> list[int]:
        return [r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]
    totals, kth = kth_values(df, columns, ranks_of=ranks)
    out = {}
    for c, name in enumerate(columns):
        n = totals[c]
        out[name] = [None if n == 0 else _between(kth[c], p * (n - 1)) for p in probs]
    return out


def _between(kth: Mapping[int, float], place: float) -> float:
    low, high = math.floor(place), math.ceil(place)
    d = place - low
    if low == high:
        return kth[low]
    if d == 0.5:
        return (kth[low] + kth[high]) / 2
    return (1 - d) * kth[low] + d * kth[high]


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    return quantiles(df, [column], probs)[column]


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, column, [0.5])[0]
