"""Per-column metrics shared by profiling, detection and scoring.

`TableStats` runs a handful of Spark jobs, each over the whole table, and keeps
only their small results (one value per column) on the driver:

* one wide aggregate: row count, missing cells, whitespace flags, numeric-looking
  counts, column fingerprints, text bytes (a single pass, no shuffle);
* the value-frequency table, summarised per column (one shuffle of distinct values,
  grouped on native types), and case collisions of text columns;
* the distinct-row count for duplicate detection (one shuffle, map-side combined);
* for columns whose fingerprints collide, one pairwise equality pass.

The results are metrics, bounded by the number of columns, never rows. That is
the only data that reaches the driver.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..config import DEFAULT_CONFIG, QualityConfig
from ..functions import text as tx
from ..functions.columns import col_ref
from ..functions.missing import is_missing, normalized
from ..functions.types import fixed_width, is_atomic, is_string
from .parallel import map_jobs
from .vf import case_collisions, column_value_summary, long_text_summary, stacked_values

log = logging.getLogger(__name__)

SCAN_CHUNK = 96  # columns per metrics aggregate
LONG_TEXT_BYTES = 64  # average bytes from which a text column is summarised by hash first


@dataclass
class ColumnStats:
    name: str
    ord: int
    dtype: T.DataType
    n_missing: int = 0
    n_unique: int = 0
    max_cnt: int = 0
    ws_issue: bool = False
    case_mixed: bool = False
    n_sampled: int = 0          # non-null values the mixed-type share is over
    n_numeric_like: int = 0
    text_bytes: int = 0
    fingerprint: object = None

    @property
    def non_null(self) -> int:
        return self._n_rows - self.n_missing

    _n_rows: int = field(default=0, repr=False)


def profiled_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and is_atomic(f.dataType)]


def comparable_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that take part in whole-row comparison."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip]


class TableStats:
    """Lazily computed metrics of `df`; each group of metrics costs one job."""

    def __init__(self, df: DataFrame, exclude: Sequence[str] = (), order_by: str | None = None,
                 cfg: QualityConfig = DEFAULT_CONFIG):
        self.df = df
        self.cfg = cfg
        self.order_by = order_by
        drop = list(exclude) + ([order_by] if order_by else [])
        self.all_columns = [c for c in df.columns if c not in set(drop)]
        self.columns = profiled_columns(df, drop)
        # arrays, maps, structs, binary: their nulls are counted, their values not profiled
        self.nested = [c for c in self.all_columns if c not in set(self.columns)]
        self._at = {c: i for i, c in enumerate(self.columns + self.nested)}
        self.row_columns = comparable_columns(df, drop)
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.failed: list[str] = []
        # only columns sharing their type with another column can be duplicates
        by_type: dict[str, int] = {}
        for c in self.columns:
            by_type[self.types[c].simpleString()] = by_type.get(self.types[c].simpleString(), 0) + 1
        self._peered = {c for c in self.columns if by_type[self.types[c].simpleString()] > 1}

    def prefetch(self, distinct_rows: bool = True) -> "TableStats":
        """Run the independent metric jobs at the same time, so the scheduler can
        fill every slot (each job alone may have few tasks)."""
        jobs = [lambda: self._vf]  # the value pass reads text lengths from the scan first
        if distinct_rows:
            jobs.append(lambda: self.n_distinct_rows)
        with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
            for f in [pool.submit(j) for j in jobs]:
                try:
                    f.result()
                except Exception as exc:  # retried, and isolated, by the detector that needs it
                    log.warning("metric job failed: %s", exc)
        return self

    # ---- job 1: one wide aggregate --------------------------------------------------------
    @cached_property
    def _scan(self) -> dict:
        # Wide tables are split into column chunks: one aggregate each, run
        # together, so no generated method grows past the JVM's size limits.
        idx = list(range(len(self._at)))
        chunks = [idx[k:k + SCAN_CHUNK] for k in range(0, len(idx), SCAN_CHUNK)] or [[]]
        out: dict = {}
        for part in map_jobs(self._scan_chunk, chunks):
            out.update(part)
        return out

    def _scan_chunk(self, idx: list[int]) -> dict:
        aggs = [F.count(F.lit(1)).alias("__n")]
        names = self.columns + self.nested
        for i in idx:
            c = names[i]
            dt = self.types[c]
            aggs.append(F.count_if(is_missing(c, dt)).alias(f"m{i}"))
            if i >= len(self.columns):
                continue
            if c in self._peered:
                h = F.xxhash64(normalized(c, dt))
                # order-free fingerprint: xor of value hashes, plus a sum of their top
                # 24 bits (cannot overflow below 2^39 rows) so repeated values count
                aggs.append(F.bit_xor(h).alias(f"h{i}"))
                aggs.append(F.sum(F.shiftright(h, 40)).alias(f"g{i}"))
            if is_string(dt):
                v = col_ref(c)
                aggs.append(F.coalesce(F.bool_or(tx.has_whitespace_issue(v)), F.lit(False)).alias(f"w{i}"))
                aggs.append(F.sum(F.octet_length(v)).alias(f"b{i}"))
                if self.cfg.head_rows is None:
                    aggs.append(F.count_if(tx.is_numeric_like(v)).alias(f"d{i}"))
        return self.df.agg(*aggs).first().asDict()

    @property
    def n_rows(self) -> int:
        return int(self._scan["__n"])

    @property
    def n_cols(self) -> int:
        return len(self.all_columns)

    # ---- job 2: value frequencies, summarised per column ----------------------------------
    @cached_property
    def _vf(self) -> dict:
        if not self.columns:
            return {"summary": {}, "case": {}}
        # long texts (by average length from the scan) take the hash-first path
        long_text = [c for c in self.columns if is_string(self.types[c])
                     and self.column(c).text_bytes >= LONG_TEXT_BYTES * max(self.column(c).non_null, 1)]
        rest = [c for c in self.columns if c not in long_text]
        parts = [lambda: column_value_summary(self.df, rest, case_of_text=True).collect()] if rest else []
        if long_text:
            parts.append(lambda: long_text_summary(self.df, long_text).collect())
        rows = [r for part in map_jobs(lambda f: f(), parts) for r in part]
        summary = {r["column"]: (int(r["n_unique"]), int(r["max_cnt"])) for r in rows}
        case = {r["column"]: bool(r["mixed"]) for r in rows if r["mixed"] is not None}
        return {"summary": summary, "case": case}

    # ---- reference sampling rule for case / mixed types: first N non-null by order --------
    @cached_property
    def _head(self) -> dict:
        text_cols = [c for c in self.columns if is_string(self.types[c])]
        n = self.cfg.head_rows
        if not text_cols or n is None:
            return {"case": {}, "numeric": {}}
        if not self.order_by:
            raise ValueError("head_rows needs order_by (a column giving row order)")
        first = head_values(self.df, text_cols, self.order_by, n).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            numeric = {r["column"]: (int(r["n"]), int(r["k"])) for r in first.groupBy("column").agg(
                F.count(F.lit(1)).alias("n"), F.count_if(tx.is_numeric_like(F.col("value"))).alias("k")
            ).collect()}
            case = {r["column"]: bool(r["mixed"]) for r in case_collisions(first).collect()}
        finally:
            first.unpersist()
        return {"case": case, "numeric": numeric}

    # ---- job 3: distinct rows --------------------------------------------------------------
    @cached_property
    def n_distinct_rows(self) -> int:
        return distinct_row_count(self.df, self.row_columns)

    @property
    def n_duplicate_rows(self) -> int:
        return self.n_rows - self.n_distinct_rows if self.n_rows else 0

    # ---- job 4: duplicate columns ----------------------------------------------------------
    @cached_property
    def duplicate_column_groups(self) -> list[list[str]]:
        """Groups [first, copy, ...] of columns equal value-for-value, row by row."""
        by_fp: dict[tuple, list[str]] = {}
        for c in [c for c in self.columns if c in self._peered]:
            key = (self.types[c].simpleString(), self.column(c).fingerprint)
            by_fp.setdefault(key, []).append(c)
        candidates = [g for g in by_fp.values() if len(g) > 1]
        if not candidates:
            return []
        checks = []
        for g in candidates:
            base = g[0]
            for other in g[1:]:
                checks.append((base, other))
        row = self.df.agg(*[
            F.coalesce(F.bool_and(normalized(a, self.types[a]).eqNullSafe(normalized(b, self.types[b]))),
                       F.lit(True)).alias(f"e{i}")
            for i, (a, b) in enumerate(checks)]).first()
        equal = {pair for i, pair in enumerate(checks) if row[f"e{i}"]}
        groups = []
        for g in candidates:
            confirmed = [g[0]] + [c for c in g[1:] if (g[0], c) in equal]
            if len(confirmed) > 1:
                groups.append(confirmed)
        return groups

    # ---- per-column view --------------------------------------------------------------------
    def column(self, name: str) -> ColumnStats:
        i = self._at[name]
        s = self._scan
        cs = ColumnStats(name=name, ord=i, dtype=self.types[name],
                         n_missing=int(s[f"m{i}"]), fingerprint=(s.get(f"h{i}"), s.get(f"g{i}")),
                         _n_rows=self.n_rows)
        if is_string(cs.dtype):
            cs.ws_issue = bool(s[f"w{i}"])
            cs.text_bytes = int(s[f"b{i}"] or 0)
            if self.cfg.head_rows is None:
                cs.n_sampled = cs.non_null
                cs.n_numeric_like = int(s[f"d{i}"])
        return cs

    def n_missing(self, name: str) -> int:
        """Nulls (and NaN) of any column, nested ones too."""
        return int(self._scan[f"m{self._at[name]}"])

    def unique_stats(self, name: str) -> tuple[int, int]:
        return self._vf["summary"].get(name, (0, 0))

    def case_mixed(self, name: str) -> bool:
        if self.cfg.head_rows is None:
            return self._vf["case"].get(name, False)
        return self._head["case"].get(name, False)

    def numeric_share(self, name: str) -> float | None:
        if self.cfg.head_rows is None:
            cs = self.column(name)
            n, k = cs.n_sampled, cs.n_numeric_like
        else:
            n, k = self._head["numeric"].get(name, (0, 0))
        return None if n == 0 else k / n

    def memory_bytes(self) -> int:
        total = 0
        for c in self.columns:
            cs = self.column(c)
            total += cs.text_bytes if is_string(cs.dtype) else fixed_width(cs.dtype) * self.n_rows
        return total


def head_values(df: DataFrame, columns: Sequence[str], order_by: str, n: int) -> DataFrame:
    """The first `n` non-null values of each column by `order_by`.

    `row_number() <= n` over a per-column window is planned with a group limit
    before the shuffle, so each map task sends at most `n` rows per column.
    """
    long = stacked_values(df, columns, order_by)
    w = Window.partitionBy("column").orderBy("_o")
    return long.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def comparable(name: str, dt: T.DataType):
    """A value whose hash is equal for equal cells: null for NaN, maps as sorted entries."""
    if isinstance(dt, T.MapType):
        return F.array_sort(F.map_entries(col_ref(name)))
    if "map<" in dt.simpleString():
        return F.to_json(col_ref(name))
    return normalized(name, dt)


def row_hashes(df: DataFrame, columns: Sequence[str]) -> list:
    """Two xxhash64 columns (`_qh1`, `_qh2`) of the normalised values plus a null mask, so
    (null, 'a') and ('a', null) hash apart. Together they identify a row by 128 bits."""
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = [comparable(c, types[c]) for c in columns]
    masks = []
    for k in range(0, len(vals), 62):
        mask = F.lit(0).cast("long")
        for i, v in enumerate(vals[k:k + 62]):
            mask = mask.bitwiseXOR(F.when(v.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        masks.append(mask)
    return [F.xxhash64(*vals, *masks).alias("_qh1"), F.xxhash64(F.lit(7), *vals, *masks).alias("_qh2")]


def distinct_row_count(df: DataFrame, columns: Sequence[str]) -> int:
    """Number of distinct rows over `columns`, identified by 128-bit hashes, in one job.
    The shuffle carries 16 bytes a row, whatever the width, and copies collapse map-side."""
    if not columns:
        return 1 if df.limit(1).count() else 0
    return df.select(*row_hashes(df, columns)).distinct().count()
