"""Profiling: dataset metadata, column classes, date-like test, column details,
preview and first-seen samples."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..config import DEFAULT_CONFIG, ID_TOKENS_NUMERIC, ID_TOKENS_TEXT, QualityConfig
from ..functions.columns import col_ref
from ..functions.dates import parse_date_mixed
from ..functions.missing import normalized
from ..functions.types import friendly_type, is_datetime, is_number, is_string
from .stats import TableStats, head_values
from .vf import value_frequencies


def _order_or_file_order(df: DataFrame, order_by: str | None) -> tuple[DataFrame, str]:
    if order_by:
        return df, order_by
    # file order: partition id in the high bits, row within partition below
    name = "_rid"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, F.monotonically_increasing_id()), name


def input_file_bytes(df: DataFrame) -> int:
    """Bytes of the files a file-source DataFrame reads (from `_metadata`)."""
    meta = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
    return int(meta.distinct().agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0])


def dtype_summary(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema.fields:
        if f.name not in set(exclude):
            label = friendly_type(f.dataType)
            out[label] = out.get(label, 0) + 1
    return out


def dataset_meta(df: DataFrame, exclude: Sequence[str] = (), order_by: str | None = None,
                 file_size_bytes: int | None = None, stats: TableStats | None = None) -> DataFrame:
    """One row: n_rows, n_cols, memory_usage_mb (estimate), file_size_mb, missing_pct,
    duplicate_pct, dtypes_summary, column_names, missing_level, duplicate_level."""
    st = stats or TableStats(df, exclude=exclude, order_by=order_by)
    if stats is None:
        with ThreadPoolExecutor(max_workers=2) as pool:
            jobs = [pool.submit(lambda: st._scan), pool.submit(lambda: st.n_distinct_rows)]
            for j in jobs:
                j.result()
    n, k = st.n_rows, st.n_cols
    missing = sum(map(st.n_missing, st.all_columns))
    missing_pct = round(missing / max(n * k, 1) * 100, 2)
    dup_pct = round(st.n_duplicate_rows / max(n, 1) * 100, 2)
    row = (n, k, round(st.memory_bytes() / 1024 ** 2, 3),
           None if file_size_bytes is None else round(file_size_bytes / 1024 ** 2, 3),
           missing_pct, dup_pct, dtype_summary(df, list(exclude) + ([order_by] if order_by else [])),
           st.all_columns, "Low" if missing_pct < 5 else "High", "Low" if dup_pct < 2 else "High")
    schema = T.StructType([
        T.StructField("n_rows", T.LongType()), T.StructField("n_cols", T.IntegerType()),
        T.StructField("memory_usage_mb", T.DoubleType()), T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("missing_pct", T.DoubleType()), T.StructField("duplicate_pct", T.DoubleType()),
        T.StructField("dtypes_summary", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("column_names", T.ArrayType(T.StringType())),
        T.StructField("missing_level", T.StringType()), T.StructField("duplicate_level", T.StringType()),
    ])
    return df.sparkSession.createDataFrame([row], schema)


def date_like_columns(df: DataFrame, columns: Sequence[str] | None = None,
                      order_by: str | None = None, cfg: QualityConfig = DEFAULT_CONFIG) -> DataFrame:
    """column, n_sampled, n_parsed, parsed_share, date_like: over the first 30
    non-null values of each text column by row order. A column without values has
    n_sampled 0, no share, and is not date-like."""
    t = cfg.thresholds
    base, order = _order_or_file_order(df, order_by)
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if is_string(f.dataType) and f.name != order_by]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, n_sampled bigint, n_parsed bigint, parsed_share double, date_like boolean")
    first = head_values(base, cols, order, t.date_sample_rows)
    found = first.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_sampled"),
        F.count_if(parse_date_mixed(F.col("value")).isNotNull()).alias("n_parsed"))
    share = F.try_divide("n_parsed", "n_sampled")
    return (_per_column(df, cols, found).na.fill(0, ["n_sampled", "n_parsed"])
            .select("column", "n_sampled", "n_parsed", share.alias("parsed_share"),
                    F.coalesce(share > t.date_like_share, F.lit(False)).alias("date_like")))


def _per_column(df: DataFrame, cols: Sequence[str], found: DataFrame) -> DataFrame:
    """`found` (at most one row per column) with a row for every column of `cols`."""
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found, "column", "left")


def column_classes(df: DataFrame, exclude: Sequence[str] = (), order_by: str | None = None,
                   cfg: QualityConfig = DEFAULT_CONFIG, stats: TableStats | None = None) -> DataFrame:
    """column, ord, dtype, class in {numerical, categorical, datetime, id_like, boolean}."""
    st = stats or TableStats(df, exclude=exclude, order_by=order_by, cfg=cfg)
    text_cols = [c for c in st.columns if is_string(st.types[c])]
    dates = ({r["column"]: bool(r["date_like"]) for r in
              date_like_columns(df, text_cols, order_by, cfg).collect()} if text_cols else {})
    n = max(st.n_rows, 1)
    rows = []
    for i, c in enumerate(st.columns):
        dt = st.types[c]
        lower = c.lower()
        if is_datetime(dt):
            cls = "datetime"
        elif isinstance(dt, T.BooleanType):
            cls = "boolean"
        elif is_number(dt):
            ratio = st.unique_stats(c)[0] / n
            idn = any(tok in lower for tok in ID_TOKENS_NUMERIC)
            cls = "id_like" if idn and ratio > cfg.thresholds.id_unique_ratio else "numerical"
        elif dates.get(c, False):
            cls = "datetime"
        else:
            ratio = st.unique_stats(c)[0] / n
            idn = any(tok in lower for tok in ID_TOKENS_TEXT)
            cls = "id_like" if idn and ratio > cfg.thresholds.id_unique_ratio else "categorical"
        rows.append((c, i, dt.simpleString(), cls))
    return df.sparkSession.createDataFrame(rows, "column string, ord int, dtype string, class string")


def column_profile(df: DataFrame, exclude: Sequence[str] = (), order_by: str | None = None,
                   stats: TableStats | None = None) -> DataFrame:
    """column, ord, dtype, friendly_type, non_null, missing, n_unique; nested columns
    come last and without n_unique."""
    st = stats or TableStats(df, exclude=exclude, order_by=order_by)
    rows = []
    for i, c in enumerate(st.columns):
        cs = st.column(c)
        rows.append((c, i, cs.dtype.simpleString(), friendly_type(cs.dtype), cs.non_null,
                     cs.n_missing, st.unique_stats(c)[0]))
    for i, c in enumerate(st.nested, len(rows)):
        rows.append((c, i, st.types[c].simpleString(), friendly_type(st.types[c]),
                     st.n_rows - st.n_missing(c), st.n_missing(c), None))
    return df.sparkSession.createDataFrame(
        rows, "column string, ord int, dtype string, friendly_type string, non_null bigint, "
              "missing bigint, n_unique bigint")


def preview(df: DataFrame, order_by: str, n: int = 50) -> DataFrame:
    """The first `n` rows by `order_by` (a per-task top-n, then a merge of those)."""
    return df.orderBy(col_ref(order_by)).limit(n)


PREFIX_ROWS = 1000


def profile_samples(df: DataFrame, exclude: Sequence[str] = (), order_by: str | None = None,
                    k: int = 3) -> DataFrame:
    """column, samples: the first `k` distinct non-null values by first appearance (ties by value; rows
    without a key come first); a column without values has an empty list.

    Most columns show `k` values within the first rows: the values of the rows up to the `PREFIX_ROWS`-th key. For
    the columns that do not, each further aggregate over the table finds the next value of all of them,
    the one with the least (key, value) that is not among those found; at most `k` of them, and no value is
    shuffled.
    """
    base, order = _order_or_file_order(df, order_by)
    skip = set(exclude) | ({order} if order_by else set())
    cols = [f.name for f in df.schema.fields if f.name not in skip
            and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    schema = "column string, samples array<string>"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    types = {f.name: f.dataType for f in df.schema.fields}
    o = col_ref(order)
    last = base.select(o.alias("o")).where("o IS NOT NULL").orderBy("o").limit(PREFIX_ROWS).agg(F.max("o")).first()[0]
    first = base if last is None else base.where(o.isNull() | (o <= F.lit(last)))
    first = first.select(F.struct(o.alias("k")).alias("_qo"), *map(col_ref, cols))  # a struct: nulls are the least
    w = Window.partitionBy("column").orderBy("first_o", "value")
    seen = (value_frequencies(first, cols, "_qo").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
            .groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_k", "value"))).alias("s")))
    found = {c: [] for c in cols} | {r["column"]: [x["value"] for x in r["s"]] for r in seen.collect()}
    left = [c for c in cols if len(found[c]) < k] if last is not None else []
    while left:
        aggs = []
        for i, c in enumerate(left):
            v = normalized(c, types[c]).cast("string")
            new = v.isNotNull() & ~v.isin(found[c]) if found[c] else v.isNotNull()
            aggs.append(F.min(F.when(new, F.struct(o.alias("o"), v.alias("v"))))["v"].alias(f"v{i}"))
        row = base.agg(*aggs).first()
        for i, c in enumerate(left):
            if row[f"v{i}"] is not None:
                found[c].append(row[f"v{i}"])
        left = [c for i, c in enumerate(left) if row[f"v{i}"] is not None and len(found[c]) < k]
    return df.sparkSession.createDataFrame(list(found.items()), schema)
