"""Dashboard summaries: histogram, box statistics, correlation matrix, top
categories, a block-level missing-value map, and all of them for columns chosen by class."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT_CONFIG, QualityConfig
from ..functions.columns import col_ref, numbered
from ..functions.missing import is_missing, normalized
from .fill import with_positions
from .gram import pair_correlations
from .profile import column_classes
from .quantile import quantiles
from .vf import value_frequencies


def _values(df: DataFrame, column: str):
    dt = df.schema[column].dataType
    return df.where(~is_missing(column, dt)).select(col_ref(column).cast("double").alias("x"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, lo, hi, count for `bins` equal-width bins over [min, max]; the maximum
    falls in the last bin. Empty bins are listed with count 0."""
    x = _values(df, column)
    mm = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spark = df.sparkSession
    if mm["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    width = (hi - lo) / bins
    b = F.lit(0) if width == 0 else F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))
    counts = x.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("lo"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def box_stats(df: DataFrame, columns: Sequence[str], cfg: QualityConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per column: n, q1, median, q3, iqr, fences (1.5 IQR), whiskers (the most
    extreme values inside the fences) and the number of outliers."""
    k = cfg.thresholds.outlier_iqr_multiplier
    columns = list(dict.fromkeys(columns))
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, fences = [], {}
    for i, c in enumerate(columns):
        q1, med, q3 = quartiles[c]
        if q1 is None:
            continue
        lf, uf = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        fences[c] = (i, q1, med, q3, lf, uf)
        x = normalized(c, df.schema[c].dataType).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(F.when(x >= lf, x)).alias(f"l{i}"), F.max(F.when(x <= uf, x)).alias(f"h{i}"),
                 F.count_if((x < lf) | (x > uf)).alias(f"o{i}")]
    s = df.agg(*aggs).first() if aggs else None  # one aggregate for all columns
    rows = []
    for c in columns:
        if c not in fences:
            rows.append((c, 0, None, None, None, None, None, None, None, None, 0))
            continue
        i, q1, med, q3, lf, uf = fences[c]
        rows.append((c, s[f"n{i}"], q1, med, q3, q3 - q1, lf, uf, s[f"l{i}"], s[f"h{i}"], s[f"o{i}"]))
    return df.sparkSession.createDataFrame(
        rows, "column string, n bigint, q1 double, median double, q3 double, iqr double, "
        "lower_fence double, upper_fence double, whisker_low double, whisker_high double, "
        "n_outliers bigint")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """col_a, col_b, corr: Pearson over rows where both are present, every ordered
    pair; null where a column has no variance. One pass over the rows for all pairs."""
    names = F.array(*map(F.lit, columns))
    return pair_correlations(df, list(columns)).select(
        F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), "corr")


def top_categories(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """value, count: the `k` most frequent non-null values (ties by value)."""
    dt = df.schema[column].dataType
    counts = (df.where(~is_missing(column, dt))
              .groupBy(normalized(column, dt).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    return counts.orderBy(F.desc("count"), F.asc("value")).limit(k)


def missing_map(df: DataFrame, order_by: str, block_rows: int = 1000,
                exclude: Sequence[str] = ()) -> DataFrame:
    """block, column, n_rows, n_missing, missing_share: the missing-value map over
    blocks of `block_rows` consecutive rows (by `order_by`: number, date or timestamp)."""
    cols = [c for c in df.columns if c != order_by and c not in set(exclude)]
    plain, names = numbered(df)
    types = {f.name: f.dataType for f in plain.schema.fields}
    block = F.floor(F.col("_qpos") / block_rows).cast("long").alias("block")
    flags = [is_missing(names[c], types[names[c]]).cast("int").alias(f"_qm{i}") for i, c in enumerate(cols)]
    per = with_positions(plain, names[order_by], flags).groupBy(block).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"_qm{i}").alias(f"_qm{i}") for i in range(len(cols))])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_qm{i}").alias("n_missing"))
                                for i, c in enumerate(cols)]))
    return per.select("block", "n_rows", cells.alias("_qc")).select(
        "block", "_qc.column", "n_rows", "_qc.n_missing",
        (F.col("_qc.n_missing") / F.col("n_rows")).alias("missing_share"))


def missing_cells(df: DataFrame, order_by: str, exclude: Sequence[str] = ()) -> DataFrame:
    """row (the order key), column, missing (0 or 1): the missing-value map cell by cell,
    without a shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if c != order_by and c not in set(exclude)]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), is_missing(c, types[c]).cast("int").alias("missing"))
                                for c in cols]))
    return df.select(col_ref(order_by).alias("row"), cells.alias("_qc")).select("row", "_qc.column", "_qc.missing")


def top_categories_of(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """column, value, count: the `k` most frequent values of each column (ties by value), from one table of value
    frequencies for all columns."""
    order = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
    return (value_frequencies(df, columns).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
            .select("column", "value", F.col("cnt").alias("count")))


@dataclass(frozen=True)
class Dashboard:
    """The tables behind the charts, over columns chosen by their classes; None where no column is of the class."""

    numerical: list[str]
    categorical: list[str]
    histogram: DataFrame | None     # of the chosen (else the first) number column
    box: DataFrame | None           # of all number columns
    correlation: DataFrame | None   # of two number columns or more
    categories: DataFrame | None    # the top values of all category columns


def dashboard(df: DataFrame, order_by: str | None = None, histogram_column: str | None = None,
              cfg: QualityConfig = DEFAULT_CONFIG) -> Dashboard:
    classes = {r["column"]: r["class"] for r in column_classes(df, order_by=order_by, cfg=cfg).orderBy("ord").collect()}
    numbers, categories = ([c for c, kind in classes.items() if kind == name] for name in ("numerical", "categorical"))
    return Dashboard(
        numbers, categories, histogram(df, histogram_column or numbers[0]) if numbers else None,
        box_stats(df, numbers, cfg) if numbers else None, correlation_matrix(df, numbers) if len(numbers) > 1 else None,
        top_categories_of(df, categories) if categories else None)
