"""Row order for order-dependent steps.

A DataFrame has no row order. `with_row_id` adds one from the read: the
partition id in the high bits and the row number within the partition below
(`monotonically_increasing_id`), which follows file order for a file scan.

`read_parquet_ordered` and `read_lines_ordered` number rows 0, 1, 2, ... by file path and place in the
file, however the files are split. Neither the paths nor the rows pass through the driver or one task:
the files (or pieces of files) are counted, ranged by path, and numbered by prefix sums: a sum within each
range, and one over the ranges' totals (a row per range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import col_ref
from ..session import stored

BROADCAST_FILES = 1_000_000  # offsets (24 bytes each) joined by broadcast up to so many files


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def _offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and n, with `before`: the sum of n over all rows with smaller keys."""
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counts.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("total"))  # a row per range
    above = totals.select("range", F.coalesce(F.sum("total").over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    placed = ranged.withColumn("here", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.join(F.broadcast(above), "range").select(*keys, "n", (F.col("above") + F.col("here")).alias("before"))


def _path_key(path: Column) -> list[Column]:
    return [F.xxhash64(path).alias("p1"), F.xxhash64(F.lit(7), path).alias("p2")]


def _numbered_rows(rows: DataFrame, offsets: DataFrame, keys: list[str], place: Column, name: str, kept: list[str]) -> DataFrame:
    """Rows (c0, ... and what `keys` and `place` need) with their number."""
    small = offsets.select(*keys, "before")
    if small.count() <= BROADCAST_FILES:
        small = F.broadcast(small)
    out = rows.join(small, keys).withColumn("number", F.col("before") + place)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("number").alias(name))


def read_parquet_ordered(spark: SparkSession, path: str, name: str = "_rid") -> DataFrame:
    """Parquet read with a row number by (path, row in the file)."""
    df = spark.read.parquet(path)
    kept = [c for c in df.columns if c != name]
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")]
    # reads no column; one row per file and task is shuffled
    counts = df.select(*where).groupBy("path").agg((F.max("row") + 1).alias("n"))
    offsets = stored(_offsets(counts, ["path"]).select(*_path_key(F.col("path")), "n", "before"))
    at = len(kept)
    # by place: the table may have columns called path or row
    columns = df.select(*[col_ref(c).alias(f"c{i}") for i, c in enumerate(kept)],
                        *[w.alias(f"c{at + i}") for i, w in enumerate(where)])
    rows = columns.withColumns({"p1": _path_key(F.col(f"c{at}"))[0], "p2": _path_key(F.col(f"c{at}"))[1]})
    return _numbered_rows(rows, offsets, ["p1", "p2"], F.col(f"c{at + 1}"), name, kept)


def read_lines_ordered(spark: SparkSession, path: str, name: str = "_rid") -> DataFrame:
    """Text lines (value) with a line number by (path, place in the file). A piece of a file is read in order by one
    task; lines are stored once with their place in the piece, the pieces are numbered by their lines."""
    text = spark.read.text(path)
    lines = stored(text.select(F.col("value").alias("c0"), F.col("_metadata.file_path").alias("path"),
                               F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")))
    counts = lines.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    offsets = _offsets(counts.select("path", "start", "n"), ["path", "start"])
    # a piece's offset less its first id, so that a line's number is a sum
    pieces = stored(offsets.join(counts.select("path", "start", "first"), ["path", "start"]).select(
        *_path_key(F.col("path")), "start", "n", (F.col("before") - F.col("first")).alias("before")))
    rows = lines.withColumns({"p1": _path_key(F.col("path"))[0], "p2": _path_key(F.col("path"))[1]})
    return _numbered_rows(rows, pieces, ["p1", "p2", "start"], F.col("id"), name, ["value"])
