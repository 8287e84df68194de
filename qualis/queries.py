"""Registered queries: `(spark, sf_dir) -> DataFrame`, each with DuckDB oracle SQL.

Every query reads the given tables, or views Spark derives from them (see
`fixtures`), in full. Array and map outputs are flattened to text so both
engines print the same values; computed doubles are rounded alike on both sides.
"""

from __future__ import annotations

import os
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracle as O
from .fixtures import BASE_TABLES, VIEWS, table
from .operators import audit, checks, clean, detect, fill, profile, score, summary
from .plans import CleaningPlan, review_progress
from .session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
ORDER = "rid"


def _issue_flat(df: DataFrame) -> DataFrame:
    return df.select("position", "issue_id", "category", "title", "severity",
                     F.array_join("affected_columns", ",").alias("affected_columns"),
                     F.round("affected_ratio", 9).alias("affected_ratio"), "recommended_method",
                     F.array_join("alternative_methods", ",").alias("alternative_methods"))


def _order(view: str) -> str | None:
    return ORDER if view in VIEWS else None


def _issues(view: str, detector=None, issue_id: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, view)
        out = (detect.detect_all(df, order_by=_order(view)) if detector is None
               else detect.detect_one(df, detector, order_by=_order(view)))
        out = _issue_flat(out)
        return out.where(F.col("issue_id") == issue_id) if issue_id else out
    return run


def _issues_head(view: str, head: int) -> Query:
    """All issues with the first-`head`-values rule for the case and mixed-type checks."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .config import QualityConfig
        out = detect.detect_all(table(spark, sf_dir, view), order_by=ORDER,
                                cfg=QualityConfig(head_rows=head))
        return _issue_flat(out)
    return run


def _score(view: str) -> Query:
    def run(spark, sf_dir):
        iss = detect.detect_all(table(spark, sf_dir, view), order_by=_order(view))
        return score.quality_score(iss).select("score", "label",
                                               F.col("points_lost").cast("double").alias("points_lost"))
    return run


def _breakdown(view: str) -> Query:
    def run(spark, sf_dir):
        iss = detect.detect_all(table(spark, sf_dir, view), order_by=ORDER)
        return score.quality_breakdown(iss).select(
            "category", F.col("points_lost").cast("double").alias("points_lost"))
    return run


def _meta(view: str) -> Query:
    def run(spark, sf_dir):
        m = profile.dataset_meta(table(spark, sf_dir, view), order_by=ORDER)
        return m.select("n_rows", "n_cols", "missing_pct", "duplicate_pct", "memory_usage_mb",
                        F.array_join(F.array_sort(F.transform(
                            F.map_entries("dtypes_summary"),
                            lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
                        .alias("dtypes_summary"),
                        F.array_join("column_names", ",").alias("column_names"),
                        "missing_level", "duplicate_level")
    return run


def _clean(view: str, method: str, columns, round_cols=(), digits: int = 9) -> Query:
    def run(spark, sf_dir):
        out = clean.apply_method(table(spark, sf_dir, view), method, columns, order_by=ORDER)
        return out.select(*[F.round(c, digits).alias(c) if c in round_cols else F.col(c)
                            for c in out.columns])
    return run


def _flagship_plan(df: DataFrame) -> CleaningPlan:
    """Accept every detected issue's recommended fix, in issue order."""
    plan = CleaningPlan(df, order_by=ORDER, auto_checkpoint=True)
    for row in detect.detect_all(df, order_by=ORDER).orderBy("position").collect():
        plan.accept(row.asDict(recursive=True))
    return plan


def cleaning_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _flagship_plan(table(spark, sf_dir, "dirty_events")).current()
    return out.select(*[F.round(c, 12).alias(c) if c.endswith("_freq_enc") else F.col(c)
                        for c in out.columns])


def cleaning_plan_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship_plan(table(spark, sf_dir, "dirty_lineitem")).current()


# The fixes applied, in order, in the interactive tool's run log on its customer file.
CRM_STEPS = [
    ("fill_median", ["Age", "Salary"]),
    ("drop_duplicate_rows", []),
    ("drop_duplicate_columns", ["CustomerID_Copy"]),
    ("drop_columns", ["Region"]),
    ("frequency_encoding", ["JoinDate"]),
    ("trim_spaces", ["Name", "City"]),
    ("title_case", ["Name", "City", "IsActive"]),
]


def crm_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = CleaningPlan(table(spark, sf_dir, "crm"), order_by=ORDER)
    for method, columns in CRM_STEPS:
        plan.apply(method, columns)
    out = plan.current()
    return out.select(*[F.round(c, 12).alias(c) if c.endswith("_freq_enc") else F.col(c)
                        for c in out.columns])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _flagship_plan(table(spark, sf_dir, "dirty_events")).history()
    return h.select("step", "method", F.array_join("columns", ",").alias("columns"),
                    "rows_before", "rows_after", "cols_before", "cols_after")


def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = CleaningPlan(table(spark, sf_dir, "dirty_events"), order_by=ORDER)
    plan.apply("fill_median", ["value"])
    plan.apply("drop_duplicate_rows", [])
    plan.undo()
    plan.redo()
    plan.undo()
    assert plan.can_redo() and plan.can_undo()
    return plan.current()


def review_progress_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    iss = detect.detect_all(table(spark, sf_dir, "dirty_events"), order_by=ORDER)
    reviewed = iss.where(F.col("position") < 3).select("issue_id")
    pending, prog = review_progress(iss, reviewed)
    return prog.select("reviewed", "total", F.round("progress", 9).alias("progress"),
                       (F.col("total") - F.col("reviewed")).alias("pending"))


def load_csv_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.csv import load_csv
    src = table(spark, sf_dir, "dirty_customer")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    # ';'-separated, with NA for missing values, as a spreadsheet export would be
    (src.write.option("header", True).option("sep", ";").option("nullValue", "NA")
     .option("emptyValue", "").csv(folder))
    return load_csv(spark, folder)


def load_csv_messy_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export with padded header names, an empty unnamed column and NA
    tokens: names are stripped, the empty column dropped, tokens read as null."""
    from .sources.csv import load_csv
    src = table(spark, sf_dir, "dirty_customer")
    messy = src.select(*[F.col(c).alias(f" {c} ") for c in src.columns],
                       F.lit(None).cast("string").alias(""))
    folder = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    (messy.write.option("header", True).option("sep", "|").option("nullValue", "n/a")
     .option("emptyValue", "").csv(folder))
    return load_csv(spark, folder)


def load_csv_multiline_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported with their line feeds inside quoted fields, in files of several splits."""
    from .sources.csv import load_csv
    src = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text", "n_chars")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    # two parts of the table a file: files grow in number with the table, not in size, whatever their keys
    files = max(4, src.rdd.getNumPartitions() // 2)
    (src.coalesce(files).write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("nullValue", "NULL").csv(folder))
    return load_csv(spark, folder).withColumnRenamed("text", "body")


def load_csv_bad_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of customers in which every tenth has a field too many (skipped) and every seventh lacks the last
    (null)."""
    from .sources.csv import load_csv
    src = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    line = F.concat_ws("|", k.cast("string"), "c_name", F.when(k % 7 != 0, F.col("c_mktsegment")), F.when(k % 10 == 0, F.lit("more")))
    folder = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    # every seventh and tenth: the field too many would fill the gap, so it stands twice
    line = F.when((k % 7 == 0) & (k % 10 == 0), F.concat(line, F.lit("|more"))).otherwise(line)
    src.coalesce(1).select(line.alias("v")).withColumn("at", F.lit(1)).unionByName(
        spark.createDataFrame([("key|name|segment", 0)], "v string, at int")).repartition(1).sortWithinPartitions("at") \
        .select("v").write.text(folder)
    return load_csv(spark, folder)


def file_bytes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files of a text export of the documents, a line per document and line of its text."""
    from .operators.profile import input_file_bytes
    folder = os.path.join(ensure_checkpoint_dir(spark), f"text-{uuid.uuid4().hex}")
    spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("v")).write.text(folder)
    return spark.createDataFrame([(input_file_bytes(spark.read.text(folder)),)], "bytes long")


def _in_key_order(spark: SparkSession, sf_dir: str, name: str, key: str) -> tuple[DataFrame, str]:
    """A table ranged and sorted by its key, and a folder to write its files to: their order is the key's."""
    src = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"ordered-{uuid.uuid4().hex}")
    return src.repartitionByRange(4, key).sortWithinPartitions(key), folder


def line_numbers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import read_lines_ordered
    rows, folder = _in_key_order(spark, sf_dir, "customer", "c_custkey")
    rows.select("c_name").write.text(folder)
    return read_lines_ordered(spark, folder, "line")


def parquet_row_numbers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import read_parquet_ordered
    rows, folder = _in_key_order(spark, sf_dir, "events", "event_id")
    rows.select("event_id", "user_id", "value").write.parquet(folder)
    return read_parquet_ordered(spark, folder, "row")


def _as_stream(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The view written as parquet under the checkpoint folder, read back as a stream."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"src-{uuid.uuid4().hex}")
    src = table(spark, sf_dir, view)
    src.write.parquet(folder)
    return spark.readStream.schema(src.schema).parquet(folder)


def _run_stream(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """For results of a few rows (one per column and rule): a table in the driver."""
    name = f"qualis_{uuid.uuid4().hex}"
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def _run_to_files(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The stream's rows appended to Parquet files under the checkpoint folder, read back."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_missing_by_window_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that the watermark (an hour behind the latest event) has closed, and then those still open."""
    from .streaming import missing_by_window, open_windows
    columns = ["event_type", "value", "mixed"]
    stream = _as_stream(spark, sf_dir, "dirty_events")
    closed = _run_to_files(spark, missing_by_window(stream, "ts", "1 hour", "1 hour", columns))
    out = closed.unionByName(open_windows(closed, table(spark, sf_dir, "dirty_events"), "ts", "1 hour", columns))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "column",
                      "n_rows", "n_missing")


def stream_clean_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import clean_stream
    stream = _as_stream(spark, sf_dir, "dirty_customer")
    steps = [("trim_spaces", ["c_name"]), ("title_case", ["c_mktsegment"]),
             ("convert_to_numeric", ["c_acctbal"]), ("drop_columns", ["joined"])]
    return _run_to_files(spark, clean_stream(stream, steps))


def stream_audit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import audit_stream
    stream = _as_stream(spark, sf_dir, "dirty_customer")
    out = _run_stream(spark, audit_stream(stream, {"email": "email", "c_name": "special_chars"}),
                      "complete")
    return out.select("column", "rule", "n_non_null", "n_valid", "n_invalid",
                      F.round("invalid_ratio", 9).alias("invalid_ratio"))


def load_csv_na_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values written as the tokens NULL (numbers) and '' (text): both
    read back as null, and number columns keep a number type."""
    from .sources.csv import load_csv
    src = table(spark, sf_dir, "dirty_customer")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    (src.write.option("header", True).option("nullValue", "NULL").option("emptyValue", "")
     .csv(folder))
    return load_csv(spark, folder)


def post_process_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names with spaces around them, a blank header over an empty column
    and one over a filled column: names are stripped, the empty one dropped,
    the filled one kept as `Unnamed: i`."""
    from .sources.csv import load_csv
    src = table(spark, sf_dir, "dirty_customer")
    messy = src.select(F.lit(None).cast("string").alias(" "), *[F.col(c).alias(f"  {c}") for c in src.columns],
                       F.lit("x").alias(""))
    folder = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    messy.write.option("header", True).option("sep", ";").csv(folder)
    out = load_csv(spark, folder)
    return out.withColumnRenamed(out.columns[-1], "unnamed_last")


def dtype_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table, dtype, n_columns: the column-type summary of every given table."""
    rows = []
    for t in BASE_TABLES:
        for label, n in profile.dtype_summary(table(spark, sf_dir, t)).items():
            rows.append((t, label, n))
    return spark.createDataFrame(rows, "table string, dtype string, n_columns bigint")


def _preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "dirty_events"), ORDER, 50)


def _samples(spark, sf_dir):
    s = profile.profile_samples(table(spark, sf_dir, "dirty_events"), order_by=ORDER)
    return s.select("column", F.array_join("samples", "|").alias("samples"))


def _classes(spark, sf_dir):
    return profile.column_classes(table(spark, sf_dir, "dirty_customer"), order_by=ORDER)


def _dates(spark, sf_dir):
    d = profile.date_like_columns(table(spark, sf_dir, "dirty_customer"), order_by=ORDER)
    return d.select("column", "n_sampled", "n_parsed", F.round("parsed_share", 9).alias("parsed_share"),
                    "date_like")


def _col_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "dirty_events"), order_by=ORDER)


def _missing_by_column(spark, sf_dir):
    return detect.missing_by_column(table(spark, sf_dir, "dirty_events"), exclude=[ORDER])


def _histogram(spark, sf_dir):
    return summary.histogram(table(spark, sf_dir, "dirty_events"), "value", 30)


def _box(spark, sf_dir):
    b = summary.box_stats(table(spark, sf_dir, "dirty_events"), ["value", "user_id"])
    return b.select("column", "n", *[F.round(c, 9).alias(c) for c in
                                     ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                                      "whisker_low", "whisker_high"]], "n_outliers")


def _corr(spark, sf_dir):
    c = summary.correlation_matrix(table(spark, sf_dir, "dirty_events"), ["value", "user_id", "event_id"])
    return c.select("col_a", "col_b", F.round("corr", 9).alias("corr"))


def _dashboard(part: str) -> Query:
    def run(spark, sf_dir):
        d = summary.dashboard(table(spark, sf_dir, "dirty_events"), ORDER)
        out = getattr(d, part)
        return out.select("col_a", "col_b", F.round("corr", 9).alias("corr")) if part == "correlation" else out
    return run


_OUTLIER_COLUMNS = {"dirty_lineitem": ["l_quantity", "l_extendedprice", "l_discount"], "dirty_events": ["value"],
                    "crm": ["Age", "Salary"], "documents": ["n_chars"]}


def _outlier_report(view: str) -> Query:
    def run(spark, sf_dir):
        r = checks.outlier_report(table(spark, sf_dir, view), _OUTLIER_COLUMNS[view])
        return r.select("column", "n", *[F.round(c, 7).alias(c) for c in ("mean", "stddev", "skewness", "median", "mad")],
                        "is_skewed", "n_iqr", "n_zscore", "n_mad")
    return run


def _outlier_rows(view: str) -> Query:
    def run(spark, sf_dir):
        rows = checks.outlier_rows(table(spark, sf_dir, view), _OUTLIER_COLUMNS[view])
        key = ORDER if view in VIEWS else "doc_id"
        return rows.select(key, F.explode("outliers").alias("o")).select(key, "o.column", "o.method")
    return run


_CATEGORY_COLUMNS = {"dirty_events": ["event_type", "mixed", "flag", "status"], "documents": ["lang", "source", "text"],
                     "dirty_lineitem": ["l_returnflag", "l_linestatus", "l_partkey"]}


def _category_shares(view: str) -> Query:
    def run(spark, sf_dir):
        s = checks.category_shares(table(spark, sf_dir, view), _CATEGORY_COLUMNS[view])
        return s.select("column", "value", "n", F.round("share", 9).alias("share"), "is_rare")
    return run


def _imbalance(spark, sf_dir):
    view = "dirty_events"
    r = checks.imbalance_report(checks.category_shares(table(spark, sf_dir, view), _CATEGORY_COLUMNS[view]))
    return r.select("column", "n_common", "top_value", "is_imbalanced",
                    *[F.round(c, 9).alias(c) for c in ("rare_share", "top_share", "entropy", "balance")])


_V_COLUMNS = ["event_type", "mixed", "flag", "status"]


def _cramers_v(spark, sf_dir):
    v = checks.cramers_v(table(spark, sf_dir, "dirty_events"), _V_COLUMNS)
    return v.select("col_a", "col_b", "n", F.round("cramers_v", 6).alias("cramers_v"))


def _related(spark, sf_dir):
    return checks.related_columns(table(spark, sf_dir, "crm"), ["CustomerID", "CustomerID_Copy", "Age", "Salary"],
                                  ["Name", "Department", "IsActive", "Region"])


def _rules(spark, sf_dir):
    df = table(spark, sf_dir, "dirty_customer")
    return checks.number_rule_report(df, checks.number_rules(df, ["c_custkey", "c_acctbal"]))


def _rule_violations(spark, sf_dir):
    df = table(spark, sf_dir, "dirty_lineitem")
    rows = checks.number_rule_violations(df, checks.number_rules(df, ["l_quantity", "l_extendedprice", "l_linenumber", "l_discount"],
                                                                 tolerance=0.2))
    return rows.select("rid", F.explode("broken").alias("b")).select("rid", "b.column", "b.rule")


def _top(spark, sf_dir):
    return summary.top_categories(table(spark, sf_dir, "dirty_events"), "event_type", 10)


def _missing_map(spark, sf_dir):
    m = summary.missing_map(table(spark, sf_dir, "dirty_events"), ORDER, 2000)
    return m.select("block", "column", "n_rows", "n_missing", F.round("missing_share", 9).alias("missing_share"))


def _missing_map_ts(spark, sf_dir):
    """Blocks by time. Rows of equal time are ordered by a hash the oracle does not know,
    so the mapped column is the time itself."""
    df = table(spark, sf_dir, "dirty_events").select("ts", F.col("ts").alias("seen"))
    m = summary.missing_map(df, "ts", 2000)
    return m.select("block", "column", "n_rows", "n_missing", F.round("missing_share", 9).alias("missing_share"))


def _missing_cells(spark, sf_dir):
    return summary.missing_cells(table(spark, sf_dir, "dirty_events"), ORDER)


def _issue_details(spark, sf_dir):
    d = detect.detect_all(table(spark, sf_dir, "dirty_events"), order_by=ORDER)
    pct = F.array_sort(F.transform(F.map_entries("per_column_pct"), lambda e: F.concat(
        e["key"], F.lit(":"), e["value"].cast("decimal(10,2)").cast("string"))))
    return d.select("issue_id", "duplicate_count", F.array_join(pct, ",").alias("per_column_pct"),
                    F.array_join(F.transform("groups", lambda g: F.array_join(g, "=")), ";").alias("groups"))


def _audit(view: str, rules: dict) -> Query:
    def run(spark, sf_dir):
        a = audit.audit_values(table(spark, sf_dir, view), rules)
        return a.select("column", "rule", "n_non_null", "n_valid", "n_invalid",
                        F.round("invalid_ratio", 9).alias("invalid_ratio"))
    return run


def _boolean_like(spark, sf_dir):
    b = audit.boolean_like_columns(table(spark, sf_dir, "dirty_customer"))
    return b.select("column", "n_distinct", F.array_join("values", ",").alias("values"), "boolean_like")


def _json(spark, sf_dir):
    p = audit.parse_json_responses(table(spark, sf_dir, "responses"), "response", ["rid"])
    return p.select("rid", "cleaned", "is_valid")


def _json_summary(spark, sf_dir):
    s = audit.json_response_summary(table(spark, sf_dir, "responses"), "response")
    return s.select("n", "n_valid", "n_invalid", F.round("invalid_ratio", 9).alias("invalid_ratio"))


def _ffill_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "dirty_lineitem")
    return fill.forward_fill(df, ["l_quantity", "l_extendedprice"], ORDER)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        # sources
        "load_csv": load_csv_q,
        "load_csv_messy": load_csv_messy_q,
        "load_csv_na": load_csv_na_q,
        "load_csv_multiline": load_csv_multiline_q,
        "load_csv_bad_rows": load_csv_bad_rows_q,
        "file_bytes": file_bytes_q,
        "line_numbers": line_numbers_q,
        "parquet_row_numbers": parquet_row_numbers_q,
        "post_process": post_process_q,
        "dtype_summary": dtype_summary_q,
        # profiling
        "dataset_meta": _meta("dirty_events"),
        "dataset_meta_lineitem": _meta("dirty_lineitem"),
        "column_classes": _classes,
        "date_like_columns": _dates,
        "column_profile": _col_profile,
        "preview": _preview,
        "profile_samples": _samples,
        # detectors
        "detect_missing": _issues("dirty_events", detect.detect_missing_values),
        "missing_by_column": _missing_by_column,
        "detect_duplicate_rows": _issues("dirty_events", detect.detect_duplicate_rows),
        "detect_duplicate_columns": _issues("dirty_events", detect.detect_duplicate_columns),
        "detect_constant": _issues("dirty_events", detect.detect_constant_columns, "constant_columns"),
        "detect_near_constant": _issues("dirty_events", detect.detect_constant_columns,
                                        "near_constant_columns"),
        "detect_high_cardinality": _issues("dirty_customer", detect.detect_high_cardinality),
        "detect_whitespace": _issues("dirty_events", detect.detect_whitespace_issues),
        "detect_case": _issues("dirty_customer", detect.detect_inconsistent_capitalization),
        "detect_mixed_types": _issues("dirty_events", detect.detect_mixed_dtypes),
        "all_issues": _issues("dirty_events"),
        "all_issues_customer": _issues("dirty_customer"),
        "all_issues_lineitem": _issues("dirty_lineitem"),
        # every given table, whole rows and whole texts
        **{f"all_issues_{t}": _issues(t) for t in BASE_TABLES if t not in ("lineitem", "customer")},
        "all_issues_lineitem_raw": _issues("lineitem"),
        "all_issues_customer_raw": _issues("customer"),
        **{f"quality_score_{t}": _score(t) for t in ("documents", "pages", "conversations", "orders")},
        # score
        "quality_score": _score("dirty_events"),
        "quality_score_customer": _score("dirty_customer"),
        "quality_breakdown": _breakdown("dirty_events"),
        # cleaning methods
        "fill_median": _clean("dirty_events", "fill_median", ["value"]),
        "fill_mean": _clean("dirty_customer", "fill_mean", ["c_acctbal"], ["c_acctbal"]),
        "fill_mode": _clean("dirty_events", "fill_mode", ["event_type", "value"]),
        "forward_fill": _clean("dirty_events", "forward_fill", ["event_type", "value"]),
        "forward_fill_lineitem": _ffill_lineitem,
        "backward_fill": _clean("dirty_events", "backward_fill", ["event_type", "value"]),
        "interpolate": _clean("dirty_events", "interpolate", ["value"], ["value"]),
        "drop_rows": _clean("dirty_events", "drop_rows", ["event_type", "value"]),
        "drop_columns": _clean("dirty_events", "drop_columns", ["flag", "no_such_column"]),
        "drop_duplicates_first": _clean("dirty_events", "drop_duplicate_rows", []),
        "drop_duplicates_last": _clean("dirty_events", "drop_duplicate_rows_keep_last", []),
        "drop_duplicate_columns": _clean("dirty_events", "drop_duplicate_columns", ["user_id_copy"]),
        "trim_spaces": _clean("dirty_events", "trim_spaces", ["event_type"]),
        "lower_case": _clean("dirty_customer", "lower_case", ["c_mktsegment", "c_name"]),
        "upper_case": _clean("dirty_customer", "upper_case", ["c_mktsegment"]),
        "title_case": _clean("dirty_customer", "title_case", ["c_mktsegment", "email"]),
        "convert_to_numeric": _clean("dirty_events", "convert_to_numeric", ["mixed"]),
        "convert_to_string": _clean("dirty_events", "convert_to_string", ["value", "user_id"]),
        "frequency_encoding": _clean("dirty_events", "frequency_encoding", ["ts", "event_type"],
                                     ["ts_freq_enc", "event_type_freq_enc"], 12),
        "frequency_encoding_text": _clean("documents", "frequency_encoding", ["text"], ["text_freq_enc"], 12),
        "keep_as_metadata": _clean("dirty_events", "keep_as_metadata", ["flag"]),
        "keep_as_identifier": _clean("dirty_events", "keep_as_identifier", ["event_id"]),
        "remove_all_whitespace": _clean("dirty_events", "remove_all_whitespace", ["event_type"]),
        # plan and history
        "cleaning_plan": cleaning_plan,
        "cleaning_plan_lineitem": cleaning_plan_lineitem,
        "crm_pipeline": crm_pipeline,
        "all_issues_crm": _issues("crm"),
        "all_issues_dirty_embeddings": _issues("dirty_embeddings"),
        "issue_details": _issue_details,
        "all_issues_head500": _issues_head("dirty_events", 500),
        "all_issues_customer_head500": _issues_head("dirty_customer", 500),
        "all_issues_readme_messy": _issues("readme_messy"),
        "quality_score_readme_messy": _score("readme_messy"),
        "quality_score_crm": _score("crm"),
        "history": history,
        "undo_redo": undo_redo,
        "review_progress": review_progress_q,
        # dashboard summaries
        "histogram": _histogram,
        "box_stats": _box,
        "correlation_matrix": _corr,
        "top_categories": _top,
        "missing_map": _missing_map,
        "missing_map_ts": _missing_map_ts,
        "missing_cells": _missing_cells,
        "dashboard_correlation": _dashboard("correlation"),
        "dashboard_categories": _dashboard("categories"),
        # checks beyond the detectors
        **{f"outliers_{v.removeprefix('dirty_')}": _outlier_report(v) for v in _OUTLIER_COLUMNS},
        **{f"outlier_rows_{v.removeprefix('dirty_')}": _outlier_rows(v) for v in ("dirty_events", "documents")},
        **{f"category_shares_{v.removeprefix('dirty_')}": _category_shares(v) for v in _CATEGORY_COLUMNS},
        "category_imbalance": _imbalance,
        "cramers_v": _cramers_v,
        "related_columns": _related,
        "number_rules": _rules,
        "number_rule_violations": _rule_violations,
        # streaming forms
        "stream_missing_by_window": stream_missing_by_window_q,
        "stream_clean": stream_clean_q,
        "stream_audit": stream_audit_q,
        # audits
        "audit_email": _audit("dirty_customer", {"email": "email"}),
        "audit_phone": _audit("customer", {"c_name": "phone", "c_acctbal": "phone"}),
        "audit_phone_contacts": _audit("contacts", {"phone": "phone", "number": "phone", "balance": "phone"}),
        "audit_url": _audit("pages", {"url": "url"}),
        "audit_pincode": _audit("orders", {"o_orderkey": ["pincode", "pincode_us", "postcode"]}),
        "audit_special_chars": _audit("documents", {"text": "special_chars", "lang": "special_chars",
                                                    "source": "special_chars"}),
        "boolean_like_columns": _boolean_like,
        "parse_json_responses": _json,
        "json_response_summary": _json_summary,
    }
    return q


# ---------------------------------------------------------------------------------------------
# oracle SQL (DuckDB)
# ---------------------------------------------------------------------------------------------

_EV_COLS = [c for c, _ in O.VIEW_COLUMNS["dirty_events"]]
_NA_SQL = ", ".join(O.q(t) for t in
                    ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                     "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))


def _ev(body: str, extra=()) -> str:
    return O.with_view("dirty_events", body, extra)


def _cu(body: str, extra=()) -> str:
    return O.with_view("dirty_customer", body, extra)


def _select_ev(replace: dict[str, str], drop=(), add=()) -> str:
    cols = ["rid"] + _EV_COLS
    parts = [f"{replace[c]} AS {c}" if c in replace else c for c in cols if c not in drop]
    return "SELECT " + ", ".join(parts + list(add)) + " FROM dirty_events"


def _trim(x: str) -> str:
    return f"regexp_replace({O.strip(x)}, '\\s{{2,}}', ' ', 'g')"


def _title(x: str) -> str:
    runs = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"regexp_extract_all({O.strip(x)}, '{runs}'), lambda r: upper(r[1]) || lower(r[2:])), '') END")


def _to_double(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '{O.DECIMAL}') THEN TRY_CAST({O.strip(x)} AS DOUBLE) "
            f"WHEN regexp_matches(lower({x}), '^\\s*[+-]?inf(inity)?\\s*$') THEN "
            f"(CASE WHEN starts_with({O.strip(x)}, '-') THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END) END")


def _ffill(c: str, forward: bool = True) -> str:
    if forward:
        return (f"last_value({c} IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING "
                f"AND CURRENT ROW)")
    return (f"first_value({c} IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND "
            f"UNBOUNDED FOLLOWING)")


def _interpolate_sql() -> str:
    pos = "(SELECT *, CAST(row_number() OVER (ORDER BY rid) - 1 AS DOUBLE) AS pos FROM dirty_events)"
    pts = (f"(SELECT *, CASE WHEN value IS NOT NULL THEN pos END AS vp FROM {pos})")
    fwd = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    bwd = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    carried = (f"(SELECT *, last_value(vp IGNORE NULLS) OVER (ORDER BY rid {fwd}) AS bp, "
               f"last_value(value IGNORE NULLS) OVER (ORDER BY rid {fwd}) AS bv, "
               f"first_value(vp IGNORE NULLS) OVER (ORDER BY rid {bwd}) AS ap, "
               f"first_value(value IGNORE NULLS) OVER (ORDER BY rid {bwd}) AS av FROM {pts})")
    filled = ("CASE WHEN value IS NOT NULL THEN value WHEN bp IS NULL AND ap IS NULL THEN NULL "
              "WHEN bp IS NULL THEN av WHEN ap IS NULL THEN bv WHEN ap = bp THEN bv "
              "ELSE bv + (av - bv) / (ap - bp) * (pos - bp) END")
    cols = ", ".join(f"round({filled}, 9) AS value" if c == "value" else c for c in ["rid"] + _EV_COLS)
    return _ev(f"SELECT {cols} FROM {carried}")


def _dedup_sql(keep: str) -> str:
    agg = "min" if keep == "first" else "max"
    cols = ", ".join(_EV_COLS)
    return _ev(f"SELECT {agg}(rid) AS rid, {cols} FROM dirty_events GROUP BY {cols}")


def _plan_sql() -> tuple[list[tuple[str, str]], str]:
    """CTEs of the flagship plan over dirty_events, one per accepted fix."""
    keys = [c for c in _EV_COLS]
    s1 = _select_ev({"value": "coalesce(value, (SELECT median(value) FROM dirty_events))"})
    s2 = (f"SELECT min(rid) AS rid, {', '.join(keys)} FROM p1 GROUP BY {', '.join(keys)}")
    k3 = [c for c in ["rid"] + keys if c != "user_id_copy"]
    s3 = f"SELECT {', '.join(k3)} FROM p2"
    s4 = "SELECT " + ", ".join(_to_double("mixed") + " AS mixed" if c == "mixed" else c for c in k3) + " FROM p3"
    k5 = [c for c in k3 if c != "flag"]
    s5 = f"SELECT {', '.join(k5)} FROM p4"
    s6 = ("SELECT *, count(*) OVER (PARTITION BY ts) / (SELECT count(ts) FROM p5) AS ts_freq_enc "
          "FROM p5")
    s7 = "SELECT " + ", ".join(
        [f"CASE WHEN event_type IS NULL THEN NULL ELSE {_trim('event_type')} END AS event_type"
         if c == "event_type" else c for c in k5] + ["ts_freq_enc"]) + " FROM p6"
    s8 = "SELECT " + ", ".join(
        [f"{_title('event_type')} AS event_type" if c == "event_type" else c for c in k5]
        + ["round(ts_freq_enc, 12) AS ts_freq_enc"]) + " FROM p7"
    ctes = [("p1", s1), ("p2", s2), ("p3", s3), ("p4", s4), ("p5", s5), ("p6", s6), ("p7", s7),
            ("p8", s8)]
    return ctes, "SELECT * FROM p8"


def _history_sql() -> str:
    ctes, _ = _plan_sql()
    steps = [  # step, method, columns, rows before/after tables, cols before/after
        (1, "fill_median", "event_type,value", "dirty_events", "p1", 10, 10),
        (2, "drop_duplicate_rows", "", "p1", "p2", 10, 10),
        (3, "drop_duplicate_columns", "user_id_copy", "p2", "p3", 10, 9),
        (4, "convert_to_numeric", "mixed", "p3", "p4", 9, 9),
        (5, "drop_columns", "flag", "p4", "p5", 9, 8),
        (6, "review_manually", "status", "p5", "p5", 8, 8),
        (7, "frequency_encoding", "ts", "p5", "p6", 8, 9),
        (8, "trim_spaces", "event_type", "p6", "p7", 9, 9),
        (9, "title_case", "event_type", "p7", "p8", 9, 9),
    ]
    rows = [f"SELECT CAST({i} AS INTEGER) AS step, {O.q(m)} AS method, {O.q(c)} AS columns, "
            f"(SELECT count(*) FROM {a}) AS rows_before, (SELECT count(*) FROM {b}) AS rows_after, "
            f"CAST({cb} AS INTEGER) AS cols_before, CAST({ca} AS INTEGER) AS cols_after"
            for i, m, c, a, b, cb, ca in steps]
    return _ev("\nUNION ALL\n".join(rows), ctes)


def _meta_sql(view: str) -> str:
    cols = O.VIEW_COLUMNS[view]
    k = len(cols)
    miss = " + ".join(f"count(*) FILTER (WHERE {O.missing(c, t)})" for c, t in cols)
    width = {"int": 8, "int4": 4, "double": 8, "timestamp": 8}
    mem = " + ".join(f"coalesce(sum(strlen({c})), 0)" if t == "string"
                     else f"{width[t]} * count(*)" for c, t in cols)
    labels = {"int": "Integer", "int4": "Integer", "double": "Float",
              "string": "Text / Categorical", "timestamp": "Datetime"}
    counts: dict[str, int] = {}
    for _, t in cols:
        counts[labels[t]] = counts.get(labels[t], 0) + 1
    dtypes = ",".join(f"{lab}:{n}" for lab, n in sorted(counts.items()))
    names = ",".join(c for c, _ in cols)
    distinct = ", ".join(c for c, _ in cols)
    body = (f"SELECT n AS n_rows, CAST({k} AS INTEGER) AS n_cols, round(miss / greatest(n * {k}, 1) * 100, 2) "
            f"AS missing_pct, round(dup / greatest(n, 1) * 100, 2) AS duplicate_pct, "
            f"round(mem / 1048576, 3) AS memory_usage_mb, {O.q(dtypes)} AS dtypes_summary, "
            f"{O.q(names)} AS column_names, CASE WHEN round(miss / greatest(n * {k}, 1) * 100, 2) < 5 "
            f"THEN 'Low' ELSE 'High' END AS missing_level, CASE WHEN round(dup / greatest(n, 1) * 100, 2) "
            f"< 2 THEN 'Low' ELSE 'High' END AS duplicate_level FROM (SELECT count(*) AS n, {miss} AS miss, "
            f"CAST({mem} AS DOUBLE) AS mem, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {distinct} "
            f"FROM {view})) AS dup FROM {view})")
    return O.with_view(view, body)


def _profile_sql() -> str:
    rows = []
    for i, (c, t) in enumerate(O.VIEW_COLUMNS["dirty_events"]):
        dtype = {"int": "bigint", "double": "double", "string": "string", "timestamp": "timestamp_ntz"}[t]
        fr = {"int": "Integer", "double": "Float", "string": "Text / Categorical", "timestamp": "Datetime"}[t]
        rows.append(f"SELECT {O.q(c)} AS column, CAST({i} AS INTEGER) AS ord, {O.q(dtype)} AS dtype, "
                    f"{O.q(fr)} AS friendly_type, count(*) FILTER (WHERE NOT {O.missing(c, t)}) AS non_null, "
                    f"count(*) FILTER (WHERE {O.missing(c, t)}) AS missing, "
                    f"count(DISTINCT {O.val(c, t)}) AS n_unique FROM dirty_events")
    return _ev("\nUNION ALL\n".join(rows))


def _text(c: str, t: str) -> str:
    if t == "string":
        return c
    if t == "timestamp":  # Spark's text form drops trailing zeros of the fraction
        return f"regexp_replace(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '')"
    return f"CAST({c} AS VARCHAR)"


def _samples_sql() -> str:
    rows = []
    for c, t in O.VIEW_COLUMNS["dirty_events"]:
        rows.append(f"SELECT {O.q(c)} AS column, {_text(c, t)} AS value, min(rid) AS first_o "
                    f"FROM dirty_events WHERE NOT {O.missing(c, t)} GROUP BY {_text(c, t)}")
    ranked = ("SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY first_o, value) AS k "
              "FROM (" + "\nUNION ALL\n".join(rows) + ")")
    return _ev(f"SELECT \"column\", string_agg(value, '|' ORDER BY k) AS samples FROM ({ranked}) "
               f"WHERE k <= 3 GROUP BY \"column\"")


def _date_formats_sql() -> str:
    """Layouts in this engine's notation, listed apart from `functions.dates`."""
    days = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%m.%d.%Y",
            "%d.%m.%Y", "%b %d %Y", "%b %d, %Y", "%B %d %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y"]
    clocks = ["", " %H:%M", " %H:%M:%S", " %H:%M:%S.%f", " %H:%M:%S%z", " %I:%M %p", " %I:%M:%S %p"]
    iso = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S.%f", "%Y%m%d", "%Y"]
    return "[" + ", ".join(O.q(f) for f in [d + c for d in days for c in clocks] + iso) + "]"


def _dates_sql() -> str:
    rows = []
    for c, t in O.VIEW_COLUMNS["dirty_customer"]:
        if t != "string":
            continue
        first = (f"(SELECT {c} AS v FROM dirty_customer WHERE {c} IS NOT NULL ORDER BY rid LIMIT 30)")
        parsed = f"try_strptime({O.strip('v')}, {_date_formats_sql()})"
        rows.append(f"SELECT {O.q(c)} AS column, count(*) AS n_sampled, count({parsed}) AS n_parsed "
                    f"FROM {first}")
    body = ("SELECT \"column\", n_sampled, n_parsed, round(n_parsed / n_sampled, 9) AS parsed_share, "
            "n_parsed / n_sampled > 0.8 AS date_like FROM (" + "\nUNION ALL\n".join(rows) + ")")
    return _cu(body)


def _classes_sql() -> str:
    rows = []
    for i, (c, t) in enumerate(O.VIEW_COLUMNS["dirty_customer"]):
        dtype = {"int": "bigint", "double": "double", "string": "string"}[t]
        ratio = f"(SELECT count(DISTINCT {c}) FROM dirty_customer) / greatest((SELECT count(*) FROM dirty_customer), 1)"
        low = c.lower()
        if t in ("int", "double"):
            idn = any(tok in low for tok in ("id", "code", "number", "no."))
            cls = f"CASE WHEN {str(idn).lower()} AND {ratio} > 0.9 THEN 'id_like' ELSE 'numerical' END"
        else:
            idn = any(tok in low for tok in ("id", "uuid", "code"))
            parsed = f"try_strptime({O.strip('v')}, {_date_formats_sql()})"
            date_like = (f"(SELECT count({parsed}) / count(*) > 0.8 FROM (SELECT {c} AS v FROM dirty_customer "
                         f"WHERE {c} IS NOT NULL ORDER BY rid LIMIT 30))")
            cls = (f"CASE WHEN {date_like} THEN 'datetime' WHEN {str(idn).lower()} AND {ratio} > 0.9 "
                   f"THEN 'id_like' ELSE 'categorical' END")
        rows.append(f"SELECT {O.q(c)} AS column, CAST({i} AS INTEGER) AS ord, {O.q(dtype)} AS dtype, "
                    f"{cls} AS class")
    return _cu("\nUNION ALL\n".join(rows))


def _histogram_sql() -> str:
    mm = "(SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM dirty_events)"
    counts = (f"SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((value - lo) / w), 29) END AS INTEGER) AS bin, "
              f"count(*) AS cnt FROM dirty_events, {mm} WHERE value IS NOT NULL GROUP BY 1")
    bins = f"SELECT CAST(range AS INTEGER) AS bin FROM range(30)"
    return _ev(f"SELECT b.bin, round(lo + b.bin * w, 6) AS lo, round(lo + (b.bin + 1) * w, 6) AS hi, "
               f"coalesce(c.cnt, 0) AS count FROM ({bins}) b LEFT JOIN ({counts}) c ON b.bin = c.bin, {mm}")


def _box_sql() -> str:
    rows = []
    for c in ("value", "user_id"):
        x = f"CAST({c} AS DOUBLE)"
        q = (f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, "
             f"quantile_cont({x}, 0.75) AS q3 FROM dirty_events WHERE {c} IS NOT NULL)")
        rows.append(
            f"SELECT {O.q(c)} AS column, count(*) AS n, round(q1, 9) AS q1, round(med, 9) AS median, "
            f"round(q3, 9) AS q3, round(q3 - q1, 9) AS iqr, round(q1 - 1.5 * (q3 - q1), 9) AS lower_fence, "
            f"round(q3 + 1.5 * (q3 - q1), 9) AS upper_fence, "
            f"round(min({x}) FILTER (WHERE {x} >= q1 - 1.5 * (q3 - q1)), 9) AS whisker_low, "
            f"round(max({x}) FILTER (WHERE {x} <= q3 + 1.5 * (q3 - q1)), 9) AS whisker_high, "
            f"count(*) FILTER (WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS n_outliers "
            f"FROM dirty_events, {q} WHERE {c} IS NOT NULL GROUP BY q1, med, q3")
    return _ev("\nUNION ALL\n".join(rows))


def _dashboard_categories_sql() -> str:
    """The text columns of dirty_events are all categories."""
    rows = " UNION ALL ".join(
        f"SELECT {O.q(c)} AS \"column\", {c} AS value, count(*) AS n FROM dirty_events WHERE {c} IS NOT NULL GROUP BY {c}"
        for c, t in O.VIEW_COLUMNS["dirty_events"] if t == "string")
    return _ev(f"SELECT \"column\", value, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS k "
               f"FROM ({rows})) WHERE k <= 10")


def _corr_sql(cols=("value", "user_id", "event_id")) -> str:
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            pa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            pb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            r = (f"CASE WHEN stddev_pop({pa}) * stddev_pop({pb}) = 0 THEN NULL ELSE "
                 f"covar_pop({pa}, {pb}) / (stddev_pop({pa}) * stddev_pop({pb})) END")
            rows.append(f"SELECT {O.q(a)} AS col_a, {O.q(b)} AS col_b, round({r}, 9) AS corr FROM dirty_events")
            if a != b:
                rows.append(f"SELECT {O.q(b)} AS col_a, {O.q(a)} AS col_b, round({r}, 9) AS corr FROM dirty_events")
    return _ev("\nUNION ALL\n".join(rows))


def _spread_sql(view: str) -> str:
    """One row per column: moments, quartiles, median absolute deviation."""
    rows = []
    for c in _OUTLIER_COLUMNS[view]:
        rows.append(f"SELECT {O.q(c)} AS col, count(x) AS n, avg(x) AS m, stddev_samp(x) AS s, "
                    f"quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 "
                    f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {view})")
    values = "\nUNION ALL\n".join(f"SELECT {'rid' if view in VIEWS else 'doc_id'}, {O.q(c)} AS col, CAST({c} AS DOUBLE) AS x FROM {view} WHERE {c} IS NOT NULL"
                                  for c in _OUTLIER_COLUMNS[view])
    return (f"WITH sp AS ({' UNION ALL '.join(rows)}), va AS ({values}), "
            "md AS (SELECT col, quantile_cont(abs(x - med), 0.5) AS mad, "
            "sum((x - m) ** 3) / count(*) / (sum((x - m) ** 2) / count(*)) ** 1.5 AS sk FROM va JOIN sp USING (col) GROUP BY col), "
            "al AS (SELECT va.*, sp.* EXCLUDE (col), mad, sk, x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) AS o1, "
            "s > 0 AND (x < m - 3 * s OR x > m + 3 * s) AS o2, "
            "mad > 0 AND (x < med - 3 * 1.4826 * mad OR x > med + 3 * 1.4826 * mad) AS o3 "
            "FROM va JOIN sp USING (col) JOIN md USING (col))")


def _outlier_report_sql(view: str) -> str:
    body = "SELECT * FROM (" + _spread_sql(view) + (
        " SELECT col AS \"column\", any_value(n) AS n, round(any_value(m), 7) AS mean, round(any_value(s), 7) AS stddev, "
        "round(any_value(sk), 7) AS skewness, round(any_value(med), 7) AS median, round(any_value(mad), 7) AS mad, "
        "abs(any_value(sk)) > 1 AS is_skewed, count(*) FILTER (WHERE o1) AS n_iqr, count(*) FILTER (WHERE o2) AS n_zscore, "
        "count(*) FILTER (WHERE o3) AS n_mad FROM al GROUP BY col)")
    return O.with_view(view, body) if view in VIEWS else body


def _outlier_rows_sql(view: str) -> str:
    key = "rid" if view in VIEWS else "doc_id"
    body = "SELECT * FROM (" + _spread_sql(view) + " " + " UNION ALL ".join(
        f"SELECT {key}, col AS \"column\", '{m}' AS method FROM al WHERE {o}" for o, m in
        (("o1", "iqr"), ("o2", "zscore"), ("o3", "mad"))) + ")"
    return O.with_view(view, body) if view in VIEWS else body


def _shares_sql(view: str) -> str:
    rows = []
    for c in _CATEGORY_COLUMNS[view]:
        counts = f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k, sum(count(*)) OVER () AS t FROM {view} WHERE {c} IS NOT NULL GROUP BY 1)"
        rows.append(f"SELECT {O.q(c)} AS \"column\", v AS value, CAST(k AS BIGINT) AS n, k / t AS share, false AS is_rare FROM {counts} WHERE k >= t * 0.01")
        rows.append(f"SELECT {O.q(c)}, NULL, CAST(sum(k) AS BIGINT), sum(k) / any_value(t), true FROM {counts} WHERE k < t * 0.01 HAVING sum(k) > 0")
    return "\nUNION ALL\n".join(rows)


def _category_shares_sql(view: str) -> str:
    body = f"SELECT \"column\", value, n, round(share, 9) AS share, is_rare FROM ({_shares_sql(view)})"
    return O.with_view(view, body) if view in VIEWS else body


def _imbalance_sql() -> str:
    return _ev("SELECT \"column\", count(*) FILTER (WHERE NOT is_rare) AS n_common, "
               "arg_min(value, (-n, value)) FILTER (WHERE NOT is_rare) AS top_value, "
               "coalesce(max(share) FILTER (WHERE NOT is_rare) >= 0.9, false) AS is_imbalanced, "
               "round(coalesce(sum(share) FILTER (WHERE is_rare), 0), 9) AS rare_share, "
               "round(max(share) FILTER (WHERE NOT is_rare), 9) AS top_share, round(0.0 - sum(share * ln(share)), 9) AS entropy, "
               "round(CASE WHEN count(*) > 1 THEN -sum(share * ln(share)) / ln(count(*)) END, 9) AS balance "
               f"FROM ({_shares_sql('dirty_events')}) GROUP BY 1")


def _cramers_one_sql(view: str, a: str, b: str) -> str:
    cells = f"(SELECT {a} AS a, {b} AS b, count(*) AS k FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"
    joint = f"(SELECT k, sum(k) OVER (PARTITION BY a) AS ra, sum(k) OVER (PARTITION BY b) AS rb FROM {cells})"
    degrees = f"(SELECT least(count(DISTINCT a), count(DISTINCT b)) - 1 FROM {cells})"
    return (f"SELECT {O.q(a)} AS col_a, {O.q(b)} AS col_b, CAST(coalesce(sum(k), 0) AS BIGINT) AS n, "
            f"CASE WHEN {degrees} > 0 THEN sqrt(greatest(sum(k * k / ra / rb) - 1, 0) / {degrees}) END AS v FROM {joint}")


def _cramers_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_V_COLUMNS) for b in _V_COLUMNS[i + 1:]]
    rows = " UNION ALL ".join(_cramers_one_sql("dirty_events", a, b) for a, b in pairs)
    return _ev(f"SELECT col_a, col_b, n, round(v, 6) AS cramers_v FROM ({rows})")


def _related_sql() -> str:
    """Columns of the customer file within 0.9 of another, by the first column they are linked to (links go
    through at most one column there)."""
    parts = []
    for kind, cols in (("number", ["CustomerID", "CustomerID_Copy", "Age", "Salary"]), ("category", ["Name", "Department", "IsActive", "Region"])):
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
        if kind == "number":
            links = " UNION ALL ".join(f"SELECT {O.q(a)} AS x, {O.q(b)} AS y, abs(corr({a}, {b})) AS v FROM crm" for a, b in pairs)
        else:
            links = " UNION ALL ".join(f"SELECT col_a AS x, col_b AS y, v FROM ({_cramers_one_sql('crm', a, b)})" for a, b in pairs)
        place = "CASE x " + " ".join(f"WHEN {O.q(c)} THEN {i}" for i, c in enumerate(cols)) + " END"
        parts.append(f"SELECT {O.q(kind)} AS kind, arg_min(x, {place}) AS cluster, c AS \"column\" FROM (SELECT x, y AS c FROM ({links}) WHERE v >= 0.9 "
                     f"UNION ALL SELECT x, x FROM ({links}) WHERE v >= 0.9) GROUP BY c")
    return O.with_view("crm", " UNION ALL ".join(parts))


def _rules_sql(view: str, columns: list[str], tolerance: float) -> str:
    """col, rule, lim, n, bad of the rules that hold but for a share of `tolerance`."""
    rows = []
    for c in columns:
        x = f"(SELECT CAST({c} AS DOUBLE) AS x FROM {view} WHERE {c} IS NOT NULL)"
        say = f"SELECT {O.q(c)} AS col, '%s' AS rule, CAST(%s AS DOUBLE) AS lim, count(*) AS n, count(*) FILTER (WHERE %s) AS bad FROM {x} HAVING %s"
        rows.append(say % ("finite", "NULL", "isinf(x)", "true"))
        rows.append(say % ("not_negative", "0", "x < 0", "count(*) FILTER (WHERE x > 0) > 0"))
        rows.append(say % ("not_positive", "0", "x > 0", "count(*) FILTER (WHERE x < 0) > 0"))
        rows.append(say % ("not_zero", "0", "x = 0", "count(*) FILTER (WHERE x <> 0) > 0"))
        least = " UNION ALL ".join(say % ("decimals", str(d), f"round(x, {d}) <> x", "true") for d in range(7))
        rows.append(f"SELECT * FROM (SELECT * FROM ({least}) WHERE n > 0 AND bad <= {tolerance} * n ORDER BY lim LIMIT 1)")
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE n > 0 AND bad <= {tolerance} * n"


def _number_rules_sql() -> str:
    return _cu("SELECT col AS \"column\", rule, lim AS \"limit\", n, bad AS n_violations FROM ("
               + _rules_sql("dirty_customer", ["c_custkey", "c_acctbal"], 0.01) + ")")


def _rule_violations_sql() -> str:
    cols = ["l_quantity", "l_extendedprice", "l_linenumber", "l_discount"]
    broken = {"not_negative": "x < 0", "not_positive": "x > 0", "not_zero": "x = 0", "finite": "isinf(x)", "decimals": "round(x, CAST(lim AS INTEGER)) <> x"}
    values = " UNION ALL ".join(f"SELECT rid, {O.q(c)} AS col, CAST({c} AS DOUBLE) AS x FROM dirty_lineitem WHERE {c} IS NOT NULL" for c in cols)
    when = " OR ".join(f"(rule = '{r}' AND {w})" for r, w in broken.items())
    return O.with_view("dirty_lineitem", f"SELECT rid, col AS \"column\", rule FROM ({values}) JOIN ({_rules_sql('dirty_lineitem', cols, 0.2)}) USING (col) WHERE {when}")


def _missing_map_sql(order: str = "rid", columns=None) -> str:
    rows = []
    for c, t in columns or O.VIEW_COLUMNS["dirty_events"]:
        rows.append(f"SELECT block, {O.q(c)} AS column, count(*) AS n_rows, "
                    f"count(*) FILTER (WHERE {O.missing(c, t)}) AS n_missing, "
                    f"round(count(*) FILTER (WHERE {O.missing(c, t)}) / count(*), 9) AS missing_share "
                    f"FROM placed GROUP BY 1")
    placed = f"SELECT *, (row_number() OVER (ORDER BY {order}) - 1) // 2000 AS block FROM dirty_events"
    return _ev("\nUNION ALL\n".join(rows), [("placed", placed)])


def _issue_details_sql() -> str:
    pct = "CAST(CAST(round(miss / n * 100, 2) AS DECIMAL(10, 2)) AS VARCHAR)"
    groups = ("SELECT string_agg(g, ';' ORDER BY base) FROM (SELECT base, (SELECT col FROM cs WHERE ord = base) "
              "|| '=' || string_agg(b, '=' ORDER BY ob) AS g FROM dc GROUP BY base)")
    return O.with_view("dirty_events", (
        "SELECT issue_id, CASE WHEN issue_id = 'duplicate_rows' THEN (SELECT dup FROM dr) END AS duplicate_count, "
        f"CASE WHEN issue_id = 'missing_values' THEN (SELECT string_agg(col || ':' || {pct}, ',' ORDER BY col) "
        f"FROM cs WHERE miss > 0) END AS per_column_pct, "
        f"CASE WHEN issue_id = 'duplicate_columns' THEN ({groups}) END AS groups FROM iss"),
        O.issues_ctes("dirty_events"))


_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
_URL = r"^(https?://)?(www\.)?[a-zA-Z0-9-]+(\.[a-zA-Z]{2,})+([/\w\-.~:?#@!$&'()*+,;=%]*)?$"
_SPECIAL = r"[^a-zA-Z0-9\s.,\-_@]"


def _rule_sql(rule: str, x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    nb = f"{O.strip(s)} <> ''"
    if rule == "email":
        return f"({nb} AND regexp_matches({O.strip(s)}, {O.q(_EMAIL)}))"
    if rule == "url":
        return f"({nb} AND regexp_matches({O.strip(s)}, {O.q(_URL)}))"
    if rule == "phone":
        return f"({nb} AND length(regexp_replace({s}, '\\D', '', 'g')) BETWEEN 7 AND 15)"
    if rule == "pincode":
        return f"({nb} AND regexp_matches({O.strip(s)}, '^[1-9][0-9]{{5}}$'))"
    if rule == "pincode_us":
        return f"({nb} AND regexp_matches({O.strip(s)}, '^\\d{{5}}(-\\d{{4}})?$'))"
    if rule == "postcode":
        return f"({nb} AND regexp_matches({O.strip(s)}, '^[A-Za-z0-9\\- ]{{4,10}}$'))"
    if rule == "special_chars":
        return f"(NOT regexp_matches({s}, {O.q(_SPECIAL)}))"
    raise KeyError(rule)


def _audit_sql(view: str, rules: dict) -> str:
    rows = []
    for col, rs in rules.items():
        for r in ([rs] if isinstance(rs, str) else rs):
            # numbers with a fraction are no phones
            ok = "false" if (r, col) in (("phone", "c_acctbal"), ("phone", "balance")) else _rule_sql(r, col)
            rows.append(f"SELECT {O.q(col)} AS column, {O.q(r)} AS rule, count({col}) AS n_non_null, "
                        f"count(*) FILTER (WHERE {col} IS NOT NULL AND {ok}) AS n_valid, "
                        f"count({col}) - count(*) FILTER (WHERE {col} IS NOT NULL AND {ok}) AS n_invalid, "
                        f"round(CASE WHEN count({col}) = 0 THEN NULL ELSE (count({col}) - count(*) FILTER "
                        f"(WHERE {col} IS NOT NULL AND {ok})) / count({col}) END, 9) AS invalid_ratio FROM {view}")
    sql = "\nUNION ALL\n".join(rows)
    return O.with_view(view, sql) if view in O.VIEWS else sql


def _boolean_sql() -> str:
    vocab = [("yes", "no"), ("y", "n"), ("true", "false"), ("t", "f"), ("0", "1"), ("male", "female")]
    words = sorted({w for p in vocab for w in p})
    rows = [f"SELECT DISTINCT {O.q(c)} AS column, lower({O.strip(c)}) AS l FROM dirty_customer "
            f"WHERE {c} IS NOT NULL AND {O.strip(c)} <> ''"
            for c, t in O.VIEW_COLUMNS["dirty_customer"] if t == "string"]
    any_v = " OR ".join(f"bool_and(l IN ({O.q(a)}, {O.q(b)}))" for a, b in vocab)
    inw = ", ".join(O.q(w) for w in words)
    body = (f"SELECT \"column\", count(*) AS n_distinct, CASE WHEN count(*) <= 4 THEN "
            f"coalesce(string_agg(DISTINCT l, ',' ORDER BY l) FILTER (WHERE l IN ({inw})), '') END AS values, "
            f"count(*) <= 4 AND ({any_v}) AS boolean_like FROM (" + "\nUNION ALL\n".join(rows)
            + ") GROUP BY \"column\"")
    return _cu(body)


def _json_clean_sql(x: str) -> str:
    s = O.strip(x)
    unf = f"regexp_replace({s}, '^`+|`+$', '', 'g')"
    body = (f"CASE WHEN starts_with({s}, '```') AND starts_with(lower({unf}), 'json') THEN substr({unf}, 5) "
            f"WHEN starts_with({s}, '```') THEN {unf} ELSE {s} END")
    return O.strip(body)


def _json_sql() -> str:
    c = _json_clean_sql("response")
    return O.with_view("responses", f"SELECT rid, {c} AS cleaned, coalesce(json_valid({c}), false) AS is_valid "
                                    f"FROM responses")


def _json_summary_sql() -> str:
    c = _json_clean_sql("response")
    return O.with_view("responses", (
        f"SELECT count(*) AS n, count(*) FILTER (WHERE json_valid({c})) AS n_valid, "
        f"count(*) - count(*) FILTER (WHERE json_valid({c})) AS n_invalid, "
        f"round((count(*) - count(*) FILTER (WHERE json_valid({c}))) / count(*), 9) AS invalid_ratio "
        f"FROM responses WHERE response IS NOT NULL"))


def _load_csv_sql() -> str:
    cols = ["rid"] + [c for c, _ in O.VIEW_COLUMNS["dirty_customer"]]
    kinds = dict(O.VIEW_COLUMNS["dirty_customer"])
    parts = [f"CASE WHEN {c} IN ({_NA_SQL}) THEN NULL ELSE {c} END AS {c}"
             if kinds.get(c) == "string" else c for c in cols]
    return _cu("SELECT " + ", ".join(parts) + " FROM dirty_customer")


def _lineitem_ffill_sql() -> str:
    cols = [c for c, _ in O.VIEW_COLUMNS["dirty_lineitem"]]
    parts = ["rid"] + [f"{_ffill(c)} AS {c}" if c in ("l_quantity", "l_extendedprice") else c for c in cols]
    return O.with_view("dirty_lineitem", "SELECT " + ", ".join(parts) + " FROM dirty_lineitem")


def _crm_sql() -> str:
    """The logged fixes as SQL, one CTE per step."""
    keys = [c for c, _ in O.VIEW_COLUMNS["crm"]]
    s1 = ("SELECT rid, " + ", ".join(
        "coalesce(CAST(Age AS DOUBLE), (SELECT median(Age) FROM crm)) AS Age" if c == "Age" else
        "coalesce(Salary, (SELECT median(Salary) FROM crm)) AS Salary" if c == "Salary" else c
        for c in keys) + " FROM crm")
    s2 = f"SELECT min(rid) AS rid, {', '.join(keys)} FROM c1 GROUP BY {', '.join(keys)}"
    k3 = ["rid"] + [c for c in keys if c not in ("CustomerID_Copy", "Region")]
    s3 = f"SELECT {', '.join(k3)} FROM c2"
    s4 = ("SELECT *, count(*) OVER (PARTITION BY JoinDate) / (SELECT count(JoinDate) FROM c3) "
          "AS JoinDate_freq_enc FROM c3")
    def trimmed(c):
        return f"CASE WHEN {c} IS NULL THEN NULL ELSE {_trim(c)} END"
    s5 = "SELECT " + ", ".join(
        [f"{trimmed(c)} AS {c}" if c in ("Name", "City") else c for c in k3] + ["JoinDate_freq_enc"]) + " FROM c4"
    s6 = "SELECT " + ", ".join(
        [f"{_title(c)} AS {c}" if c in ("Name", "City", "IsActive") else c for c in k3]
        + ["round(JoinDate_freq_enc, 12) AS JoinDate_freq_enc"]) + " FROM c5"
    ctes = [("c1", s1), ("c2", s2), ("c3", s3), ("c4", s4), ("c5", s5), ("c6", s6)]
    return O.with_view("crm", "SELECT * FROM c6", ctes)


def _dtype_summary_sql() -> str:
    label = ("CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'Integer' "
             "WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'Float' "
             "WHEN data_type = 'BOOLEAN' THEN 'Boolean' "
             "WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'Datetime' "
             "WHEN data_type = 'VARCHAR' THEN 'Text / Categorical' "
             "WHEN data_type LIKE '%[]' THEN 'Array<' || lower(replace(data_type, '[]', '')) || '>' "
             "ELSE data_type END")
    names = ", ".join(O.q(t) for t in BASE_TABLES)
    return (f"SELECT table_name AS \"table\", {label} AS dtype, count(*) AS n_columns "
            f"FROM information_schema.columns WHERE table_name IN ({names}) GROUP BY 1, 2")


def _lineitem_plan_sql() -> str:
    """Fixes accepted on dirty_lineitem: median fill, trim, title case."""
    cols = ["rid"] + [c for c, _ in O.VIEW_COLUMNS["dirty_lineitem"]]
    rep = {c: f"coalesce({c}, (SELECT median({c}) FROM dirty_lineitem))"
           for c in ("l_quantity", "l_extendedprice")}
    rep["l_linestatus"] = f"CASE WHEN l_linestatus IS NULL THEN NULL ELSE {_trim('l_linestatus')} END"
    rep["l_returnflag"] = _title("l_returnflag")
    parts = [f"{rep[c]} AS {c}" if c in rep else c for c in cols]
    return O.with_view("dirty_lineitem", "SELECT " + ", ".join(parts) + " FROM dirty_lineitem")


def oracle_sql() -> dict[str, str]:
    ev_issue = lambda d, where="": O.issues_sql("dirty_events", [d], where)
    plan_ctes, plan_body = _plan_sql()
    return {
        "load_csv": _load_csv_sql(),
        "load_csv_messy": _load_csv_sql(),
        "load_csv_na": _load_csv_sql(),
        "load_csv_bad_rows": "SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment "
                             "FROM customer WHERE c_custkey % 10 <> 0",
        "file_bytes": "SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents",
        "line_numbers": "SELECT c_name AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS line FROM customer",
        "parquet_row_numbers": "SELECT event_id, user_id, value, row_number() OVER (ORDER BY event_id) - 1 AS row FROM events",
        "load_csv_multiline": "SELECT doc_id, source, text AS body, n_chars FROM documents",
        "post_process": _cu("SELECT " + ", ".join(
            ["rid"] + [f"CASE WHEN {c} IN ({_NA_SQL}) THEN NULL ELSE {c} END AS {c}"
                       if k == "string" else c for c, k in O.VIEW_COLUMNS["dirty_customer"]]
            + ["'x' AS unnamed_last"]) + " FROM dirty_customer"),
        "dtype_summary": _dtype_summary_sql(),
        "dataset_meta": _meta_sql("dirty_events"),
        "dataset_meta_lineitem": _meta_sql("dirty_lineitem"),
        "column_classes": _classes_sql(),
        "date_like_columns": _dates_sql(),
        "column_profile": _profile_sql(),
        "preview": _ev("SELECT * FROM dirty_events ORDER BY rid LIMIT 50"),
        "profile_samples": _samples_sql(),
        "detect_missing": ev_issue("missing"),
        "missing_by_column": _ev("\nUNION ALL\n".join(
            f"SELECT {O.q(c)} AS column, count(*) FILTER (WHERE {O.missing(c, t)}) AS n_missing, "
            f"round(count(*) FILTER (WHERE {O.missing(c, t)}) / greatest(count(*), 1) * 100, 2) AS missing_pct "
            f"FROM dirty_events" for c, t in O.VIEW_COLUMNS["dirty_events"])),
        "detect_duplicate_rows": ev_issue("dup_rows"),
        "detect_duplicate_columns": ev_issue("dup_cols"),
        "detect_constant": ev_issue("constant", "issue_id = 'constant_columns'"),
        "detect_near_constant": ev_issue("constant", "issue_id = 'near_constant_columns'"),
        "detect_high_cardinality": O.issues_sql("dirty_customer", ["high_card"]),
        "detect_whitespace": ev_issue("whitespace"),
        "detect_case": O.issues_sql("dirty_customer", ["case"]),
        "detect_mixed_types": ev_issue("mixed"),
        "all_issues": O.issues_sql("dirty_events"),
        "all_issues_customer": O.issues_sql("dirty_customer"),
        "all_issues_lineitem": O.issues_sql("dirty_lineitem"),
        **{f"all_issues_{t}": O.issues_sql(t) for t in BASE_TABLES if t not in ("lineitem", "customer")},
        "all_issues_lineitem_raw": O.issues_sql("lineitem"),
        "all_issues_customer_raw": O.issues_sql("customer"),
        **{f"quality_score_{t}": O.score_sql(t) for t in ("documents", "pages", "conversations", "orders")},
        "quality_score": O.score_sql("dirty_events"),
        "quality_score_customer": O.score_sql("dirty_customer"),
        "quality_breakdown": O.breakdown_sql("dirty_events"),
        "fill_median": _ev(_select_ev({"value": "coalesce(value, (SELECT median(value) FROM dirty_events))"})),
        "fill_mean": _cu("SELECT rid, c_custkey, c_name, c_mktsegment, round(coalesce(c_acctbal, "
                         "(SELECT avg(c_acctbal) FROM dirty_customer)), 9) AS c_acctbal, email, active, joined "
                         "FROM dirty_customer"),
        "fill_mode": _ev(_select_ev({
            "event_type": "coalesce(event_type, (SELECT arg_min(event_type, (-n, event_type)) FROM "
                          "(SELECT event_type, count(*) AS n FROM dirty_events WHERE event_type IS NOT NULL "
                          "GROUP BY event_type)))",
            "value": "coalesce(value, (SELECT arg_min(value, (-n, value)) FROM (SELECT value, count(*) AS n "
                     "FROM dirty_events WHERE value IS NOT NULL GROUP BY value)))"})),
        "forward_fill": _ev(_select_ev({"event_type": _ffill("event_type"), "value": _ffill("value")})),
        "forward_fill_lineitem": _lineitem_ffill_sql(),
        "backward_fill": _ev(_select_ev({"event_type": _ffill("event_type", False),
                                         "value": _ffill("value", False)})),
        "interpolate": _interpolate_sql(),
        "drop_rows": _ev(_select_ev({}) + " WHERE event_type IS NOT NULL AND value IS NOT NULL"),
        "keep_as_metadata": _ev(_select_ev({})),
        "keep_as_identifier": _ev(_select_ev({})),
        "frequency_encoding_text": "SELECT documents.*, round(n / (SELECT count(text) FROM documents), 12) AS text_freq_enc "
                                   "FROM documents LEFT JOIN (SELECT text AS t, count(*) AS n FROM documents "
                                   "WHERE text IS NOT NULL GROUP BY text) ON t = text",
        "drop_columns": _ev(_select_ev({}, drop=("flag",))),
        "drop_duplicates_first": _dedup_sql("first"),
        "drop_duplicates_last": _dedup_sql("last"),
        "drop_duplicate_columns": _ev(_select_ev({}, drop=("user_id_copy",))),
        "trim_spaces": _ev(_select_ev({"event_type": f"CASE WHEN event_type IS NULL THEN NULL ELSE "
                                                     f"{_trim('event_type')} END"})),
        "lower_case": _cu("SELECT rid, c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment, "
                          "c_acctbal, email, active, joined FROM dirty_customer"),
        "upper_case": _cu("SELECT rid, c_custkey, c_name, upper(c_mktsegment) AS c_mktsegment, c_acctbal, "
                          "email, active, joined FROM dirty_customer"),
        "title_case": _cu(f"SELECT rid, c_custkey, c_name, {_title('c_mktsegment')} AS c_mktsegment, c_acctbal, "
                          f"{_title('email')} AS email, active, joined FROM dirty_customer"),
        "convert_to_numeric": _ev(_select_ev({"mixed": _to_double("mixed")})),
        "convert_to_string": _ev(_select_ev({"value": "CAST(value AS VARCHAR)",
                                             "user_id": "CAST(user_id AS VARCHAR)"})),
        "frequency_encoding": _ev(_select_ev({}, add=(
            "round(count(*) OVER (PARTITION BY ts) / (SELECT count(ts) FROM dirty_events), 12) AS ts_freq_enc",
            "round(CASE WHEN event_type IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY event_type) / "
            "(SELECT count(event_type) FROM dirty_events) END, 12) AS event_type_freq_enc"))),
        "remove_all_whitespace": _ev(_select_ev({"event_type": "regexp_replace(event_type, '\\s+', '', 'g')"})),
        "cleaning_plan": _ev(plan_body, plan_ctes),
        "cleaning_plan_lineitem": _lineitem_plan_sql(),
        "crm_pipeline": _crm_sql(),
        "all_issues_crm": O.issues_sql("crm"),
        "all_issues_dirty_embeddings": O.issues_sql("dirty_embeddings"),
        "issue_details": _issue_details_sql(),
        "all_issues_head500": O.issues_sql("dirty_events", head=500),
        "all_issues_customer_head500": O.issues_sql("dirty_customer", head=500),
        "all_issues_readme_messy": O.issues_sql("readme_messy"),
        "quality_score_readme_messy": O.score_sql("readme_messy"),
        "quality_score_crm": O.score_sql("crm"),
        "history": _history_sql(),
        "undo_redo": _ev(_select_ev({"value": "coalesce(value, (SELECT median(value) FROM dirty_events))"})),
        "review_progress": O.with_view("dirty_events", (
            "SELECT CAST(least(3, count(*)) AS BIGINT) AS reviewed, count(*) AS total, "
            "round(CASE WHEN count(*) = 0 THEN 1.0 ELSE least(1.0, least(3, count(*)) / count(*)) END, 9) "
            "AS progress, count(*) - CAST(least(3, count(*)) AS BIGINT) AS pending FROM iss"),
            O.issues_ctes("dirty_events")),
        "histogram": _histogram_sql(),
        "box_stats": _box_sql(),
        "correlation_matrix": _corr_sql(),
        "top_categories": _ev("SELECT event_type AS value, count(*) AS count FROM dirty_events "
                              "WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count DESC, value "
                              "LIMIT 10"),
        "missing_map": _missing_map_sql(),
        "missing_map_ts": _missing_map_sql("ts", [("ts", "timestamp")]).replace("'ts' AS column", "'seen' AS column"),
        "missing_cells": _ev("\nUNION ALL\n".join(
            f"SELECT rid AS row, {O.q(c)} AS column, CAST({O.missing(c, t)} AS INTEGER) AS missing FROM dirty_events"
            for c, t in O.VIEW_COLUMNS["dirty_events"])),
        "stream_missing_by_window": _ev("\nUNION ALL\n".join(
            f"SELECT date_trunc('hour', ts) AS window_start, {O.q(c)} AS \"column\", count(*) AS n_rows, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM dirty_events GROUP BY 1"
            for c in ("event_type", "value", "mixed"))),
        # event_id has a name and as many values as an id has
        "dashboard_correlation": _corr_sql(("user_id", "user_id_copy", "value")),
        "dashboard_categories": _dashboard_categories_sql(),
        **{f"outliers_{v.removeprefix('dirty_')}": _outlier_report_sql(v) for v in _OUTLIER_COLUMNS},
        **{f"outlier_rows_{v.removeprefix('dirty_')}": _outlier_rows_sql(v) for v in ("dirty_events", "documents")},
        **{f"category_shares_{v.removeprefix('dirty_')}": _category_shares_sql(v) for v in _CATEGORY_COLUMNS},
        "category_imbalance": _imbalance_sql(),
        "cramers_v": _cramers_sql(),
        "related_columns": _related_sql(),
        "number_rules": _number_rules_sql(),
        "number_rule_violations": _rule_violations_sql(),
        "stream_clean": _cu(f"SELECT rid, c_custkey, CASE WHEN c_name IS NULL THEN NULL ELSE {_trim('c_name')} "
                            f"END AS c_name, {_title('c_mktsegment')} AS c_mktsegment, c_acctbal, email, active "
                            f"FROM dirty_customer"),
        "stream_audit": _audit_sql("dirty_customer", {"email": "email", "c_name": "special_chars"}),
        "audit_email": _audit_sql("dirty_customer", {"email": "email"}),
        "audit_phone": _audit_sql("customer", {"c_name": "phone", "c_acctbal": "phone"}),
        "audit_phone_contacts": _audit_sql("contacts", {"phone": "phone", "number": "phone", "balance": "phone"}),
        "audit_url": _audit_sql("pages", {"url": "url"}),
        "audit_pincode": _audit_sql("orders", {"o_orderkey": ["pincode", "pincode_us", "postcode"]}),
        "audit_special_chars": _audit_sql("documents", {"text": "special_chars", "lang": "special_chars",
                                                         "source": "special_chars"}),
        "boolean_like_columns": _boolean_sql(),
        "parse_json_responses": _json_sql(),
        "json_response_summary": _json_summary_sql(),
    }
