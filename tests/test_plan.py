import pytest

from qualis import fixtures
from qualis.operators import detect
from qualis.plans import CleaningPlan, review_progress, target_columns

from .conftest import SF_SMALL, rows_of


def _table(spark):
    return spark.createDataFrame(
        [(1, " a", 1.0), (2, " a", 1.0), (3, "b", None), (4, "B", 4.0)], "rid int, s string, x double")


def test_undo_redo_round_trip(spark):
    df = _table(spark)
    plan = CleaningPlan(df, order_by="rid")
    assert plan.undo() is None and plan.redo() is None
    plan.apply("fill_median", ["x"])
    after_two = plan.apply("drop_duplicate_rows", [])
    assert plan.can_undo() and not plan.can_redo()
    back = plan.undo()
    assert rows_of(back, "rid") == [(1, " a", 1.0), (2, " a", 1.0), (3, "b", 1.0), (4, "B", 4.0)]
    assert rows_of(plan.redo(), "rid") == rows_of(after_two, "rid")
    plan.undo()
    plan.apply("trim_spaces", ["s"])  # a new step clears redo
    assert not plan.can_redo()
    plan.undo()
    plan.undo()
    assert rows_of(plan.current(), "rid") == rows_of(df, "rid")


def test_history_counts_in_one_job(spark):
    plan = CleaningPlan(_table(spark), order_by="rid")
    plan.apply("drop_rows", ["x"])
    plan.apply("drop_duplicate_rows", [])
    plan.apply("drop_columns", ["x"])
    h = [r.asDict() for r in plan.history().orderBy("step").collect()]
    assert [(r["rows_before"], r["rows_after"], r["cols_before"], r["cols_after"]) for r in h] == [
        (4, 3, 3, 3), (3, 2, 3, 3), (2, 2, 3, 2)]
    assert [r["method"] for r in h] == ["drop_rows", "drop_duplicate_rows", "drop_columns"]


def test_accept_uses_groups_when_no_columns(spark):
    issue = {"issue_id": "x", "affected_columns": [], "groups": [["a", "b"]], "recommended_method": "review_manually"}
    assert target_columns(issue) == ["a", "b"]
    assert target_columns({"affected_columns": ["c"]}) == ["c"]
    assert target_columns({"affected_columns": []}) == []


def test_accepting_fixes_clears_issues(spark):
    df = fixtures.table(spark, SF_SMALL, "dirty_events")
    plan = CleaningPlan(df, order_by="rid")
    issues = detect.detect_all(df, order_by="rid").orderBy("position").collect()
    for row in issues:
        plan.accept(row.asDict(recursive=True))
    left = {r["issue_id"]: r for r in detect.detect_all(plan.current(), order_by="rid").collect()}
    before = {r["issue_id"] for r in issues}
    for fixed in ("duplicate_rows", "duplicate_columns", "whitespace_issues",
                  "inconsistent_capitalization", "mixed_dtypes"):
        assert fixed in before and fixed not in left
    # median fill covers numbers only: text nulls stay, and words in `mixed` became nulls
    assert left["missing_values"]["affected_columns"] == ["event_type", "mixed"]
    # every timestamp is unique, so its frequency encoding is one constant share
    assert left["constant_columns"]["affected_columns"] == ["ts_freq_enc"]


def test_review_progress(spark):
    issues = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "issue_id string")
    reviewed = spark.createDataFrame([("a",), ("b",), ("zz",)], "issue_id string")
    pending, prog = review_progress(issues, reviewed)
    assert sorted(r[0] for r in pending.collect()) == ["c", "d"]
    assert prog.first().asDict() == {"reviewed": 2, "total": 4, "progress": 0.5}
    none = spark.createDataFrame([], "issue_id string")
    assert review_progress(none, none)[1].first()["progress"] == 1.0


def test_unknown_method_refused(spark):
    with pytest.raises(KeyError):
        CleaningPlan(_table(spark)).apply("rename_and_keep", ["s"])


def test_extension_registries(spark):
    from pyspark.sql import functions as F
    from qualis.operators import clean
    from qualis.operators.stats import TableStats
    from qualis.schema import issue

    def negate(df, columns, order_by=None):
        return df.select(*[(-F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
    clean.register_method("negate", negate, "Negate")
    df = spark.createDataFrame([(1, 2.0)], "rid int, x double")
    plan = CleaningPlan(df, order_by="rid")
    assert plan.apply("negate", ["x"]).first()["x"] == -2.0
    assert plan.history(with_counts=False).first()["action"] == "Negate"

    def always(st: TableStats):
        return [issue("custom", "custom", "Custom", "INFO", [], 0.5, "d", "r", "review_manually", [])]
    detect.register_detector(always)
    try:
        issues, failed = detect.detect_report(df)
        got = {r["issue_id"]: r for r in issues.collect()}
        assert got["custom"]["severity"] == "INFO" and failed == []
    finally:
        detect.DETECTORS.remove(always)


def test_parquet_row_id_follows_file_order(spark):
    import os
    import tempfile
    from qualis.sources.rowid import read_parquet_ordered
    folder = tempfile.mkdtemp(prefix="qualis-pq-")
    spark.range(0, 100, numPartitions=3).write.mode("overwrite").parquet(os.path.join(folder, "t"))
    df = read_parquet_ordered(spark, os.path.join(folder, "t"))
    ids = [r["id"] for r in df.orderBy("_rid").collect()]
    assert sorted(ids) == list(range(100)) and df.select("_rid").distinct().count() == 100


def test_auto_checkpoint_cuts_lineage(spark):
    plan = CleaningPlan(_table(spark), order_by="rid", auto_checkpoint=True)
    plan.apply("trim_spaces", ["s"])
    out = plan.apply("drop_duplicate_rows", [])
    analyzed = out._jdf.queryExecution().analyzed().toString()  # a stored table, nothing before it
    assert analyzed.startswith("Relation [") and "Aggregate" not in analyzed
    assert rows_of(out, "rid") == [(1, "a", 1.0), (3, "b", None), (4, "B", 4.0)]
    h = [r["rows_after"] for r in plan.history().orderBy("step").collect()]
    assert h == [4, 3]


def _jobs(spark, fn):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        out = fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_counts_come_from_the_write(spark, tmp_path):
    plan = CleaningPlan(_table(spark), order_by="rid")
    plan.apply("trim_spaces", ["s"])
    plan.apply("drop_duplicate_rows", [])
    plan.apply("upper_case", ["s"])
    plan.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    history, jobs = _jobs(spark, plan.history)
    assert jobs == 0
    assert [(r["rows_before"], r["rows_after"]) for r in history.orderBy("step").collect()] == [(4, 4), (4, 3), (3, 3)]
    plan.undo()
    plan.undo()
    assert [r["rows_after"] for r in plan.history().collect()] == [4]
    plan.redo()
    plan.apply("lower_case", ["s"])
    history, jobs = _jobs(spark, plan.history)  # a step that keeps the rows needs no count
    assert jobs == 0 and [r["rows_after"] for r in history.orderBy("step").collect()] == [4, 3, 3]
    plan.apply("drop_rows", ["s"])
    assert _jobs(spark, plan.history)[1] > 0


def test_statistics_are_kept_per_prefix(spark):
    plan = CleaningPlan(_table(spark), order_by="rid")
    first = plan.stats()
    plan.apply("trim_spaces", ["s"])
    second = plan.stats()
    assert second is plan.stats() and second is not first
    plan.undo()
    assert plan.stats() is first
    plan.redo()
    assert plan.stats() is second
