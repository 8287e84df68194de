import math

import pytest

from qualis import fixtures
from qualis.config import QualityConfig
from qualis.operators import detect
from qualis.operators.stats import TableStats

from .conftest import SF_MID


def _issues(df, **kw):
    st = TableStats(df, **kw)
    return {r["issue_id"]: r for r in detect.run_detectors(st)}


def test_dirty_events_findings(spark):
    df = fixtures.table(spark, SF_MID, "dirty_events")
    got = _issues(df, order_by="rid")
    assert list(got) == ["missing_values", "duplicate_rows", "duplicate_columns", "mixed_dtypes",
                         "constant_columns", "near_constant_columns", "high_cardinality",
                         "whitespace_issues", "inconsistent_capitalization"]
    m = got["missing_values"]
    assert m["affected_columns"] == ["event_type", "value"]
    assert math.isclose(m["affected_ratio"], 2061 / 94500)
    assert m["severity"] == "MEDIUM" and m["recommended_method"] == "fill_median"
    assert m["per_column_pct"] == {"event_type": 5.33, "value": 14.3}
    assert got["duplicate_rows"]["duplicate_count"] == 500
    assert got["duplicate_columns"]["groups"] == [["user_id", "user_id_copy"]]
    assert got["constant_columns"]["affected_columns"] == ["flag"]
    assert got["near_constant_columns"]["affected_columns"] == ["status"]
    assert got["high_cardinality"]["affected_columns"] == ["ts"]
    assert got["mixed_dtypes"]["affected_columns"] == ["mixed"]


def test_dirty_customer_findings(spark):
    got = _issues(fixtures.table(spark, SF_MID, "dirty_customer"), order_by="rid")
    assert list(got) == ["missing_values", "high_cardinality", "inconsistent_capitalization"]
    assert got["missing_values"]["severity"] == "HIGH"
    assert got["high_cardinality"]["affected_columns"] == ["c_name", "email"]
    assert got["inconsistent_capitalization"]["affected_columns"] == ["c_mktsegment"]


def test_nan_and_null_both_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "x double")
    m = _issues(df)["missing_values"]
    assert m["per_column_pct"] == {"x": 50.0}


def test_all_null_column_is_constant(spark):
    df = spark.createDataFrame([(i, None) for i in range(5)], "a int, b string")
    got = _issues(df)
    assert got["constant_columns"]["affected_columns"] == ["b"]


def test_high_cardinality_needs_ten_rows(spark):
    nine = spark.createDataFrame([(f"v{i}",) for i in range(9)], "s string")
    ten = spark.createDataFrame([(f"v{i}",) for i in range(10)], "s string")
    assert "high_cardinality" not in _issues(nine)
    assert _issues(ten)["high_cardinality"]["affected_columns"] == ["s"]


@pytest.mark.parametrize("dups,severity", [(1, "LOW"), (2, "LOW"), (3, "MEDIUM"), (10, "MEDIUM"),
                                           (11, "HIGH")])
def test_duplicate_row_thresholds_are_strict(spark, dups, severity):
    rows = [(i,) for i in range(100 - dups)] + [(0,)] * dups
    got = _issues(spark.createDataFrame(rows, "a int"))
    assert got["duplicate_rows"]["severity"] == severity


@pytest.mark.parametrize("missing,severity", [(4, "LOW"), (5, "MEDIUM"), (29, "MEDIUM"), (30, "HIGH")])
def test_missing_thresholds_inclusive(spark, missing, severity):
    rows = [(i, None if i < missing else 1.0) for i in range(100)]
    got = _issues(spark.createDataFrame(rows, "k int, x double"))
    assert got["missing_values"]["severity"] == severity


def test_near_constant_and_cardinality_inclusive(spark):
    rows = [("a",)] * 99 + [("b",)]
    assert _issues(spark.createDataFrame(rows, "s string"))["near_constant_columns"]
    rows = [(f"v{i % 9}" if i < 10 else f"v{i}",) for i in range(100)]  # 91 distinct of 100
    hc = _issues(spark.createDataFrame(rows, "s string"))
    assert "high_cardinality" in hc
    rows = [(f"v{i % 10}" if i < 20 else f"v{i}",) for i in range(100)]  # 90 distinct: exactly 0.90
    assert "high_cardinality" in _issues(spark.createDataFrame(rows, "s string"))


@pytest.mark.parametrize("numeric,flag", [(10, False), (11, True), (89, True), (90, False)])
def test_mixed_type_bounds_strict(spark, numeric, flag):
    rows = [(str(i) if i < numeric else "word",) for i in range(100)]
    assert ("mixed_dtypes" in _issues(spark.createDataFrame(rows, "s string"))) == flag


def test_case_check_strips_and_skips_blanks(spark):
    df = spark.createDataFrame([(" Bob",), ("bob ",), ("",), ("Ann",)], "s string")
    assert _issues(df)["inconsistent_capitalization"]["affected_columns"] == ["s"]
    df = spark.createDataFrame([("Bob",), ("Bob ",), ("   ",)], "s string")
    assert "inconsistent_capitalization" not in _issues(df)


def test_head_rows_rule_reads_only_first_values(spark):
    # case collision only after the first 500 non-null values
    rows = [(i, "Apple") for i in range(600)] + [(600, "apple")]
    df = spark.createDataFrame(rows, "rid int, s string")
    assert "inconsistent_capitalization" in _issues(df, order_by="rid")
    head = _issues(df, order_by="rid", cfg=QualityConfig(head_rows=500))
    assert "inconsistent_capitalization" not in head


def test_duplicate_columns_need_same_type_and_values(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2), (2, 2, 2.0, 1)], "a int, b int, c double, d int")
    got = _issues(df)["duplicate_columns"]
    assert got["groups"] == [["a", "b"]] and got["affected_columns"] == ["b"]


def test_failing_detector_is_skipped(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    st = TableStats(df)

    def broken(_):
        raise RuntimeError("boom")
    out = detect.run_detectors(st, [broken, detect.detect_missing_values])
    assert [r["issue_id"] for r in out] == ["missing_values"]
    assert st.failed == ["broken"]


def test_missing_by_column_lazy(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    rows = {r["column"]: (r["n_missing"], r["missing_pct"]) for r in detect.missing_by_column(df).collect()}
    assert rows == {"a": (1, 50.0), "b": (1, 50.0)}


def test_wide_table_metrics_in_chunks(spark):
    from pyspark.sql import functions as F
    from qualis.operators import summary
    cols = [F.when(F.col("id") % (i + 2) == 0, F.lit(None)).otherwise(F.col("id") * i).alias(f"c{i}")
            for i in range(200)]
    df = spark.range(50).select(*cols)
    st = TableStats(df)
    assert [st.column(f"c{i}").n_missing for i in (0, 1, 150, 199)] == [25, 17, 1, 1]
    m = _issues(df)["missing_values"]
    assert m["affected_columns"] == [f"c{i}" for i in range(200)]
    corr = summary.correlation_matrix(df, [f"c{i}" for i in range(1, 31)])  # 465 pairs
    assert corr.count() == 900


def test_long_text_summary_matches_plain(spark):
    from qualis.operators.vf import column_value_summary, long_text_summary
    texts = ["Alpha beta gamma " * 5, "alpha beta gamma " * 5, "Alpha beta gamma " * 5, "   ", "",
             "unique text here " * 4, None, "x" * 300, "x" * 300]
    df = spark.createDataFrame([(t, t.upper() if t else t) for t in texts], "a string, b string")
    got = sorted(tuple(r) for r in long_text_summary(df, ["a", "b"]).collect())
    want = sorted(tuple(r) for r in column_value_summary(df, ["a", "b"], case_of_text=True)
                  .select("column", "n_unique", "max_cnt", "n_non_null", "mixed").collect())
    assert got == want
    assert dict((r[0], r[4]) for r in got) == {"a": True, "b": False}
