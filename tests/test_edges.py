"""Empty tables, all-null columns and header-only files."""

import os
import tempfile

from qualis.operators import clean, detect, fill, profile, score, summary
from qualis.operators.quantile import exact_quantiles
from qualis.sources.csv import load_csv

from .conftest import rows_of


def test_empty_table_through_every_layer(spark):
    df = spark.createDataFrame([], "rid long, a long, b string, x double")
    issues = detect.detect_all(df, order_by="rid")
    ids = {r["issue_id"] for r in issues.collect()}
    assert "missing_values" not in ids and "duplicate_rows" not in ids
    s = score.quality_score(issues).first()
    assert 0.0 <= s["score"] <= 100.0
    m = profile.dataset_meta(df, order_by="rid").first()
    assert (m["n_rows"], m["missing_pct"], m["duplicate_pct"]) == (0, 0.0, 0.0)
    assert fill.forward_fill(df, ["x"], "rid").count() == 0
    assert fill.interpolate(df, ["x"], "rid").count() == 0
    assert fill.drop_duplicate_rows(df, "rid").count() == 0
    assert exact_quantiles(df, "x", [0.5]) == [None]
    assert summary.histogram(df, "x").count() == 0
    assert summary.top_categories(df, "b").count() == 0


def test_all_null_column_in_fills(spark):
    df = spark.createDataFrame([(i, None) for i in range(5)], "rid long, x double")
    assert [r[0] for r in fill.forward_fill(df, ["x"], "rid").orderBy("rid").select("x").collect()] == [None] * 5
    assert [r[0] for r in fill.interpolate(df, ["x"], "rid").orderBy("rid").select("x").collect()] == [None] * 5


def test_header_only_csv(spark):
    folder = tempfile.mkdtemp(prefix="qualis-csv-")
    path = os.path.join(folder, "h.csv")
    with open(path, "w") as fh:
        fh.write("a,b\n")
    df = load_csv(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 0


def test_nested_columns_pass_through(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1}, [1.0, 2.0], "x"), (1, {"a": 1}, [1.0, 2.0], "x"), (2, {"b": 2}, None, None)],
        "k int, m map<string,int>, v array<double>, s string")
    got = {r["issue_id"]: r for r in detect.detect_all(df).collect()}
    assert got["duplicate_rows"]["duplicate_count"] == 1   # rows compared without the map
    assert got["missing_values"]["affected_columns"] == ["v", "s"]  # nulls count in every column
    assert got["missing_values"]["affected_ratio"] == 2 / 12
    m = profile.dataset_meta(df).first()
    assert (m["n_cols"], m["missing_pct"]) == (4, 16.67)
    assert {r["column"]: r["n_missing"] for r in detect.missing_by_column(df).collect()} == \
        {"k": 0, "m": 0, "v": 1, "s": 1}
    assert {r["column"]: (r["missing"], r["n_unique"]) for r in profile.column_profile(df).collect()}["v"] == (1, None)


def test_only_nested_columns_missing_is_reviewed(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "k int, v array<double>")
    issue = [r for r in detect.detect_all(df).collect() if r["issue_id"] == "missing_values"][0]
    assert issue["recommended_method"] == "review_manually"
    assert rows_of(clean.fill_mode(df, ["v"])) == rows_of(df)  # nested columns stay as they are


def test_columns_without_values_keep_their_row(spark):
    df = spark.createDataFrame([(i, None, "2024-1-5") for i in range(3)], "rid long, s string, d string")
    dates = {r["column"]: r for r in profile.date_like_columns(df, order_by="rid").collect()}
    assert (dates["s"]["n_sampled"], dates["s"]["parsed_share"], dates["s"]["date_like"]) == (0, None, False)
    assert dates["d"]["date_like"]
    samples = {r["column"]: r["samples"] for r in profile.profile_samples(df, order_by="rid").collect()}
    assert samples == {"s": [], "d": ["2024-1-5"]}
    only = spark.createDataFrame([(1,)], "rid long")
    assert profile.date_like_columns(only, order_by="rid").count() == 0
    assert profile.profile_samples(only, order_by="rid").count() == 0


def test_missing_map_blocks_are_row_positions(spark):
    import datetime as dt
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in (0, 400, 401, 9000)]
    df = spark.createDataFrame([(d, None if i % 2 else "x", i) for i, d in enumerate(days)],
                               "d date, `a.b` string, block int")
    for key in ("date", "timestamp"):
        keyed = df.withColumn("d", df.d.cast(key))
        got = rows_of(summary.missing_map(keyed, "d", 2).select("block", "column", "n_rows", "n_missing"))
        assert got == [(0, "a.b", 2, 1), (0, "block", 2, 0), (1, "a.b", 2, 1), (1, "block", 2, 0)]
    cells = rows_of(summary.missing_cells(df, "d", exclude=["block"]).select("column", "missing"))
    assert cells == [("a.b", 0)] * 2 + [("a.b", 1)] * 2


def test_frequency_encoding_of_text_broadcasts_hashes_only(spark):
    df = spark.createDataFrame([("x" * 5000, {"a": 1}, 1.5), ("x" * 5000, {"a": 1}, None), (None, None, 1.5)],
                               "`t.x` string, m map<string,int>, f double")
    out = clean.frequency_encoding(df, ["t.x", "m", "f"])
    assert out.columns == ["t.x", "m", "f", "t.x_freq_enc", "m_freq_enc", "f_freq_enc"]
    assert sorted((tuple(r)[3:] for r in out.collect()), key=repr) == [(1.0, 1.0, 1.0), (1.0, 1.0, None), (None, None, 1.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint") >= 2
    assert "BroadcastMode(List(input[0, string" not in plan
