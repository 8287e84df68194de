"""Properties over random small tables (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from qualis.operators import clean, detect, score
from qualis.operators.stats import TableStats

text = st.one_of(st.none(), st.sampled_from(["a", "A", " a", "b ", "b  c", "B", "12", "x"]))
nums = st.one_of(st.none(), st.integers(-5, 5).map(float))
tables = st.lists(st.tuples(text, nums), min_size=1, max_size=25)
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows):
    return spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(rows)], "rid int, s string, x double")


def _ids(df):
    return {r["issue_id"] for r in detect.run_detectors(TableStats(df, order_by="rid"))}


@SETTINGS
@given(tables)
def test_trim_removes_whitespace_issue(spark, rows):
    df = clean.trim_spaces(_frame(spark, rows), ["s"])
    assert "whitespace_issues" not in _ids(df)


@SETTINGS
@given(tables)
def test_dedup_is_idempotent_and_clears_duplicates(spark, rows):
    once = clean.drop_duplicate_rows(_frame(spark, rows), [], order_by="rid")
    twice = clean.drop_duplicate_rows(once, [], order_by="rid")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert "duplicate_rows" not in _ids(once)


@SETTINGS
@given(tables)
def test_score_in_range(spark, rows):
    df = _frame(spark, rows)
    s = score.quality_score(detect.detect_all(df, order_by="rid")).first()["score"]
    assert 0.0 <= s <= 100.0


@SETTINGS
@given(tables)
def test_fill_mode_leaves_no_nulls_when_any_value(spark, rows):
    df = clean.fill_mode(_frame(spark, rows), ["s", "x"])
    got = df.collect()
    for col in ("s", "x"):
        if any(r[col] is not None for r in got):
            assert all(r[col] is not None for r in got)
