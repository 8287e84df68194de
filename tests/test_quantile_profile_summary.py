import math

import numpy as np
import pytest

from qualis import fixtures
from qualis.operators import profile, quantile, summary
from qualis.operators.quantile import exact_quantiles

from .conftest import SF_MID


@pytest.mark.parametrize("kind", ["normal", "hot", "spread", "ints", "tiny"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(3)
    arr = {
        "normal": rng.normal(size=6001),
        "hot": np.concatenate([np.full(3000, 7.0), rng.normal(size=6000)]),  # one value, a third
        "spread": 2.0 ** rng.integers(-500, 500, size=5000).astype(float),
        "ints": rng.integers(0, 20, size=4000).astype(float),
        "tiny": np.array([5.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in arr], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    want = np.quantile(arr, [0.0, 0.25, 0.5, 0.75, 1.0])
    assert all(math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want))


def test_quantiles_of_many_columns_in_few_jobs(spark):
    """Columns of all kinds together: passes do not grow with their number."""
    rng = np.random.default_rng(4)
    cols = {"n": rng.normal(size=9000), "hot": np.where(rng.random(9000) < 0.4, 7.0, rng.normal(size=9000)),
            "wide": rng.choice([-1, 1], 9000) * 10.0 ** rng.uniform(-300, 300, 9000), "i": rng.integers(-5, 5, 9000).astype(float),
            "inf": np.where(rng.random(9000) < 0.3, np.inf, np.where(rng.random(9000) < 0.3, -np.inf, rng.normal(size=9000))),
            "close": 1.0 + rng.integers(0, 9000, 9000) * 2.0 ** -52, "zero": rng.choice([0.0, -0.0], 9000),
            "sub": rng.integers(-2000, 2000, 9000) * 5e-324}
    rows = [tuple(None if rng.random() < 0.1 else float(v[i]) for v in cols.values()) for i in range(9000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "")
    got = quantile.quantiles(df, list(cols), probs)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("quantiles")) <= 24
    for i, c in enumerate(cols):
        values = sorted(r[i] for r in rows if r[i] is not None)
        with np.errstate(all="ignore"):
            for p, v in zip(probs, got[c]):
                place = p * (len(values) - 1)
                lo, hi = values[math.floor(place)], values[math.ceil(place)]
                d = place - math.floor(place)
                want = lo if d == 0 else (1 - d) * lo + d * hi
                assert v == pytest.approx(want, rel=1e-12, abs=0.0, nan_ok=True), (c, p)


def test_all_passes(spark, monkeypatch):
    """No early end: the last bit decides."""
    monkeypatch.setattr(quantile, "FINISH_ROWS", 0)
    rng = np.random.default_rng(5)
    x = np.concatenate([1.0 + rng.integers(0, 300, 500) * 2.0 ** -52, -rng.random(300), [0.0, -1e300, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.3, 0.5, 0.9, 1.0])
    assert got == pytest.approx(np.quantile(x, [0.0, 0.3, 0.5, 0.9, 1.0]).tolist(), rel=1e-15)


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", [0.5]) == [None]


def test_dataset_meta_and_levels(spark):
    df = fixtures.table(spark, SF_MID, "dirty_events")
    m = profile.dataset_meta(df, order_by="rid").first().asDict()
    assert (m["n_rows"], m["n_cols"], m["missing_pct"], m["duplicate_pct"]) == (10500, 9, 2.18, 4.76)
    assert m["missing_level"] == "Low" and m["duplicate_level"] == "High"
    assert m["dtypes_summary"] == {"Integer": 3, "Datetime": 1, "Text / Categorical": 4, "Float": 1}


def test_column_classes(spark):
    df = spark.createDataFrame(
        [(i, f"id{i}", i % 2 == 0, "2024-01-0" + str(1 + i % 9), float(i % 3), "x" if i % 2 else "y")
         for i in range(20)],
        "cust_id long, code string, flag boolean, day string, amount double, cat string")
    got = {r["column"]: r["class"] for r in profile.column_classes(df).collect()}
    assert got == {"cust_id": "id_like", "code": "id_like", "flag": "boolean", "day": "datetime",
                   "amount": "numerical", "cat": "categorical"}


def test_file_size_from_metadata(spark):
    df = spark.read.parquet(f"{SF_MID}/region.parquet")
    assert profile.input_file_bytes(df) == 1793


def test_samples_and_preview(spark):
    df = spark.createDataFrame([(3, "c"), (1, "b"), (2, "b"), (4, None), (5, "a"), (6, "d")],
                               "rid int, s string")
    got = profile.profile_samples(df, order_by="rid").where("column = 's'").first()["samples"]
    assert got == ["b", "c", "a"]
    assert [r["rid"] for r in profile.preview(df, "rid", 2).collect()] == [1, 2]


def test_histogram_last_edge_and_constant(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = {r["bin"]: r["count"] for r in summary.histogram(df, "x", 10).collect()}
    assert len(h) == 10 and h[9] == 1 and h[0] == 1 and sum(h.values()) == 5
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    rows = summary.histogram(const, "x", 3).collect()
    assert sum(r["count"] for r in rows) == 2


def test_box_stats_and_outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    b = summary.box_stats(df, ["x"]).first().asDict()
    assert (b["q1"], b["median"], b["q3"]) == (2.0, 3.0, 4.0)
    assert b["whisker_high"] == 4.0 and b["n_outliers"] == 1


def test_correlation_zero_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in summary.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert math.isclose(got[("a", "b")], 1.0) and got[("a", "b")] == got[("b", "a")]
    assert got[("a", "c")] is None and got[("c", "c")] is None


def test_top_categories_and_missing_map(spark):
    df = spark.createDataFrame([(i, ["a", "b", "b", None][i % 4]) for i in range(8)], "rid int, s string")
    assert [tuple(r) for r in summary.top_categories(df, "s", 10).collect()] == [("b", 4), ("a", 2)]
    mm = {(r["block"], r["column"]): r["n_missing"] for r in summary.missing_map(df, "rid", 4).collect()}
    assert mm == {(0, "s"): 1, (1, "s"): 1}
