"""Correlations from Gram blocks, against two passes per pair (pairwise complete)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from qualis.operators import gram
from qualis.operators.summary import correlation_matrix


def _table(n=400, k=7, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)) @ rng.standard_normal((3, k)) + 0.5 * rng.standard_normal((n, k))
    x = x * 10.0 ** rng.integers(-3, 4, k) + 10.0 ** rng.integers(0, 8, k)
    x[rng.random((n, k)) < 0.2] = np.nan
    return pd.DataFrame(x, columns=[f"v.{i}" if i == 2 else f"v{i}" for i in range(k)])


def _spark(spark, pdf, parts):
    rows = [[None if v != v else float(v) for v in r] for r in pdf.values]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(parts)


@pytest.mark.parametrize("block,parts", [(128, 1), (3, 5), (1, 4)])
def test_equals_two_passes(spark, block, parts):
    pdf = _table()
    x = pdf.to_numpy()

    def expected(a, b):  # two passes over the rows where both are present
        both = x[~np.isnan(x[:, [a, b]]).any(1)][:, [a, b]]
        return np.corrcoef((both - both.mean(0)).T)[0, 1]
    got = gram.pair_correlations(_spark(spark, pdf, parts), list(pdf.columns), block).collect()
    assert len(got) == 49
    for r in got:
        assert r.corr == pytest.approx(expected(r.a, r.b), abs=1e-9)


def test_constant_absent_and_infinite(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0], "same": [0.1] * 4, "none": [math.nan] * 4, "b": [2.0, 1.0, math.nan, 5.0],
                        "inf": [1.0, math.inf, 3.0, math.nan], "part": [7.0, 7.0, 8.0, math.nan]})
    got = {(r.col_a, r.col_b): r.corr for r in correlation_matrix(_spark(spark, pdf, 3), list(pdf.columns)).collect()}
    for c in pdf.columns:
        assert got[c, "none"] is None and (got["same", c] is None or c == "inf")
    assert got["b", "part"] is None  # one value where b is present
    assert math.isnan(got["a", "inf"])
    assert got["a", "a"] == 1.0 and got["a", "part"] == pytest.approx(pdf["a"].corr(pdf["part"]))


def test_no_rows_and_whole_numbers(spark):
    empty = spark.createDataFrame([], "a long, b double")
    assert [r.corr for r in correlation_matrix(empty, ["a", "b"]).collect()] == [None] * 4
    df = spark.range(100).selectExpr("id AS a", "CAST(-2 * id AS decimal(12, 2)) AS b")
    got = {(r.col_a, r.col_b): r.corr for r in correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(-1.0) and got["b", "a"] == got["a", "b"]


def test_many_columns_one_scan(spark):
    """300 columns (in blocks) read the table once."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 300))
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(300)))
    out = correlation_matrix(df, df.columns)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    got = {(r.col_a, r.col_b): r.corr for r in out.collect()}
    expected = np.corrcoef(x.T)
    assert len(got) == 90000
    assert max(abs(got[f"c{i}", f"c{j}"] - expected[i, j]) for i in range(0, 300, 7) for j in range(300)) < 1e-9
