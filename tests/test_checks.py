"""Outliers, rare categories, related columns and number rules against pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualis.operators import checks


def _numbers():
    rng = np.random.default_rng(0)
    x = {"norm": rng.normal(5, 2, 800), "skewed": np.exp(rng.normal(0, 1.2, 800)), "same": np.full(800, 3.0),
         "mostly": np.where(rng.random(800) < 0.9, 1.0, rng.normal(0, 50, 800))}
    pdf = pd.DataFrame(x)
    pdf[rng.random((800, 4)) < 0.1] = np.nan
    return pdf


def _frame(spark, pdf, schema):
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema).repartition(4)


def test_outliers_and_skew(spark):
    pdf = _numbers()
    pdf.insert(0, "rid", range(800))
    df = _frame(spark, pdf, "rid long, norm double, skewed double, same double, mostly double")
    known = checks.spreads(df, order_by="rid")
    got = {r["column"]: r for r in checks.outlier_report(df, known=known).collect()}
    flagged = {}
    for r in checks.outlier_rows(df, known=known).collect():
        for f in r.outliers:
            flagged.setdefault((f["column"], f["method"]), set()).add(r.rid)
    for c in ("norm", "skewed", "same", "mostly"):
        v = pdf[c].dropna()
        r = got[c]
        z = (v - v.mean()).abs() > 3 * v.std() if v.std() else v != v
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        iqr = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
        mad = (v - v.median()).abs().median()
        far = (v - v.median()).abs() > 3 * 1.4826 * mad if mad else v != v
        assert (r.n, r.n_iqr, r.n_zscore, r.n_mad) == (len(v), iqr.sum(), z.sum(), far.sum()), c
        assert r.mad == pytest.approx(mad) and r.stddev == pytest.approx(v.std())
        m = ((v - v.mean()) ** 3).mean() / ((v - v.mean()) ** 2).mean() ** 1.5 if v.std() else None
        assert r.skewness == (None if m is None else pytest.approx(m))
        assert r.is_skewed == (m is not None and abs(m) > 1)
        assert flagged.get((c, "iqr"), set()) == set(pdf["rid"][v[iqr].index])
        assert flagged.get((c, "zscore"), set()) == set(pdf["rid"][v[z].index])


def test_no_numbers_and_infinite(spark):
    df = spark.createDataFrame([(1.0, "a", None), (math.inf, "b", None), (2.0, None, None), (math.nan, "c", None)], "x double, s string, e double")
    r = {r["column"]: r for r in checks.outlier_report(df).collect()}
    assert (r["x"].n, r["x"].mean, r["x"].n_iqr) == (2, 1.5, 0) and r["e"].n == 0 and r["e"].mean is None
    assert checks.outlier_report(df.select("s")).collect() == [] and checks.outlier_rows(df.select("s")).collect() == []
    assert checks.outlier_report(df.limit(0)).where("n > 0").collect() == []


def test_rare_categories(spark):
    rng = np.random.default_rng(1)
    rows = [(("hot" if u < 0.6 else "warm" if u < 0.97 else f"rare{i}" if i % 2 else "few"), i % 7, None if i % 5 else "k", f"id{i}")
            for i, u in enumerate(rng.random(3000))]
    df = spark.createDataFrame(rows, "`a.b` string, g long, k string, unique string").repartition(5)
    shares = checks.category_shares(df, ["a.b", "g", "k", "unique"])
    got = {}
    for r in shares.collect():
        got.setdefault(r["column"], {})[r.value] = (r.n, r.share)
    for i, c in enumerate(("a.b", "g", "k", "unique")):
        v = pd.Series([r[i] for r in rows]).dropna().astype(str)
        v = v.str.replace(r"\.0$", "", regex=True)
        n = v.value_counts()
        common = {k: (int(m), m / len(v)) for k, m in n.items() if m >= 0.01 * len(v)}
        rest = len(v) - sum(m for m, _ in common.values())
        assert got[c] == {**common, **({None: (rest, rest / len(v))} if rest else {})}, c
    report = {r["column"]: r for r in checks.imbalance_report(shares).collect()}
    assert report["k"].is_imbalanced and report["k"].balance is None and not report["a.b"].is_imbalanced
    assert report["unique"].n_common == 0 and report["unique"].rare_share == 1.0 and report["unique"].top_value is None
    assert report["g"].balance == pytest.approx(1.0, abs=1e-3)
    p = np.array([s for _, s in got["a.b"].values()])
    assert report["a.b"].entropy == pytest.approx(-(p * np.log(p)).sum())
    assert checks.category_shares(df.limit(0), ["k"]).collect() == []


def _cramer(a, b):
    t = pd.crosstab(a, b).to_numpy().astype(float)
    n, e = t.sum(), np.outer(t.sum(1), t.sum(0)) / t.sum()
    k = min(t.shape) - 1
    return math.sqrt(((t - e) ** 2 / e).sum() / n / k) if k else None


def test_cramers_v_and_clusters(spark):
    rng = np.random.default_rng(2)
    a = rng.choice(list("xyz"), 600)
    b = np.array([{"x": "p", "y": "q", "z": "r"}[v] for v in a], object)
    c = np.where(rng.random(600) < 0.5, a, rng.choice(list("xyz"), 600))
    d = np.array([None if u < 0.3 else "one" for u in rng.random(600)], object)
    n1 = rng.normal(size=600)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "d": d, "n1": n1, "n2": -3 * n1 + 0.01 * rng.normal(size=600), "n3": rng.normal(size=600),
                        "n4": n1 + 0.05 * rng.normal(size=600)})
    df = _frame(spark, pdf, "a string, b string, c string, d string, n1 double, n2 double, n3 double, n4 double")
    got = {(r.col_a, r.col_b): r for r in checks.cramers_v(df).collect()}
    assert len(got) == 6
    for (x, y), r in got.items():
        both = pdf[[x, y]].dropna()
        want = _cramer(both[x], both[y])
        assert r.n == len(both) and r.cramers_v == (None if want is None else pytest.approx(want, abs=1e-9))
    clusters = {(r.kind, r["cluster"], r["column"]) for r in checks.related_columns(df).collect()}
    assert clusters == {("category", "a", "a"), ("category", "a", "b"), ("number", "n1", "n1"), ("number", "n1", "n2"), ("number", "n1", "n4")}
    assert checks.related_columns(df.limit(0)).collect() == []


def test_number_rules(spark):
    rows = [(i, float(i % 50) + 1 if i != 7 else -4.0, i * 0.25 if i != 9 else 0.123, float("inf") if i == 3 else -1.5 * i - 1, i % 3, i / 7)
            for i in range(500)]
    df = spark.createDataFrame(rows, "rid long, pos double, cents double, neg double, cat int, free double").repartition(3)
    rules = checks.number_rules(df, order_by="rid")
    got = {(r.column, r.rule): (r.limit, r.n_violations) for r in rules}
    assert got == {("pos", "finite"): (None, 0), ("pos", "not_negative"): (0.0, 1), ("pos", "not_zero"): (0.0, 0), ("pos", "decimals"): (0.0, 0),
                   ("cents", "finite"): (None, 0), ("cents", "not_negative"): (0.0, 0), ("cents", "not_zero"): (0.0, 1),
                   ("cents", "decimals"): (2.0, 1), ("neg", "finite"): (None, 1), ("neg", "not_positive"): (0.0, 0), ("neg", "not_zero"): (0.0, 0),
                   ("neg", "decimals"): (1.0, 0), ("cat", "finite"): (None, 0), ("cat", "not_negative"): (0.0, 0), ("cat", "decimals"): (0.0, 0),
                   ("free", "finite"): (None, 0), ("free", "not_negative"): (0.0, 0), ("free", "not_zero"): (0.0, 1)}
    broken = {r.rid: {(b["column"], b["rule"]) for b in r.broken} for r in checks.number_rule_violations(df, rules).collect()}
    assert broken == {7: {("pos", "not_negative")}, 9: {("cents", "decimals")}, 0: {("cents", "not_zero"), ("free", "not_zero")}, 3: {("neg", "finite")}}
    assert checks.number_rules(df.limit(0)) == [] and checks.number_rule_violations(df, []).collect() == []
