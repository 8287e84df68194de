"""Checks beyond the eight detectors: outliers and skew, rare categories and imbalance, related columns,
number rules. They have their own thresholds and do not enter `detect_all` or the score.

Every check is a few aggregates over all rows and all columns together, whose rows are per column (or per
pair of columns, or per common category); rows that break a rule come from a projection of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col_ref
from ..functions.missing import is_missing, normalized
from ..functions.types import is_atomic, is_number, is_string
from .gram import pair_correlations
from .quantile import quantiles

# --- Fixed values: these must equal the reference's for equal results. ---
OUTLIER_IQR_MULTIPLIER = 1.5
OUTLIER_ZSCORE = 3.0
RARE_CATEGORY_THRESHOLD = 0.01
HIGH_CORRELATION = 0.90
SKEW_THRESHOLD = 1.0
# --- End of fixed values. ---
MAD_SCALE = 1.4826  # of the median absolute deviation, to estimate a normal standard deviation
IMBALANCE_SHARE = 0.90
RULE_TOLERANCE = 0.01  # a rule that at most this share of the values breaks is taken to be meant
MAX_DECIMALS = 6


def _numbers(df: DataFrame, columns: Sequence[str] | None, order_by: str | None) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in df.columns if c != order_by] if columns is None else list(dict.fromkeys(columns))
    return [c for c in names if is_number(types[c])]


def _number(df: DataFrame, c: str) -> Column:
    """The finite number, else null."""
    x = normalized(c, df.schema[c].dataType).cast("double")
    return F.when(F.abs(x) != float("inf"), x)


# --- outliers and skew ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Spread:
    """What is known of a column's finite numbers; None without values."""

    n: int
    mean: float | None
    stddev: float | None
    skewness: float | None
    q1: float | None
    median: float | None
    q3: float | None
    mad: float | None

    def bounds(self, method: str) -> tuple[float, float] | None:
        """The least and the greatest number that is no outlier."""
        if method == "iqr" and self.q1 is not None:
            reach = OUTLIER_IQR_MULTIPLIER * (self.q3 - self.q1)
            return self.q1 - reach, self.q3 + reach
        if method == "zscore" and self.stddev:
            return self.mean - OUTLIER_ZSCORE * self.stddev, self.mean + OUTLIER_ZSCORE * self.stddev
        if method == "mad" and self.mad:
            reach = OUTLIER_ZSCORE * MAD_SCALE * self.mad
            return self.median - reach, self.median + reach
        return None


METHODS = ("iqr", "zscore", "mad")


def spreads(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None) -> dict[str, Spread]:
    """Central moments up to the third of all columns in one aggregate, quartiles by radix selection, and the median
    absolute deviation by a second selection over the distances from the medians."""
    cols = _numbers(df, columns, order_by)
    if not cols:
        return {}
    x = [_number(df, c) for c in cols]
    row = df.agg(*[a for i, v in enumerate(x) for a in (
        F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.skewness(v).alias(f"k{i}"))]).first()
    plain = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)])
    quartiles = quantiles(plain, plain.columns, [0.25, 0.5, 0.75])
    far = plain.select(*[F.abs(F.col(f"x{i}") - F.lit(quartiles[f"x{i}"][1])).cast("double").alias(f"x{i}") for i in range(len(cols))])
    mads = quantiles(far, far.columns, [0.5])

    def finite(v):
        return None if v is None or math.isnan(v) else v
    return {c: Spread(row[f"n{i}"], row[f"m{i}"], finite(row[f"s{i}"]), finite(row[f"k{i}"]), *quartiles[f"x{i}"], mads[f"x{i}"][0])
            for i, c in enumerate(cols)}


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None,
                   known: dict[str, Spread] | None = None) -> DataFrame:
    """Per number column: n, mean, stddev, skewness, is_skewed, median, mad and, for each method (1.5 quartile ranges,
    3 standard deviations, 3 scaled median deviations), how many values lie outside. A column whose deviation (or
    median deviation) is 0 has no outliers by that method."""
    found = known or spreads(df, columns, order_by)
    marks = [(i, m, s.bounds(m)) for i, s in enumerate(found.values()) for m in METHODS]
    cols = list(found)
    aggs = [F.count_if((_number(df, cols[i]) < b[0]) | (_number(df, cols[i]) > b[1])).alias(f"{m}{i}") for i, m, b in marks if b]
    counts = df.agg(*aggs).first().asDict() if aggs else {}
    rows = [(c, s.n, s.mean, s.stddev, s.skewness, s.skewness is not None and abs(s.skewness) > SKEW_THRESHOLD, s.median, s.mad,
             *[counts.get(f"{m}{i}", 0) for m in METHODS]) for i, (c, s) in enumerate(found.items())]
    return df.sparkSession.createDataFrame(
        rows, "column string, n long, mean double, stddev double, skewness double, is_skewed boolean, median double, mad double, "
              "n_iqr long, n_zscore long, n_mad long")


def outlier_rows(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None,
                 known: dict[str, Spread] | None = None, name: str = "outliers") -> DataFrame:
    """The rows that hold an outlier, with `name`: an array of (column, method), in the order of the columns."""
    found = known or spreads(df, columns, order_by)
    marks = []
    for c, s in found.items():
        for m in METHODS:
            if b := s.bounds(m):
                out = (_number(df, c) < b[0]) | (_number(df, c) > b[1])
                marks.append(F.when(out, F.struct(F.lit(c).alias("column"), F.lit(m).alias("method"))))
    flags = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<struct<column:string,method:string>>")
    return df.withColumn(name, flags).where(F.size(col_ref(name)) > 0)


# --- rare categories and imbalance -------------------------------------------------------------------

def _categories(df: DataFrame, columns: Sequence[str] | None, order_by: str | None) -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    if columns is None:
        return [c for c in df.columns if c != order_by and is_string(types[c])]
    return [c for c in dict.fromkeys(columns) if is_atomic(types[c])]


def category_shares(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None,
                    threshold: float = RARE_CATEGORY_THRESHOLD) -> DataFrame:
    """column, value, n, share of each category with at least `threshold` of its column's values, and one row with
    is_rare (and no value) for all others together, if there are any.

    A frequent-items sketch of value hashes, merged over tasks (all columns in one aggregate), gives candidates: all
    categories of that share, and at most 2 / threshold a column. A second pass counts these exactly; the others
    are what is left of the column's count. Values that are rare are never grouped.
    """
    cols = _categories(df, columns, order_by)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n long, share double, is_rare boolean")
    keep = math.ceil(2 / threshold)
    tracked = min(1_000_000, 20 * keep)  # the sketch's error is below a tenth of the threshold
    values = {c: normalized(c, df.schema[c].dataType) for c in cols}
    hashes = {c: F.when(v.isNotNull(), F.xxhash64(v)) for c, v in values.items()}
    plain = df.select(*[h.alias(f"h{i}") for i, h in enumerate(hashes.values())],
                      *[v.cast("string").alias(f"v{i}") for i, v in enumerate(values.values())])
    row = plain.agg(*[a for i in range(len(cols)) for a in (
        F.count(f"h{i}").alias(f"n{i}"), F.expr(f"approx_top_k(h{i}, {min(keep + 1, tracked)}, {tracked})").alias(f"t{i}"))]).first()
    hits = []
    for i, c in enumerate(cols):
        likely = [t["item"] for t in row[f"t{i}"] if t["item"] is not None and t["count"] >= threshold * row[f"n{i}"] * 0.9]
        if likely:
            hits.append(F.when(F.col(f"h{i}").isin(likely), F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))))
    totals = df.sparkSession.createDataFrame([(i, c, row[f"n{i}"]) for i, c in enumerate(cols)], "i int, column string, total long")
    if not hits:
        counted = df.sparkSession.createDataFrame([], "i int, value string, n long")
    else:
        counted = (plain.select(F.explode(F.array_compact(F.array(*hits))).alias("h"))
                   .groupBy(F.col("h.i").alias("i"), F.col("h.v").alias("value")).agg(F.count("*").alias("n")))
    common = counted.join(F.broadcast(totals), "i").where(F.col("n") >= F.col("total") * threshold)
    common = common.select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"), F.lit(False).alias("is_rare"))
    # at most 1 / threshold rows a column
    left = totals.join(common.groupBy("column").agg(F.sum("n").alias("k")), "column", "left")
    rest = F.col("total") - F.coalesce("k", F.lit(0))
    rare = left.where(rest > 0).select("column", F.lit(None).cast("string").alias("value"), rest.alias("n"),
                                       (rest / F.col("total")).alias("share"), F.lit(True).alias("is_rare"))
    return common.unionByName(rare)


def imbalance_report(shares: DataFrame) -> DataFrame:
    """From `category_shares`, per column: n_common, rare_share, top_value, top_share, entropy (natural; rare
    categories as one class), balance (entropy over its greatest possible value) and is_imbalanced."""
    order = F.struct((-F.col("n")).alias("n"), "value")
    classes = F.count("*")
    out = shares.groupBy("column").agg(
        F.count_if(~F.col("is_rare")).alias("n_common"),
        F.coalesce(F.sum(F.when(F.col("is_rare"), F.col("share"))), F.lit(0.0)).alias("rare_share"),
        F.min_by(F.when(~F.col("is_rare"), F.col("value")), F.when(~F.col("is_rare"), order)).alias("top_value"),
        F.max(F.when(~F.col("is_rare"), F.col("share"))).alias("top_share"),
        (-F.sum(F.col("share") * F.log("share"))).alias("entropy"), classes.alias("classes"))
    balance = F.when(F.col("classes") > 1, F.col("entropy") / F.log("classes"))
    return out.select("column", "n_common", "rare_share", "top_value", "top_share", "entropy", balance.alias("balance"),
                      F.coalesce(F.col("top_share") >= IMBALANCE_SHARE, F.lit(False)).alias("is_imbalanced"))


# --- related columns ---------------------------------------------------------------------------------

def cramers_v(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None) -> DataFrame:
    """col_a, col_b, n, cramers_v of each pair of category columns (in column order), over the rows where both are
    present; null where one of them has a single category.

    One grouped aggregate counts the cells of all pairs' contingency tables (partial counts before the shuffle, values
    as 128-bit hashes); chi-square needs of each cell its count and its row's and column's sums.
    """
    cols = _categories(df, columns, order_by)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n long, cramers_v double")
    hashed = []
    for i, c in enumerate(cols):
        v = normalized(c, df.schema[c].dataType)
        hashed.append(F.when(v.isNotNull(), F.struct(F.xxhash64(v).alias("x"), F.xxhash64(F.lit(7), v).alias("y"))).alias(f"h{i}"))
    pairs = list(combinations(range(len(cols)), 2))
    cells = F.array_compact(F.array(*[
        F.when(F.col(f"h{i}").isNotNull() & F.col(f"h{j}").isNotNull(),
               F.struct(F.lit(p).alias("p"), F.col(f"h{i}").alias("a"), F.col(f"h{j}").alias("b"))) for p, (i, j) in enumerate(pairs)]))
    counts = (df.select(*hashed).select(F.explode(cells).alias("c")).groupBy("c.p", "c.a", "c.b").agg(F.count("*").alias("k")))
    sums = counts.select("p", "k", F.sum("k").over(Window.partitionBy("p", "a")).alias("ra"),
                         F.sum("k").over(Window.partitionBy("p", "b")).alias("rb"))
    # a category's shares of its own sum add to 1 over its cells: their total counts the categories
    per = sums.groupBy("p").agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k") / F.col("ra") / F.col("rb")).alias("t"),
        F.sum(F.col("k") / F.col("ra")).alias("rows"), F.sum(F.col("k") / F.col("rb")).alias("columns"))
    least = F.least(F.round("rows"), F.round("columns")) - 1
    v = F.when(least > 0, F.least(F.sqrt(F.greatest(F.col("t") - 1, F.lit(0.0)) / least), F.lit(1.0)))
    names = df.sparkSession.createDataFrame([(p, cols[i], cols[j]) for p, (i, j) in enumerate(pairs)], "p int, col_a string, col_b string")
    return names.join(per.select("p", "n", v.alias("cramers_v")), "p", "left").select(
        "col_a", "col_b", F.coalesce("n", F.lit(0)).alias("n"), "cramers_v")


def related_columns(df: DataFrame, numbers: Sequence[str] | None = None, categories: Sequence[str] | None = None,
                    order_by: str | None = None, at_least: float = HIGH_CORRELATION) -> DataFrame:
    """kind, cluster, column: the groups of number columns linked by correlations of at least `at_least` (in size), and
    of category columns linked by Cramer's V of as much. A cluster is named by its first column; columns without
    a link are left out. The links of columns are at most as many as their pairs."""
    cols = _numbers(df, numbers, order_by)
    cats = _categories(df, categories, order_by)
    links = []
    if len(cols) > 1:
        found = pair_correlations(df, cols).where((F.col("a") < F.col("b")) & ~F.isnan("corr") & (F.abs("corr") >= at_least))
        links += [("number", cols[r.a], cols[r.b]) for r in found.collect()]
    if len(cats) > 1:
        links += [("category", r.col_a, r.col_b) for r in cramers_v(df, cats).where(F.col("cramers_v") >= at_least).collect()]
    rows = []
    for kind, names in (("number", cols), ("category", cats)):
        place = {c: i for i, c in enumerate(names)}
        root = list(range(len(names)))

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i
        for _, a, b in (x for x in links if x[0] == kind):
            low, high = sorted((find(place[a]), find(place[b])))
            root[high] = low
        linked = {c for k, a, b in links if k == kind for c in (a, b)}
        rows += [(kind, names[find(place[c])], c) for c in names if c in linked]
    return df.sparkSession.createDataFrame(rows, "kind string, cluster string, column string")


# --- number rules ------------------------------------------------------------------------------------

def _decimals(x: Column, d: int) -> Column:
    """Whether a number has at most d decimals."""
    return F.round(x, d) == x


@dataclass(frozen=True)
class Rule:
    column: str
    rule: str
    limit: float | None
    n: int
    n_violations: int

    def broken(self, df: DataFrame) -> Column:
        raw = normalized(self.column, df.schema[self.column].dataType).cast("double")
        x = _number(df, self.column)
        return F.coalesce({
            "finite": F.abs(raw) == float("inf"), "not_negative": x < 0, "not_positive": x > 0, "not_zero": x == 0,
            "decimals": ~_decimals(x, int(self.limit or 0))}[self.rule], F.lit(False))


def number_rules(df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None,
                 tolerance: float = RULE_TOLERANCE) -> list[Rule]:
    """The rules that a column's values seem meant to keep: finite; not negative, not positive, not zero; at most d
    decimals (0: whole numbers; the least d up to 6). A rule is inferred when it holds for all values but at most
    `tolerance` of them, and, for signs and decimals, when it says something: some value has the other sign (or is
    not zero), and d is below the decimals of a type that has none.

    One aggregate of counts for all columns: the counts are the state, and add over tasks."""
    cols = _numbers(df, columns, order_by)
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        raw = normalized(c, df.schema[c].dataType).cast("double")
        x = _number(df, c)
        aggs += [F.count(raw).alias(f"n{i}"), F.count_if(F.abs(raw) == float("inf")).alias(f"inf{i}"), F.count_if(x < 0).alias(f"neg{i}"),
                 F.count_if(x > 0).alias(f"pos{i}"), F.count_if(x == 0).alias(f"zero{i}"),
                 *[F.count_if(_decimals(x, d)).alias(f"d{d}_{i}") for d in range(MAX_DECIMALS + 1)]]
    row = df.agg(*aggs).first()
    rules = []
    for i, c in enumerate(cols):
        n, infinite, neg, pos, zero = (row[f"{k}{i}"] for k in ("n", "inf", "neg", "pos", "zero"))
        finite = n - infinite

        def meant(violations: int, of: int) -> bool:
            return of > 0 and violations <= tolerance * of
        if meant(infinite, n):
            rules.append(Rule(c, "finite", None, n, infinite))
        if pos and meant(neg, finite):
            rules.append(Rule(c, "not_negative", 0.0, finite, neg))
        if neg and meant(pos, finite):
            rules.append(Rule(c, "not_positive", 0.0, finite, pos))
        if (pos or neg) and meant(zero, finite):
            rules.append(Rule(c, "not_zero", 0.0, finite, zero))
        for d in range(MAX_DECIMALS + 1):
            if meant(finite - row[f"d{d}_{i}"], finite):
                rules.append(Rule(c, "decimals", float(d), finite, finite - row[f"d{d}_{i}"]))
                break
    return rules


def number_rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.sparkSession.createDataFrame([(r.column, r.rule, r.limit, r.n, r.n_violations) for r in rules],
                                           "column string, rule string, limit double, n long, n_violations long")


def number_rule_violations(df: DataFrame, rules: Sequence[Rule], name: str = "broken") -> DataFrame:
    """The rows that break a rule, with `name`: an array of (column, rule)."""
    marks = [F.when(r.broken(df), F.struct(F.lit(r.column).alias("column"), F.lit(r.rule).alias("rule"))) for r in rules if r.n_violations]
    flags = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<struct<column:string,rule:string>>")
    return df.withColumn(name, flags).where(F.size(col_ref(name)) > 0)
