"""Value audits: rule checks per column, boolean-like text columns, and fenced
JSON replies. Native predicates and aggregates, but for JSON texts that Spark's parser
refuses, which Python reads again."""

from __future__ import annotations

import json
from typing import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..config import BOOLEAN_VOCABULARIES
from ..functions import text as tx
from ..functions.columns import col_ref
from ..functions.types import is_string
from ..functions.validators import RULES, boolean_words, rule_check
from .vf import stacked_values


def audit_values(df: DataFrame, rules: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """column, rule, n_non_null, n_valid, n_invalid, invalid_ratio for each
    (column, rule) pair, from a single aggregate over the table."""
    pairs = []
    for col, rs in rules.items():
        for r in ([rs] if isinstance(rs, str) else list(rs)):
            if r not in RULES:
                raise KeyError(f"Unknown rule: '{r}'")
            pairs.append((col, r))
    aggs = []
    for i, (col, r) in enumerate(pairs):
        ok = rule_check(r, col, df.schema[col].dataType)
        aggs += [F.count(col_ref(col)).alias(f"n{i}"), F.count_if(ok).alias(f"v{i}")]
    row = df.agg(*aggs)
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(col).alias("column"), F.lit(r).alias("rule"),
                 F.col(f"n{i}").alias("n_non_null"), F.col(f"v{i}").alias("n_valid"))
        for i, (col, r) in enumerate(pairs)])).alias("a")).select("a.*")
    return long.select("column", "rule", "n_non_null", "n_valid",
                       (F.col("n_non_null") - F.col("n_valid")).alias("n_invalid"),
                       F.try_divide(F.col("n_non_null") - F.col("n_valid"), F.col("n_non_null"))
                       .alias("invalid_ratio"))


def boolean_like_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_distinct, values, boolean_like for text columns whose distinct
    stripped, lower-cased, non-blank values number at most 4 and all belong to one
    known two-value vocabulary. Every column has a row; without such values n_distinct
    is 0. No set of a column's values is ever collected: only values from the fixed
    vocabularies are gathered, and values longer than any of those are grouped by a
    128-bit hash, so long texts are not shuffled."""
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if is_string(f.dataType)]
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    found = names.join(_boolean_like(df, cols, boolean_words()), "column", "left") if cols else None
    if found is None:
        return df.sparkSession.createDataFrame(
            [], "column string, n_distinct bigint, values array<string>, boolean_like boolean")
    none = F.col("n_distinct").isNull()
    return found.select("column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
                        F.when(none, F.array().cast("array<string>")).otherwise(F.col("values")).alias("values"),
                        F.coalesce("boolean_like", F.lit(False)).alias("boolean_like"))


def _boolean_like(df: DataFrame, cols: Sequence[str], words: list[str]) -> DataFrame:
    v = F.lower(tx.strip(F.col("value")))
    longest = max(map(len, words))
    low = (stacked_values(df, cols).select("column", v.alias("l")).where(F.col("l") != "")
           .select("column", F.when(F.length("l") <= longest, F.col("l")).otherwise(
               F.concat(F.hex(F.xxhash64("l")), F.hex(F.xxhash64(F.lit(1), "l")), F.lit(" " * longest))).alias("l"))
           .distinct())
    l = F.col("l")
    per_vocab = [F.bool_and(l.isin(*pair)).alias(f"v{i}") for i, pair in enumerate(BOOLEAN_VOCABULARIES)]
    agg = low.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.array_sort(F.collect_set(F.when(l.isin(*words), l))).alias("values"),
        *per_vocab)
    any_vocab = F.lit(False)
    for i in range(len(BOOLEAN_VOCABULARIES)):
        any_vocab = any_vocab | F.col(f"v{i}")
    return agg.select("column", F.col("n_distinct").cast("bigint").alias("n_distinct"),
                      F.when(F.col("n_distinct") <= 4, F.col("values")).alias("values"),
                      ((F.col("n_distinct") <= 4) & any_vocab).alias("boolean_like"))


def clean_json_text(c):
    """Strip; when fenced with ``` drop the backticks at both ends and a leading
    `json` tag; strip again."""
    s = tx.strip(c)
    fenced = F.startswith(s, F.lit("```"))
    unfenced = F.regexp_replace(s, r"^`+|`+$", "")
    tagged = F.lower(unfenced).startswith("json")
    body = F.when(fenced & tagged, F.substring(unfenced, 5, 1 << 30)).when(fenced, unfenced).otherwise(s)
    return tx.strip(body)


def is_single_json(s):
    """True when `s` is exactly one JSON value. The parser stops after the first value
    and ignores what follows, so the text is parsed inside `[...]`, which must give an
    array of one element, and inside `{"v":...}`: no character after a value closes both."""
    in_array = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
    one = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
    return F.coalesce(one & in_object.isNotNull(), F.lit(False))


@F.pandas_udf(T.StringType())
def _with_last_values(s: pd.Series) -> pd.Series:
    """JSON texts with repeated names, each with its last value; null where the text is no JSON value."""
    def refuse(word):
        raise ValueError(word)

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text, parse_constant=refuse), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None
    return s.map(one)


def parse_json_responses(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep..., cleaned, is_valid, parsed (VARIANT): each reply as JSON, null when invalid.
    Standard JSON only: the bare words NaN and Infinity are invalid. A name may be repeated in an object: its last
    value counts. Spark's parser refuses such texts, so only what it refuses is read again in Python."""
    cleaned = clean_json_text(col_ref(column))
    read = df.select(*[col_ref(c).alias(f"k{i}") for i, c in enumerate(keep)], cleaned.alias("cleaned"))
    read = read.withColumn("plain", is_single_json(F.col("cleaned")))
    read = read.withColumn("again", _with_last_values(F.when(~F.col("plain"), F.col("cleaned"))))
    text = F.when(F.col("plain"), F.col("cleaned")).otherwise(F.col("again"))
    parsed = F.try_parse_json(text)
    return read.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "cleaned",
                       (F.col("plain") | parsed.isNotNull()).alias("is_valid"), parsed.alias("parsed"))


def json_response_summary(df: DataFrame, column: str) -> DataFrame:
    """n, n_valid, n_invalid, invalid_ratio over a column of replies."""
    p = parse_json_responses(df.where(col_ref(column).isNotNull()), column)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid")).select(
        "n", "n_valid", (F.col("n") - F.col("n_valid")).alias("n_invalid"),
        F.try_divide(F.col("n") - F.col("n_valid"), F.col("n")).alias("invalid_ratio"))
