"""DuckDB SQL that recomputes the library's results independently.

Used as the oracle of the registered queries: for a fixture view with known
columns it writes the detectors, score, profile and cleaning steps as plain SQL
(RE2 regexes, `quantile_cont`, window functions), so every Spark result is
checked against a second engine on the same parquet tables.
"""

from __future__ import annotations

from typing import Sequence

from .fixtures import VIEWS

# --- Fixed values, written here apart from the engine's: they must equal the reference's for equal results. ---
WS = r"^\s+|\s+$|\s{2,}"
NUM = r"^-?\d+(\.\d+)?$"
EDGE = r"^\s+|\s+$"
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# --- End of fixed values. ---

# column kinds: int (bigint), int4 (int), double, string, timestamp
VIEW_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "dirty_events": [("event_id", "int"), ("ts", "timestamp"), ("user_id", "int"),
                     ("user_id_copy", "int"), ("event_type", "string"), ("value", "double"),
                     ("mixed", "string"), ("flag", "string"), ("status", "string")],
    "dirty_customer": [("c_custkey", "int"), ("c_name", "string"), ("c_mktsegment", "string"),
                       ("c_acctbal", "double"), ("email", "string"), ("active", "string"),
                       ("joined", "string")],
    "dirty_lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"),
                       ("l_linenumber", "int4"), ("l_quantity", "double"),
                       ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                       ("l_returnflag", "string"), ("l_linestatus", "string"),
                       ("l_shipdate", "timestamp")],
    "dirty_embeddings": [("vec_id", "int"), ("embedding", "array"), ("label", "int4")],
    "readme_messy": [("Name", "string"), ("Age", "int"), ("City", "string"), ("Flag", "string")],
    "crm": [("CustomerID", "int"), ("CustomerID_Copy", "int"), ("Name", "string"), ("City", "string"),
            ("Age", "int"), ("Salary", "double"), ("Department", "string"), ("IsActive", "string"),
            ("JoinDate", "string"), ("Region", "string")],
}

# the given tables (kind "array": nulls counted, compared in whole rows, values not
# profiled)
VIEW_COLUMNS.update({
    "region": [("r_regionkey", "int4"), ("r_name", "string")],
    "nation": [("n_nationkey", "int4"), ("n_name", "string"), ("n_regionkey", "int4")],
    "customer": [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int4"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "int"), ("s_name", "string"), ("s_nationkey", "int4"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int4"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"),
                 ("l_linenumber", "int4"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "events": [("event_id", "int"), ("ts", "timestamp"), ("user_id", "int"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "int")],
    "embeddings": [("vec_id", "int"), ("embedding", "array"), ("label", "int4")],
    "pages": [("page_id", "int"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "int"), ("text", "string")],
    "labels": [("doc_id", "int"), ("quality", "int4"), ("toxic", "int4")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "string"), ("text", "string")],
})

DETECTOR_RANK = {"missing": 0, "dup_rows": 1, "dup_cols": 2, "constant": 3, "high_card": 4,
                 "whitespace": 5, "case": 6, "mixed": 7}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def val(c: str, kind: str) -> str:
    """The value with NaN as null."""
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if kind == "double" else c


def missing(c: str, kind: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if kind == "double" else f"{c} IS NULL"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE}', '', 'g')"


def with_view(view: str, body: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    ctes = ([f"{view} AS (\n{VIEWS[view]}\n)"] if view in VIEWS else []) + \
        [f"{n} AS (\n{s}\n)" for n, s in extra]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def profiled(view: str) -> list[tuple[str, str]]:
    return [(c, k) for c, k in VIEW_COLUMNS[view] if k != "array"]


def stats_ctes(view: str, head: int | None = None) -> list[tuple[str, str]]:
    """Per-column metrics; with `head`, the case and mixed-type checks read only
    the first `head` non-null values of each text column by `rid`."""
    cols = profiled(view)
    parts = ["count(*) AS n"]
    for i, (c, k) in enumerate(cols):
        parts.append(f"count(*) FILTER (WHERE {missing(c, k)}) AS m{i}")
        parts.append(f"count(DISTINCT {val(c, k)}) AS u{i}")
        if k == "string":
            parts.append(f"coalesce(bool_or(regexp_matches({c}, '{WS}')), false) AS w{i}")
            parts.append(f"count(*) FILTER (WHERE regexp_matches({c}, '{NUM}')) AS d{i}")
    # nested columns, with the number of profiled columns before each: only nulls count
    nested = [(c, sum(k2 != "array" for _, k2 in VIEW_COLUMNS[view][:j]))
              for j, (c, k) in enumerate(VIEW_COLUMNS[view]) if k == "array"]
    parts += [f"count(*) FILTER (WHERE {c} IS NULL) AS x{c}" for c, _ in nested]
    ctes = [("s", f"SELECT {', '.join(parts)} FROM {view}")]
    rows = []
    for i, (c, k) in enumerate(cols):
        top = (f"(SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM {view} "
               f"WHERE NOT {missing(c, k)} GROUP BY {c}))")
        if k == "string":
            src = (f"(SELECT {c} AS v FROM {view} WHERE {c} IS NOT NULL ORDER BY rid LIMIT {head})"
                   if head else f"(SELECT {c} AS v FROM {view} WHERE {c} IS NOT NULL)")
            case = (f"(SELECT coalesce(bool_or(mn <> mx), false) FROM (SELECT min(st) AS mn, max(st) AS mx "
                    f"FROM (SELECT {strip('v')} AS st FROM {src}) "
                    f"WHERE st <> '' GROUP BY lower(st)))")
            ws = f"s.w{i}"
            if head:
                dig = f"(SELECT count(*) FILTER (WHERE regexp_matches(v, '{NUM}')) FROM {src})"
                sampled = f"(SELECT count(*) FROM {src})"
            else:
                dig, sampled = f"s.d{i}", f"s.n - s.m{i}"
        else:
            case, ws, dig, sampled = "false", "false", "0", f"s.n - s.m{i}"
        numeric = "true" if k in ("int", "int4", "double") else "false"
        rows.append(f"SELECT {q(c)} AS col, {i} AS ord, {q(k)} AS kind, {numeric} AS numeric, "
                    f"s.n AS n, s.m{i} AS miss, s.u{i} AS uniq, {top} AS top, {ws} AS ws, "
                    f"{dig} AS dig, s.n - s.m{i} AS nn, {sampled} AS sampled, {case} AS casemix FROM s")
    for c, at in nested:
        rows.append(f"SELECT {q(c)} AS col, {at - 0.5} AS ord, 'array' AS kind, false AS numeric, s.n AS n, "
                    f"s.x{c} AS miss, NULL AS uniq, NULL AS top, false AS ws, 0 AS dig, s.n - s.x{c} AS nn, "
                    f"0 AS sampled, false AS casemix FROM s")
    ctes.append(("cs", "\nUNION ALL\n".join(rows)))
    distinct = ", ".join(c for c, _ in VIEW_COLUMNS[view])
    ctes.append(("dr", f"SELECT (SELECT count(*) FROM {view}) - "
                       f"(SELECT count(*) FROM (SELECT DISTINCT {distinct} FROM {view})) AS dup"))
    pairs = []
    for i, (a, ka) in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b, kb = cols[j]
            if ka == kb:
                pairs.append(f"SELECT {q(b)} AS b, {j} AS ob, {i} AS oa, "
                             f"coalesce(bool_and({val(a, ka)} IS NOT DISTINCT FROM {val(b, kb)}), true) AS eq "
                             f"FROM {view}")
    if pairs:
        ctes.append(("eqp", "\nUNION ALL\n".join(pairs)))
        ctes.append(("dc", "SELECT b, ob, min(oa) AS base FROM eqp WHERE eq GROUP BY b, ob"))
    else:
        ctes.append(("dc", "SELECT NULL::VARCHAR AS b, 0 AS ob, 0 AS base WHERE false"))
    return ctes


def _issue(issue_id: str, category: str, title: str, severity: str, affected: str, ratio: str,
           method: str, alts: Sequence[str], det: str, sub: int, source: str, cond: str) -> str:
    sev_rank = (f"CASE {severity} WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 "
                f"ELSE 3 END")
    return (f"SELECT {q(issue_id)} AS issue_id, {q(category)} AS category, {q(title)} AS title, "
            f"{severity} AS severity, {affected} AS affected_columns, {ratio} AS affected_ratio, "
            f"{method} AS recommended_method, {q(','.join(alts))} AS alternative_methods, "
            f"{sev_rank} AS sev_rank, {DETECTOR_RANK[det]} AS det_rank, {sub} AS sub_rank "
            f"FROM {source} HAVING {cond}")


def issue_selects(view: str) -> dict[str, list[str]]:
    k = len(VIEW_COLUMNS[view])
    agg = "string_agg(col, ',' ORDER BY ord)"
    n = "max(n)"
    out = {}
    out["missing"] = [_issue(
        "missing_values", "missing_values", "Missing Values",
        f"(CASE WHEN max(miss) / {n} >= 0.30 THEN 'HIGH' WHEN max(miss) / {n} >= 0.05 THEN 'MEDIUM' "
        f"ELSE 'LOW' END)", agg, f"sum(miss) / ({n} * {k})",
        "(CASE WHEN bool_or(numeric) THEN 'fill_median' WHEN bool_or(kind <> 'array') THEN 'fill_mode' "
        "ELSE 'review_manually' END)",
        ["fill_mean", "fill_mode", "forward_fill", "backward_fill", "interpolate", "drop_rows",
         "drop_columns"], "missing", 0, "(SELECT * FROM cs WHERE miss > 0)", "count(*) > 0")]
    ratio = "max(dup) / (SELECT count(*) FROM {v})".format(v=view)
    out["dup_rows"] = [_issue(
        "duplicate_rows", "duplicate_rows", "Duplicate Rows",
        f"(CASE WHEN {ratio} > 0.10 THEN 'HIGH' WHEN {ratio} > 0.02 THEN 'MEDIUM' ELSE 'LOW' END)",
        "''", ratio, "'drop_duplicate_rows'", ["drop_duplicate_rows_keep_last"], "dup_rows", 0,
        "dr", f"max(dup) > 0 AND (SELECT count(*) FROM {view}) > 0")]
    out["dup_cols"] = [_issue(
        "duplicate_columns", "duplicate_columns", "Duplicate Columns",
        f"(CASE WHEN count(*) / {k} > 0.05 THEN 'MEDIUM' ELSE 'LOW' END)",
        "string_agg(b, ',' ORDER BY base, ob)", f"count(*) / {k}", "'drop_duplicate_columns'", [],
        "dup_cols", 0, "dc", "count(*) > 0")]
    out["constant"] = [
        _issue("constant_columns", "constant_columns", "Constant Columns", "'LOW'", agg,
               f"count(*) / {k}", "'drop_columns'", ["keep_as_metadata"], "constant", 0,
               "(SELECT * FROM cs WHERE uniq <= 1 AND n > 0)", "count(*) > 0"),
        _issue("near_constant_columns", "constant_columns", "Near-Constant Columns", "'LOW'", agg,
               f"count(*) / {k}", "'review_manually'", ["drop_columns"], "constant", 1,
               "(SELECT * FROM cs WHERE uniq > 1 AND top / nn >= 0.99 AND n > 0)", "count(*) > 0")]
    out["high_card"] = [_issue(
        "high_cardinality", "high_cardinality", "High Cardinality Columns", "'LOW'", agg,
        f"count(*) / {k}", "'frequency_encoding'", ["drop_columns", "keep_as_identifier"],
        "high_card", 0, "(SELECT * FROM cs WHERE NOT numeric AND n >= 10 AND uniq / n >= 0.90)",
        "count(*) > 0")]
    out["whitespace"] = [_issue(
        "whitespace_issues", "invalid_values", "Whitespace Issues", "'LOW'", agg, f"count(*) / {k}",
        "'trim_spaces'", ["remove_all_whitespace"], "whitespace", 0,
        "(SELECT * FROM cs WHERE kind = 'string' AND ws)", "count(*) > 0")]
    out["case"] = [_issue(
        "inconsistent_capitalization", "invalid_values", "Inconsistent Capitalization", "'LOW'",
        agg, f"count(*) / {k}", "'title_case'", ["lower_case", "upper_case"], "case", 0,
        "(SELECT * FROM cs WHERE kind = 'string' AND casemix)", "count(*) > 0")]
    out["mixed"] = [_issue(
        "mixed_dtypes", "wrong_dtypes", "Mixed Data Types", "'MEDIUM'", agg, f"count(*) / {k}",
        "'convert_to_numeric'", ["convert_to_string", "review_manually"], "mixed", 0,
        "(SELECT * FROM cs WHERE kind = 'string' AND sampled > 0 AND dig / sampled > 0.1 "
        "AND dig / sampled < 0.9)",
        "count(*) > 0")]
    return out


ISSUE_OUT = ("CAST(row_number() OVER (ORDER BY sev_rank, det_rank, sub_rank) - 1 AS INTEGER) AS position, "
             "issue_id, category, title, severity, affected_columns, "
             "round(affected_ratio, 9) AS affected_ratio, recommended_method, alternative_methods")


def issues_ctes(view: str, detectors: Sequence[str] | None = None, head: int | None = None
                ) -> list[tuple[str, str]]:
    sel = issue_selects(view)
    chosen = [s for d in (detectors or list(DETECTOR_RANK)) for s in sel[d]]
    return stats_ctes(view, head) + [("iss", "\nUNION ALL\n".join(chosen))]


def issues_sql(view: str, detectors: Sequence[str] | None = None, where: str = "",
               head: int | None = None) -> str:
    body = f"SELECT {ISSUE_OUT} FROM iss"
    if where:
        body = f"SELECT * FROM ({body}) WHERE {where}"
    return with_view(view, body, issues_ctes(view, detectors, head))


# --- Fixed values, written here apart from the engine's: they must equal the reference's for equal results. ---
WEIGHTS = {"missing_values": 25.0, "duplicate_rows": 15.0, "duplicate_columns": 5.0,
           "outliers": 15.0, "wrong_dtypes": 10.0, "invalid_values": 15.0,
           "constant_columns": 5.0, "high_cardinality": 5.0, "encoding_issues": 5.0}
LABELS = ((90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Needs Cleaning"), (0, "Poor"))
# --- End of fixed values. ---


def _weight_case() -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in WEIGHTS.items())
    return f"(CASE category {arms} ELSE 5.0 END)"


def breakdown_ctes() -> list[tuple[str, str]]:
    w = _weight_case()
    return [("bd", f"SELECT category, CAST(round(least({w}, {w} * max_r * 3), 2) AS DECIMAL(10,2)) AS pl "
                   f"FROM (SELECT category, max(affected_ratio) AS max_r FROM iss GROUP BY category) "
                   f"WHERE round(least({w}, {w} * max_r * 3), 2) > 0")]


def breakdown_sql(view: str) -> str:
    return with_view(view, "SELECT category, CAST(pl AS DOUBLE) AS points_lost FROM bd",
                     issues_ctes(view) + breakdown_ctes())


def score_sql(view: str) -> str:
    label = " ".join(f"WHEN score >= {at} THEN {q(name)}" for at, name in LABELS)
    body = (f"SELECT score, CASE {label} END AS label, "
            "points_lost FROM (SELECT greatest(0.0, least(100.0, CAST(round(100 - coalesce(sum(pl), 0), 1) AS DOUBLE))) "
            "AS score, CAST(coalesce(sum(pl), 0) AS DOUBLE) AS points_lost FROM bd)")
    return with_view(view, body, issues_ctes(view) + breakdown_ctes())
