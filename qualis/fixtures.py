"""Derived dirty views over the given tables.

The raw tables are clean, so detectors and cleaning steps are exercised on
views that Spark derives from them (whole tables, with dirt injected by rule).
Each SQL text runs unchanged in Spark and DuckDB; `rid` is the row order and is
left out of duplicate detection, profiling and scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIRTY_EVENT_COLUMNS = """
       CASE WHEN event_id % 5 = 0 THEN upper(event_type)
            WHEN event_id % 11 = 0 THEN concat('  ', event_type, ' ')
            WHEN event_id % 13 = 0 THEN NULL ELSE event_type END{a1},
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END{a2},
       CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE CAST(user_id AS STRING) END{a3},
       'X'{a4},
       CASE WHEN event_id = 17 THEN 'fraud' ELSE 'ok' END{a5}"""

DIRTY_EVENTS = (
    "SELECT event_id * 2 AS rid, event_id, ts, user_id, user_id AS user_id_copy,"
    + _DIRTY_EVENT_COLUMNS.format(a1=" AS event_type", a2=" AS value", a3=" AS mixed",
                                  a4=" AS flag", a5=" AS status")
    + "\nFROM events\nUNION ALL\nSELECT event_id * 2 + 1, event_id, ts, user_id, user_id,"
    + _DIRTY_EVENT_COLUMNS.format(a1="", a2="", a3="", a4="", a5="")
    + "\nFROM events WHERE event_id % 20 = 0"
)

DIRTY_CUSTOMER = """SELECT c_custkey AS rid, c_custkey,
       CASE WHEN c_custkey % 4 = 0 THEN lower(c_name) ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 10 < 4 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 6 = 0 THEN concat('user', CAST(c_custkey AS STRING), '.example.com')
            ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
       CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS active,
       CASE WHEN c_custkey % 9 = 0 THEN 'n/a'
            ELSE concat('2024-01-', CAST(10 + c_custkey % 19 AS STRING)) END AS joined
FROM customer"""

# lineitem with gaps: the bench table for order-dependent fills and cleaning plans.
# (l_orderkey, l_linenumber, l_partkey, l_suppkey) is unique in the given data;
# rid packs it in that order (unique while l_partkey < 100000 and l_suppkey < 10000;
# beyond, equal keys are ordered by the fills' row hash).
DIRTY_LINEITEM = """SELECT (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS rid,
       l_orderkey, l_partkey,
       l_suppkey, l_linenumber,
       CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       CASE WHEN (l_orderkey * 3 + l_linenumber) % 11 < 2 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
       l_discount, l_tax,
       CASE WHEN l_orderkey % 17 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag,
       CASE WHEN l_orderkey % 13 = 0 THEN concat(' ', l_linestatus, '  ') ELSE l_linestatus END AS l_linestatus,
       l_shipdate
FROM lineitem"""

# Model-style JSON replies: fenced, prefixed, and broken ones.
RESPONSES = """SELECT event_id AS rid,
       CASE WHEN event_id % 4 = 0 THEN concat('```json\n', props, '\n```')
            WHEN event_id % 4 = 1 THEN concat('  ', props, ' ')
            WHEN event_id % 9 = 2 THEN concat(props, '}')
            WHEN event_id % 9 = 3 THEN concat('Sure! ', props)
            ELSE props END AS response
FROM events"""

# A customer file shaped like the one in the interactive tool's run log: ten
# columns, a copied id column, spaces and mixed case in names and cities, gaps in
# age and salary, a high-cardinality join date, a constant region, repeated rows.
_CRM_COLUMNS = """c_custkey AS CustomerID, c_custkey AS CustomerID_Copy,
       CASE WHEN c_custkey % 5 = 0 THEN concat('  ', lower(c_name), ' ')
            WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS Name,
       CASE WHEN c_custkey % 4 = 0 THEN concat(lower(n_name), '  ') ELSE n_name END AS City,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 18 + c_custkey % 50 END AS Age,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal * 10, 2) END AS Salary,
       c_mktsegment AS Department,
       CASE WHEN c_custkey % 3 = 0 THEN 'yes' WHEN c_custkey % 3 = 1 THEN 'NO' ELSE 'Yes' END AS IsActive,
       concat(CAST(2000 + CAST(floor(c_custkey / 336) AS BIGINT) AS STRING), '-',
              lpad(CAST(1 + CAST(floor((c_custkey % 336) / 28) AS BIGINT) AS STRING), 2, '0'), '-',
              lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')) AS JoinDate,
       'North' AS Region
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

CRM = ("SELECT c_custkey * 2 AS rid, " + _CRM_COLUMNS
       + "\nUNION ALL\nSELECT c_custkey * 2 + 1 AS rid, "
       + _CRM_COLUMNS
       + "\nWHERE c_custkey % 25 = 0")

# The messy table the tool's README generates for a manual check: repeated names
# in two spellings and with edge spaces, ages missing for a tenth of the rows,
# cities in mixed case, a constant flag. One row per customer.
README_MESSY = """SELECT c_custkey AS rid,
       CASE c_custkey % 4 WHEN 0 THEN 'Alice' WHEN 1 THEN 'alice' WHEN 2 THEN 'Bob' ELSE ' Bob ' END AS Name,
       CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE 18 + (c_custkey * 7) % 42 END AS Age,
       CASE c_custkey % 3 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'mumbai' ELSE 'Delhi' END AS City,
       'X' AS Flag
FROM customer"""

# embeddings with a third of the vectors missing
DIRTY_EMBEDDINGS = """SELECT vec_id AS rid, vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE embedding END AS embedding,
       label
FROM embeddings"""

# phone numbers as text in several spellings, as whole numbers, and a number that is none
CONTACTS = """SELECT c_custkey AS rid,
       CASE c_custkey % 6 WHEN 0 THEN concat('+91 98765 ', lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'))
            WHEN 1 THEN concat('(040) 555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
            WHEN 2 THEN concat('12-', CAST(c_custkey % 100 AS STRING))
            WHEN 3 THEN '  ' WHEN 4 THEN concat('1234567890123456', CAST(c_custkey AS STRING)) END AS phone,
       c_custkey * 1003 AS number, c_acctbal AS balance
FROM customer"""

VIEWS = {
    "dirty_embeddings": DIRTY_EMBEDDINGS,
    "contacts": CONTACTS,
    "dirty_events": DIRTY_EVENTS,
    "dirty_customer": DIRTY_CUSTOMER,
    "dirty_lineitem": DIRTY_LINEITEM,
    "responses": RESPONSES,
    "crm": CRM,
    "readme_messy": README_MESSY,
}

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view, read from `sf_dir`."""
    if name in VIEWS:
        register_tables(spark, sf_dir, _sources(name))
        return spark.sql(VIEWS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(view: str) -> tuple[str, ...]:
    return tuple(t for t in BASE_TABLES if f"FROM {t}" in VIEWS[view] or f"JOIN {t} " in VIEWS[view])
