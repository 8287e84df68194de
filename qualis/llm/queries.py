"""The registered queries of the operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, chat, decontam, extract, licenses, lm, neighbours, order, packing, repair, repetition, simhash, substrings

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.write_in_order(_read(spark, sf_dir, "documents"), order.order_folder(spark))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_read(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return extract.main_texts(pages, extract.fit_prices(pages))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(_read(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                 "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(more)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_counts(_read(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damaged(rows), rows)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_decontamination, op3_training_order, op4_repetition, op5_main_text,
        op6_lm_scores, op7_substring_dedup, op8_simhash, op9_chat_format, op10_packing,
        op11_neighbours, op12_alignment, op13_repair)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN p ON dw.k = p.k AND dw.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
         FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_OP6 = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
total AS (SELECT count(*) AS n FROM x),
known AS (SELECT word, count(*) AS n FROM x GROUP BY word),
m AS (SELECT doc_id, i, coalesce(known.word, '') AS word FROM x LEFT JOIN known ON x.word = known.word),
uni AS (SELECT word, count(*) AS n FROM m GROUP BY word),
g AS (SELECT a.doc_id, a.word AS u, b.word AS v FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
own AS (SELECT doc_id, u, v, count(*) AS own FROM g GROUP BY doc_id, u, v),
counts AS (SELECT u, v, sum(own) AS n FROM own GROUP BY u, v),
s AS (SELECT doc_id, sum(own * CASE WHEN counts.n > own THEN ln((counts.n - own) / cu.n)
                               ELSE ln(0.4::DOUBLE * cv.n / (SELECT n FROM total)) END) AS s
      FROM own JOIN counts USING (u, v) JOIN uni cu ON cu.word = own.u JOIN uni cv ON cv.word = own.v
      GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, greatest(len(w) - 1, 0)::BIGINT AS n_bigrams,
       round(s / (len(w) - 1), 6) AS score
FROM d LEFT JOIN s USING (doc_id)
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS m FROM x GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN first USING (k) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP9 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                            (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(regexp_replace(role, '(\\|</turn>|###|: )', '\\\1', 'g'))
              + length(regexp_replace(text, '(\\|</turn>|###)', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def _op13() -> str:
    """Row after row, with whole strings: each state (0 start, 1 after system, 2 after user, 3 after assistant) keeps its
    cheapest (cost, audit) and the turns repaired so far."""
    inserted = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    full = {2: "user", 3: "assistant"}
    ways: dict[int, list[str]] = {q: [f"struct_pack(c := s{q}.c + 2, a := s{q}.a || 'D', r := s{q}.r)"] for q in range(4)}

    def way(p, cost, audit, turns, condition):
        return (f"CASE WHEN {condition} THEN struct_pack(c := s{p}.c + {cost} + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, "
                f"a := s{p}.a || '{audit}', r := s{p}.r || {turns}) END")
    live = "fault NOT IN ('blank', 'duplicate')"
    for p in range(4):
        state, new = p, ""
        for k in range(3):
            before = (f"'{new}' || " if new else "")
            for (at, role), q in keeps.items():
                if at == state:
                    ways[q].append(way(p, 5 * k, "I" * k + "K", before + "role || ':' || text || chr(10)", f"{live} AND left(role, 1) = '{role}'"))
            q = inserted[state]
            ways[q].append(way(p, 5 * k + 1, "I" * k + "R", before + f"'{full[q]}:' || text || chr(10)", live))
            new += f"{full[q]}:' || chr(10) || '"
            state = q
    steps = ", ".join(f"list_sort(list_filter([{', '.join(w)}], lambda x: x IS NOT NULL))[1]" for q, w in sorted(ways.items()))
    far = "struct_pack(c := 1000000000::BIGINT, a := '', r := '')"
    end = ("list_sort([struct_pack(c := s0.c, a := s0.a, r := s0.r), struct_pack(c := s3.c, a := s3.a, r := s3.r), "
           "struct_pack(c := s2.c + 5, a := s2.a || 'I', r := s2.r || 'assistant:' || chr(10)), "
           "struct_pack(c := s1.c + 10, a := s1.a || 'II', r := s1.r || 'user:' || chr(10) || 'assistant:' || chr(10))])[1]")
    return rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT k, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
     lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 20 AS f
  FROM (SELECT DISTINCT k FROM keyed)),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed JOIN bits USING (k) WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  regexp_replace(text, '[ 	-]+$', '') AS body FROM damaged),
seen AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
solved(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, struct_pack(c := 0::BIGINT, a := '', r := ''), {far}, {far}, {far} FROM (SELECT DISTINCT conv_id FROM seen)
  UNION ALL
  SELECT solved.conv_id, seen.i, {steps}
  FROM solved JOIN seen ON solved.conv_id IS NOT DISTINCT FROM seen.conv_id AND seen.i = solved.i + 1),
best AS (SELECT conv_id, {end} AS e FROM solved WHERE i = (SELECT max(i) FROM seen WHERE seen.conv_id IS NOT DISTINCT FROM solved.conv_id)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(CASE WHEN e.r = '' THEN '' ELSE left(e.r, length(e.r) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON ids.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2, "op6_lm_scores": _OP6, "op7_substring_dedup": _OP7, "op9_chat_format": _OP9,
            "op13_repair": _op13()}
