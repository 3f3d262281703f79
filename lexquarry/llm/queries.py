"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexquarry.llm import bfd_packing, capture_index, decision_list, embedding_join, language_crf, mixing, related_packing, secrets, suffix_levels, superminhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bfd_packing(spark, sf_dir):
    return bfd_packing.pack(_table(spark, sf_dir, "documents"))


def op2_embedding_pigeonhole(spark, sf_dir):
    return embedding_join.near_classes(_table(spark, sf_dir, "embeddings"))


def op3_superminhash_groups(spark, sf_dir):
    return superminhash.near_groups(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return decision_list.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_capture_index(spark, sf_dir):
    return capture_index.build_and_look_up(_table(spark, sf_dir, "pages"))


def op7_suffix_repeats(spark, sf_dir):
    return suffix_levels.repeats(_table(spark, sf_dir, "documents"))


def op8_related_packing(spark, sf_dir):
    return related_packing.pack(_table(spark, sf_dir, "documents"))


def op9_language_crf(spark, sf_dir):
    return language_crf.judge(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark, sf_dir):
    return mixing.select(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bfd_packing, op2_embedding_pigeonhole, op3_superminhash_groups, op4_secret_scan, op5_quality_rules, op6_capture_index, op7_suffix_repeats, op8_related_packing, op9_language_crf, op10_source_mixing]
    return {f.__name__: f for f in found}


_WHITE = "[ \\t\\n\\r\\f\\v]+"

OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
first AS (SELECT v, min(vec_id) AS id, count(*) AS n FROM e GROUP BY v),
u AS (SELECT id, n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS w, v FROM first),
near AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id WHERE list_dot_product(a.w, b.w) >= 0.95),
reach AS (SELECT id, id AS r FROM u UNION SELECT reach.id, near.b FROM reach JOIN near ON reach.r = near.a),
class AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id),
size AS (SELECT class_id, sum(n) AS class_size FROM class JOIN u USING (id) GROUP BY class_id),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, class_id, class_size::INT AS class_size, coalesce(links.n, 0)::INT AS n_links, (u.n - 1)::INT AS n_copies
FROM e JOIN u ON e.v = u.v JOIN class ON class.id = u.id JOIN size USING (class_id) LEFT JOIN links ON links.a = u.id
"""

_HEX, _ALNUM = "[0-9a-fA-F]", "[0-9a-zA-Z]"


def _class_sql(name: str, chars: str, window: int, least: float, rank: int) -> str:
    return f"""
SELECT doc_id, ordinal, secret, '{name}' AS char_class, {rank} AS rank, max(e) AS entropy FROM (
  SELECT doc_id, ordinal, secret, round((SELECT entropy(c) FROM (SELECT unnest(string_split(w, '')) AS c)), 6) AS e
  FROM (SELECT doc_id, ordinal, secret, substr(secret, s::INT, {window}) AS w FROM (
    SELECT doc_id, ordinal, secret, unnest(range(1, length(secret) - {window} + 2)) AS s FROM allowed)) WHERE regexp_full_match(w, '{chars}*'))
GROUP BY ALL HAVING max(e) >= {least}"""


OP4_SQL = (
    """
WITH found AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}') AS cs FROM documents),
allowed AS MATERIALIZED (
  SELECT doc_id, unnest(range(len(kept))) AS ordinal, unnest(kept) AS secret FROM (SELECT doc_id, list_filter(cs, lambda s: NOT (
      regexp_full_match(s, '[A-Za-z+/_=-]*') OR regexp_full_match(s, '[0-9+/_=-]*')
      OR regexp_full_match(s, '(?i)[a-z0-9_-]*(?:example|sample|placeholder|dummy|changeme|xxxx)[a-z0-9_+/=-]*')
      OR regexp_full_match(s, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}'))) AS kept FROM found)),
hits AS ("""
    + " UNION ALL ".join(_class_sql(*x) for x in (("hex", _HEX, 20, 3.0, 1), ("alnum", _ALNUM, 20, 3.8, 2), ("base64", "[0-9a-zA-Z+/_=-]", 24, 4.2, 3)))
    + """)
SELECT doc_id, ordinal::INT AS ordinal, secret, char_class, entropy FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY rank) = 1
"""
)

OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, list_aggregate(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www[0-9]*\.', ''), '.')), 'string_agg', ',') AS host,
    lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)) AS path, lower(regexp_extract(url, '^[^?#]*\?([^#]*)', 1)) AS query
  FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL)
SELECT host || ')' || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS key,
  page_id, url AS target, strlen(coalesce(html, ''))::INT AS n_bytes, md5(coalesce(html, '')) AS body_md5
FROM p
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WHITE}'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, s::INT AS s, array_to_string(w[s + 1 : s + 50], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM d)),
g AS (SELECT passage, min(doc_id) AS lo, max(doc_id) AS hi FROM p GROUP BY passage HAVING min(doc_id) <> max(doc_id)),
r AS (SELECT doc_id, s, lo, hi, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run FROM p JOIN g USING (passage))
SELECT doc_id, min(s) AS start_word, (max(s) + 50)::INT AS end_word, (max(s) + 50 - min(s))::INT AS n_words, arg_min(lo, s) AS first_doc_id, arg_min(hi, s) AS last_doc_id
FROM r GROUP BY doc_id, run
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_pigeonhole": OP2_SQL, "op4_secret_scan": OP4_SQL, "op6_capture_index": OP6_SQL, "op7_suffix_repeats": OP7_SQL}
