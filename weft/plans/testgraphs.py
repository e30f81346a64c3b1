"""Triplet tables over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.extract import top_tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, s, p: str, o, key: str, doc: str, number: int, seq: int) -> DataFrame:
    ord_ = F.lit(number * 10**12) + F.col(key) * 10 + seq
    return df.select(F.col(s).alias("subject"), F.lit(p).alias("predicate"), F.col(o).alias("object"), F.col(key).cast("int").alias("chunk_id"), F.lit(doc).alias("doc_name"), ord_.cast("long").alias("row_ord"))


def relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and parts of the star schema as triplets."""
    t = lambda n: read(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    home = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    part = t("part").select("p_partkey", "p_name", "p_type", "p_brand")
    parts = [
        _rows(home, "n_name", "is part of", "r_name", "n_nationkey", "nation", 2, 0),
        _rows(supplier, "s_name", "is based in", "n_name", "s_suppkey", "supplier", 4, 0),
        _rows(customer, "c_name", "is based in", "n_name", "c_custkey", "customer", 1, 0),
        _rows(part, "p_name", "is a type of", "p_type", "p_partkey", "part", 3, 0),
        _rows(part, "p_name", "uses", "p_brand", "p_partkey", "part", 3, 1),
        _rows(part, "p_brand", "co-occurs with", "p_type", "p_partkey", "part", 3, 2),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


REL_SQL = """
t AS (
  SELECT n_name AS subject, 'is part of' AS predicate, r_name AS object, n_nationkey::INT AS chunk_id, 'nation' AS doc_name, 2000000000000 + n_nationkey * 10 AS row_ord
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'is based in', n_name, s_suppkey::INT, 'supplier', 4000000000000 + s_suppkey * 10 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'is based in', n_name, c_custkey::INT, 'customer', 1000000000000 + c_custkey * 10 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT p_name, 'is a type of', p_type, p_partkey::INT, 'part', 3000000000000 + p_partkey * 10 FROM part
  UNION ALL SELECT p_name, 'uses', p_brand, p_partkey::INT, 'part', 3000000000000 + p_partkey * 10 + 1 FROM part
  UNION ALL SELECT p_brand, 'co-occurs with', p_type, p_partkey::INT, 'part', 3000000000000 + p_partkey * 10 + 2 FROM part)"""


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the keys of their events: edges with several predicates; views also co-occur."""
    k = F.concat(F.lit("k_"), F.get_json_object("props", "$.k"))
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("user_"), "user_id").alias("s"), "event_type", k.alias("o"), "event_id")
    base = rows.select(F.col("s").alias("subject"), F.col("event_type").alias("predicate"), F.col("o").alias("object"), F.col("event_id").cast("int").alias("chunk_id"), F.lit("events").alias("doc_name"), (F.col("event_id") * 10).alias("row_ord"))
    views = _rows(rows.where("event_type = 'view'"), "s", "co-occurs with", "o", "event_id", "events", 0, 1)
    return base.unionByName(views)


EVENT_SQL = """
t AS (
  SELECT 'user_' || user_id AS subject, event_type AS predicate, 'k_' || json_extract_string(props, '$.k') AS object, event_id::INT AS chunk_id, 'events' AS doc_name, event_id * 10 AS row_ord FROM events
  UNION ALL SELECT 'user_' || user_id, 'co-occurs with', 'k_' || json_extract_string(props, '$.k'), event_id::INT, 'events', event_id * 10 + 1 FROM events WHERE event_type = 'view')"""


def text_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_name, chunk_id, concepts): the eight most frequent long tokens of each cleaned document."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_name"), clean_text(F.col("text")).alias("text"))
    return top_tokens(docs, ["doc_name"]).withColumn("chunk_id", F.lit(0))


#: White space of Unicode in RE2, which knows that of ASCII only.
_S = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"

CLEAN_SQL = rf"""
c0 AS (SELECT doc_id, regexp_replace(translate(text, chr(8211) || chr(8212) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(160), '--''''"" '), '[^\x09\x0A\x0D\x20-\x7E\x{{A0}}-\x{{FFFF}}]', '', 'g') AS x FROM documents),
c1 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '-\n([^\s])', '\1', 'g'), '(?m)^\s*\d+\s*$', '', 'g'), '(?mi)^page\s+\d+\s*(of\s+\d+)?\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM c0),
c2 AS (SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(x, '\r\n|[\n\r\x{{2028}}\x{{2029}}]'), lambda l: regexp_replace(l, '^{_S}+|{_S}+$', '', 'g')), chr(10)) AS x FROM c1),
clean AS (SELECT doc_id, regexp_replace(regexp_replace(x, ' {{2,}}', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g') AS text FROM c2)"""

SENTENCE_SQL = rf"""
sent AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(
    regexp_replace(regexp_replace(regexp_replace(text, '([.!?])({_S}+)([A-Z])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'),
      '([A-Z][a-z]\.)\x01([^\x02]*)\x02', '\1\2', 'g'), '([\p{{L}}\p{{N}}_]\.[\p{{L}}\p{{N}}_][.!?])\x01([^\x02]*)\x02', '\1\2', 'g'),
    '\x01[^\x02]*\x02'), lambda s: regexp_replace(s, '^{_S}+|{_S}+$', '', 'g')), lambda s: length(s) > 10) AS ss FROM clean),
words AS (SELECT doc_id, text, ss, list_transform(ss, lambda s: len(regexp_split_to_array(s, '{_S}+'))) AS w FROM sent)"""

CONCEPT_SQL = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS token FROM clean),
cnt AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL),
con AS MATERIALIZED (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rk FROM cnt QUALIFY rk <= 8)"""

#: The documents' co-occurrence graph: every ordered pair of a document's tokens, in the order of documents and places.
WORDS_SQL = """
t AS MATERIALIZED (SELECT a.token AS subject, 'co-occurs with' AS predicate, b.token AS object, 0 AS chunk_id, a.doc_id::VARCHAR AS doc_name, row_number() OVER (ORDER BY a.doc_id::VARCHAR, a.rk, b.rk) AS row_ord
  FROM con a JOIN con b ON a.doc_id = b.doc_id AND a.rk < b.rk)"""

#: Graph tables of a triplet table t, in SQL.
GRAPH_SQL = """
n AS (SELECT * FROM (SELECT lower(trim(subject)) AS src, lower(trim(predicate)) AS predicate, lower(trim(object)) AS dst, chunk_id, doc_name, row_ord FROM t) WHERE src <> '' AND dst <> '' AND src <> dst),
pc AS (SELECT src, dst, predicate, count(*) AS c FROM n GROUP BY ALL),
e0 AS (SELECT src, dst, count(*) AS edge_count, min(row_ord) AS edge_ord, arg_min(doc_name, row_ord) AS doc_name,
  array_to_string(list_sort(list(DISTINCT predicate)), '|') AS predicates, array_to_string(list_sort(list(DISTINCT chunk_id)), '|') AS chunk_ids,
  bool_or(predicate = 'co-occurs with') AS cooc,
  bool_or(predicate IN ('is a type of', 'is a subset of', 'is a subtype of', 'consists of', 'is part of', 'is used in', 'enables', 'introduced by', 'was created by', 'is defined as', 'is an example of', 'uses', 'is based on', 'is built on')) AS strong
  FROM n GROUP BY src, dst),
lab AS (SELECT src, dst, predicate AS label FROM pc QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY c DESC, predicate) = 1),
e AS (SELECT e0.*, label FROM e0 JOIN lab USING (src, dst)),
ends AS (SELECT src AS node, doc_name, 2 * row_ord AS o FROM n UNION ALL SELECT dst, doc_name, 2 * row_ord + 1 FROM n),
v AS (SELECT node, count(*) AS frequency, array_to_string(list_sort(list(DISTINCT doc_name)), '|') AS doc_sources, min(o) AS node_ord FROM ends GROUP BY node),
d AS (SELECT v.node, v.node_ord, v.frequency, coalesce(i, 0)::BIGINT AS in_degree, coalesce(u, 0)::BIGINT AS out_degree, (coalesce(i, 0) + coalesce(u, 0))::BIGINT AS degree FROM v
  LEFT JOIN (SELECT dst AS node, count(*) AS i FROM e GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS u FROM e GROUP BY 1) USING (node))"""

WEIGHT_SQL = """
rw AS (SELECT e.*, NOT cooc AS is_llm_edge, CASE WHEN strong THEN 'strong' ELSE 'weak' END AS predicate_strength,
  edge_count * CASE WHEN cooc THEN 1.0::DOUBLE WHEN strong THEN 3.0::DOUBLE * 1.2::DOUBLE ELSE 3.0::DOUBLE END + 0.5::DOUBLE * ln((a.frequency + b.frequency) / 2 + 1) AS raw_weight
  FROM e JOIN v a ON e.src = a.node JOIN v b ON e.dst = b.node),
w AS (SELECT rw.*, round((raw_weight - min(raw_weight) OVER ()) / CASE WHEN max(raw_weight) OVER () > min(raw_weight) OVER () THEN max(raw_weight) OVER () - min(raw_weight) OVER () ELSE 1 END, 4) AS weight FROM rw),
nw AS (SELECT v.*, round(coalesce(x.m, 0), 4) AS weight FROM v LEFT JOIN (SELECT node, sum(weight::DECIMAL(20, 6))::DOUBLE / count(*) AS m FROM (SELECT src AS node, weight FROM w UNION ALL SELECT dst, weight FROM w) GROUP BY node) x USING (node)),
fe AS (SELECT * FROM w WHERE weight >= 0.1 OR is_llm_edge),
fv AS (SELECT * FROM nw WHERE node IN (SELECT src FROM fe UNION SELECT dst FROM fe)),
fd AS (SELECT fv.node, fv.node_ord, fv.frequency, fv.weight, coalesce(i, 0)::BIGINT AS in_degree, coalesce(u, 0)::BIGINT AS out_degree, (coalesce(i, 0) + coalesce(u, 0))::BIGINT AS degree FROM fv
  LEFT JOIN (SELECT dst AS node, count(*) AS i FROM fe GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS u FROM fe GROUP BY 1) USING (node))"""
