"""The thin queries opN_<name> of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fingerprint import fingerprint_edits
from .linededup import dedup_lines
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .pii import replace_pii
from .sentencepiece_codec import encode_documents
from .textmodels import classify_toxicity, grade_quality
from .topk import exact_top_k
from .urlfilter import host_of, judge_urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A host with this label is an advertising host; the canonical URLs of its pages are the list of op8.
AD_LABEL = r"(^|\.)ads-track\."

#: The surrogates' secret of the test query; production gives its own.
SURROGATE_KEY = "test-key"


def tokenizer_path() -> str:
    """The public BPE vocabulary; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "expected_grade", "tail_probability", "selected")


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER o AS rn,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source)),
t AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, weight *
        (SELECT level FROM l AS x WHERE x.level <= x.cap / x.weight ORDER BY rn LIMIT 1)) END AS target FROM l),
p AS (SELECT *, floor(target + 0.5)::BIGINT AS take FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target,
        CASE WHEN p.source_size = 0 THEN 0 ELSE p.take // p.source_size END AS whole,
        CASE WHEN p.source_size = 0 THEN 0 ELSE p.take % p.source_size END
          - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, room)))::BIGINT AS taken FROM r
"""


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(host_of(F.col("url")).rlike(AD_LABEL)).select("url")
    return judge_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon FROM b),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS x(v, h, p)),
j AS (SELECT c.*, (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC, h || p LIMIT 1) AS rule FROM c),
n AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)ads-track\.') AND canon <> '')
SELECT page_id, host, path, rule, coalesce((SELECT v FROM r WHERE h || p = rule),
  CASE WHEN host <> '' AND canon IN (SELECT canon FROM n) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""

def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_pii": op1_pii, "op2_quality": op2_quality, "op3_linededup": op3_linededup, "op4_sentencepiece": op4_sentencepiece, "op5_toxicity": op5_toxicity, "op6_mixing": op6_mixing, "op7_fingerprint": op7_fingerprint, "op8_urlfilter": op8_urlfilter, "op9_topk": op9_topk, "op10_ngram_join": op10_ngram_join}
ORACLES = {"op6_mixing": OP6_SQL, "op8_urlfilter": OP8_SQL, "op9_topk": OP9_SQL}
