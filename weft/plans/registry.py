"""Every registered query of the graph engine, with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, normalise_label, parse_concepts, parse_triplet_lines
from ..operators import chunking, extract, graph, query, tidy, traverse, view, weights
from ..operators.graph import Graph
from ..sources import files
from ..staging import cut, shared_dir
from . import testgraphs as tg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REL, EVENT = "WITH RECURSIVE " + tg.REL_SQL + "," + tg.GRAPH_SQL, "WITH " + tg.EVENT_SQL + "," + tg.GRAPH_SQL
RELW, EVENTW = REL + "," + tg.WEIGHT_SQL, EVENT + "," + tg.WEIGHT_SQL
CLEAN = "WITH " + tg.CLEAN_SQL
CONCEPTS = CLEAN + "," + tg.CONCEPT_SQL
WORDS = "WITH RECURSIVE " + tg.CLEAN_SQL + "," + tg.CONCEPT_SQL + "," + tg.WORDS_SQL + "," + tg.GRAPH_SQL


def query_(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)


def rel(spark: SparkSession, sf: str) -> Graph:
    """Places and parts as a graph, in the shared folder: every step after this one reads it several times."""
    return graph.build_graph(tg.relational(spark, sf)).settled()


def event(spark: SparkSession, sf: str) -> Graph:
    return graph.build_graph(tg.event(spark, sf)).settled()


def words(spark: SparkSession, sf: str) -> Graph:
    """The documents' co-occurrence graph: junk, containment and pairs in both directions occur in it."""
    return graph.build_graph(cut(extract.triplet_table(extract.cooccurrence(tg.text_concepts(spark, sf))))).settled()


def ready(spark: SparkSession, sf: str) -> Graph:
    """The relational graph, weighted and without weak edges, in the shared folder: queries read it several times."""
    return weights.filter_weak(weights.weigh(rel(spark, sf))).settled()


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return tg.read(spark, sf, "documents").select("doc_id", "text")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).withColumn("text", clean_text(F.col("text")))


# --- text ---------------------------------------------------------------------------------------------------------


@query_(CLEAN + " SELECT doc_id, text FROM clean")
def text_clean(spark, sf):
    return cleaned(spark, sf)


@query_(CLEAN + "," + tg.SENTENCE_SQL + " SELECT doc_id, (i - 1)::INT AS sent_idx, ss[i] AS sentence, w[i]::INT AS n_words FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM words)")
def sentence_split(spark, sf):
    return chunking.sentence_rows(cleaned(spark, sf), "doc_id")


_SPANS = """WITH RECURSIVE {clean}, {sentence},
sr AS (SELECT doc_id, text, ss, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS n FROM words),
cs AS MATERIALIZED (SELECT doc_id, text, i, ss[i] AS sentence, ss, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, n FROM sr),
sp AS MATERIALIZED (SELECT a.doc_id, a.i, greatest(a.i, max(b.i) FILTER (b.upto - a.upto + a.n <= 300)) AS e, max(b.upto) FILTER (b.upto - a.upto + a.n <= 300 OR b.i = a.i) - min(a.upto) + min(a.n) AS words
  FROM cs a JOIN cs b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 300 GROUP BY a.doc_id, a.i),
c AS (SELECT doc_id, 0 AS chunk_id, i AS s, e, words FROM sp WHERE i = 1
  UNION ALL SELECT sp.doc_id, c.chunk_id + 1, sp.i, sp.e, sp.words FROM c JOIN sp ON sp.doc_id = c.doc_id AND sp.i = c.s + greatest(1, c.e - c.s + 1 - 2))
""".replace("{clean}", tg.CLEAN_SQL).replace("{sentence}", tg.SENTENCE_SQL)


@query_(_SPANS + "SELECT doc_id, chunk_id::INT AS chunk_id, s::INT AS first_sentence, e::INT AS last_sentence FROM c")
def chunk_spans(spark, sf):
    spans = chunking.chunk_spans(cleaned(spark, sf), "doc_id").select("doc_id", F.posexplode("sp").alias("chunk_id", "x"))
    return spans.select("doc_id", "chunk_id", F.col("x.s").alias("first_sentence"), F.col("x.e").alias("last_sentence"))


@query_(_SPANS + "SELECT doc_id, chunk_id::INT AS chunk_id, md5(array_to_string(ss[s:e], ' ')) AS text_md5, c.words::INT AS word_count, (instr(text, ss[s]) - 1)::INT AS char_start, (instr(text, ss[e]) - 1 + length(ss[e]))::INT AS char_end FROM c JOIN words USING (doc_id)")
def chunk_offsets(spark, sf):
    rows = chunking.chunk_documents(cleaned(spark, sf), "doc_id")
    return rows.select("doc_id", "chunk_id", F.md5("text").alias("text_md5"), "word_count", "char_start", "char_end")


# --- extraction ---------------------------------------------------------------------------------------------------


@query_(CONCEPTS + " SELECT doc_id::VARCHAR AS doc_name, array_to_string(list(token ORDER BY rk), '|') AS concepts FROM con GROUP BY doc_id")
def concept_topk(spark, sf):
    return tg.text_concepts(spark, sf).select("doc_name", joined("concepts"))


@query_(
    r"""WITH a AS (SELECT doc_id, '1. ' || replace(text, '.', E'.\n- ') AS raw FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(raw, '\n+', ', ', 'g'), '(^|,)\s*\d+\.\s*', '\1', 'g'), '(^|,)\s*[-*•]\s*', '\1', 'g') AS x FROM a),
c AS (SELECT doc_id, i, lower(trim(regexp_replace(parts[i], '^\s+|\s+$', '', 'g'), '.:;''"-')) AS c FROM (SELECT doc_id, string_split(x, ',') AS parts, unnest(range(1, len(string_split(x, ',')) + 1)) AS i FROM b))
SELECT doc_id, c AS concept FROM c WHERE length(c) BETWEEN 2 AND 60 AND len(regexp_split_to_array(trim(c), '\s+')) <= 5 GROUP BY doc_id, c"""
)
def concept_parse(spark, sf):
    raw = F.concat(F.lit("1. "), F.regexp_replace("text", r"\.", ".\n- "))
    return docs(spark, sf).select("doc_id", F.explode(parse_concepts(raw)).alias("concept"))


@query_(
    r"""WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT doc_id, list_transform(string_split(replace(regexp_replace(regexp_replace(regexp_replace('1) ' || line, '^\s+|\s+$', '', 'g'), '^\d+[.)]\s*', ''), '^[-*•]\s*', ''), ', ', '|'), '|'),
  lambda p: trim(lower(regexp_replace(p, '^\s+|\s+$', '', 'g')), '.:;''"')) AS p FROM a)
SELECT doc_id, p[1] AS subject, p[2] AS predicate, p[3] AS object FROM b WHERE len(p) = 3 AND len(list_filter(p, lambda x: x = '' OR len(regexp_split_to_array(trim(x), '\s+')) > 8)) = 0"""
)
def triplet_parse(spark, sf):
    raw = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("1) "), F.regexp_replace(x, ", ", "|"))), "\n")
    return docs(spark, sf).select("doc_id", F.explode(parse_triplet_lines(raw)).alias("t")).select("doc_id", "t.*")


_PAIRS = CONCEPTS + ", pr AS (SELECT a.doc_id::VARCHAR AS doc_name, a.token AS subject, b.token AS object, 'co-occurs with' AS predicate FROM con a JOIN con b ON a.doc_id = b.doc_id AND a.rk < b.rk)"


@query_(_PAIRS + " SELECT * FROM pr")
def cooccurrence_pairs(spark, sf):
    return extract.cooccurrence(tg.text_concepts(spark, sf)).select("doc_name", "subject", "object", "predicate")


@query_(_PAIRS + ", u AS (SELECT doc_name, subject, predicate, object FROM pr UNION ALL SELECT doc_id::VARCHAR, 'doc', 'mentions', token FROM con) SELECT doc_name, predicate, count(*) AS n, count(DISTINCT object) AS objects FROM u GROUP BY ALL")
def triplet_union(spark, sf):
    concepts = tg.text_concepts(spark, sf)
    mentions = concepts.select("doc_name", "chunk_id", F.posexplode("concepts").alias("seq", "object")).select(F.lit("doc").alias("subject"), F.lit("mentions").alias("predicate"), "object", "chunk_id", "doc_name", F.lit(0).alias("kind"), "seq")
    table = extract.triplet_table(mentions, extract.cooccurrence(concepts))
    return table.groupBy("doc_name", "predicate").agg(F.count("*").alias("n"), F.countDistinct("object").alias("objects"))


@query_("WITH " + tg.REL_SQL + " SELECT count(DISTINCT x) AS n_concepts FROM (SELECT subject AS x FROM t UNION ALL SELECT object FROM t)")
def concept_distinct(spark, sf):
    return extract.concept_count(tg.relational(spark, sf))


# --- graph --------------------------------------------------------------------------------------------------------


@query_(REL + " SELECT src, predicate, dst, chunk_id::INT AS chunk_id, doc_name FROM n")
def triplet_normalise(spark, sf):
    return graph.normalise_triplets(tg.relational(spark, sf)).drop("row_ord")


@query_(EVENT + " SELECT src, dst, edge_count, predicates, chunk_ids FROM e")
def edge_aggregate(spark, sf):
    return event(spark, sf).edges.select("src", "dst", "edge_count", joined("predicates"), joined("chunk_ids"))


@query_(EVENT + " SELECT src, dst, label FROM e")
def edge_mode_label(spark, sf):
    return event(spark, sf).edges.select("src", "dst", "label")


@query_(REL + " SELECT src, dst, doc_name, edge_ord FROM e")
def edge_first_doc(spark, sf):
    return rel(spark, sf).edges.select("src", "dst", "doc_name", "edge_ord")


@query_(EVENT + " SELECT src, dst, edge_count FROM e WHERE edge_count >= 3")
def edge_threshold(spark, sf):
    return graph.build_graph(tg.event(spark, sf), 3).edges.select("src", "dst", "edge_count")


@query_(REL + " SELECT node, frequency, doc_sources FROM v")
def node_frequency(spark, sf):
    return rel(spark, sf).nodes.select("node", "frequency", joined("doc_sources"))


@query_(REL + " SELECT node, in_degree, out_degree, degree FROM d")
def node_degrees(spark, sf):
    return graph.degrees(rel(spark, sf))


@query_(REL + " SELECT node, degree FROM d ORDER BY degree DESC, node_ord LIMIT 20")
def top_nodes(spark, sf):
    return graph.top_nodes(rel(spark, sf), 20)


@query_(REL + """, arc AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
cc(node, component) AS (SELECT node, node FROM (SELECT node FROM v WHERE node IN (SELECT lower(r_name) FROM region) OR node LIKE 'brand%') UNION SELECT arc.b, cc.component FROM cc JOIN arc ON arc.a = cc.node),
m AS (SELECT node, min(component) AS seed FROM cc GROUP BY node), k AS (SELECT seed, min(node) AS component FROM m GROUP BY seed)
SELECT node, component FROM m JOIN k USING (seed)""")
def weak_components(spark, sf):
    return graph.components(rel(spark, sf))


@query_(REL + """, arc AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
cc(node, component) AS (SELECT node, node FROM (SELECT node FROM v WHERE node IN (SELECT lower(r_name) FROM region) OR node LIKE 'brand%') UNION SELECT arc.b, cc.component FROM cc JOIN arc ON arc.a = cc.node),
m AS (SELECT node, min(component) AS seed FROM cc GROUP BY node)
SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 4) AS density,
  round(2 * (SELECT count(*) FROM e) / (SELECT count(*) FROM v), 2) AS mean_degree,
  (SELECT string_agg(node, ', ' ORDER BY degree DESC, node) FROM (SELECT node, degree FROM d ORDER BY degree DESC, node_ord LIMIT 5)) AS top_nodes, (SELECT count(DISTINCT seed) FROM m) AS components""")
def graph_summary(spark, sf):
    return graph.summary(rel(spark, sf))


# --- weights ------------------------------------------------------------------------------------------------------


@query_(EVENTW + " SELECT src, dst, is_llm_edge, predicate_strength, round(raw_weight, 6) AS raw_weight FROM w")
def edge_raw_weight(spark, sf):
    return weights.raw_weights(event(spark, sf)).select("src", "dst", "is_llm_edge", "predicate_strength", F.round("raw_weight", 6).alias("raw_weight"))


@query_(RELW + " SELECT src, dst, weight FROM w")
def edge_weight_norm(spark, sf):
    return weights.weigh(rel(spark, sf)).edges.select("src", "dst", "weight")


@query_(RELW + " SELECT node, weight FROM nw")
def node_weight(spark, sf):
    return weights.weigh(rel(spark, sf)).nodes.select("node", "weight")


@query_(RELW + " SELECT src, dst, weight, is_llm_edge FROM fe")
def weak_edge_filter(spark, sf):
    return weights.filter_weak(weights.weigh(rel(spark, sf))).edges.select("src", "dst", "weight", "is_llm_edge")


@query_(EVENTW + """ SELECT count(*) FILTER (weight < 0.2) AS bin_0, count(*) FILTER (weight >= 0.2 AND weight < 0.4) AS bin_1, count(*) FILTER (weight >= 0.4 AND weight < 0.6) AS bin_2,
  count(*) FILTER (weight >= 0.6 AND weight < 0.8) AS bin_3, count(*) FILTER (weight >= 0.8) AS bin_4, round(min(weight), 4) AS min, round(max(weight), 4) AS max, round(sum(weight::DECIMAL(20, 6))::DOUBLE / count(*), 4) AS mean FROM w""")
def weight_histogram(spark, sf):
    return weights.weight_histogram(weights.weigh(event(spark, sf)).edges)


@query_(EVENTW + " SELECT count(*) FILTER (is_llm_edge) AS llm_edges, count(*) FILTER (NOT is_llm_edge) AS cooccurrence_edges, count(*) FILTER (strong) AS strong_edges FROM w")
def edge_class_counts(spark, sf):
    return weights.class_counts(weights.classify_edges(event(spark, sf).edges))


# --- cleaning -----------------------------------------------------------------------------------------------------

_LABEL = r"trim(regexp_replace(regexp_replace(trim(lower({c})), '[\"''`*_#@!?]', '', 'g'), '\s+', ' ', 'g'), '.,;:-()')"
_EXPAND = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tidy.ABBREVIATIONS.items()) + " ELSE {c} END"


@query_("SELECT part.p_partkey, " + _LABEL.format(c="'  (' || p_name || '_' || p_type || '!).'") + " AS label FROM part")
def label_normalise(spark, sf):
    return tg.read(spark, sf, "part").select("p_partkey", normalise_label(F.concat(F.lit("  ("), "p_name", F.lit("_"), "p_type", F.lit("!)."))).alias("label"))


@query_(REL + " SELECT node, " + _EXPAND.format(c="node") + " AS expanded FROM v")
def abbrev_expand(spark, sf):
    return rel(spark, sf).nodes.select("node", tidy.expand(F.col("node")).alias("expanded"))


_RELABEL = REL + ", nm AS (SELECT node, CASE WHEN x = '' THEN node ELSE " + _EXPAND.format(c="x") + " END AS name FROM (SELECT node, " + _LABEL.format(c="node") + " AS x FROM v)), r AS (SELECT a.name AS src, b.name AS dst, e.edge_count, e.edge_ord FROM e JOIN nm a ON e.src = a.node JOIN nm b ON e.dst = b.node)"


@query_(_RELABEL + " SELECT src, dst, sum(edge_count)::BIGINT AS edge_count, min(edge_ord) AS edge_ord FROM r WHERE src <> dst GROUP BY src, dst")
def relabel_merge(spark, sf):
    return tidy.normalise_labels(rel(spark, sf)).edges.select("src", "dst", "edge_count", "edge_ord")


_JUNK = r"""CASE WHEN length(x) < 2 THEN 'too short' WHEN len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) < 1 THEN 'no words'
  WHEN len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) > 5 THEN 'too many words' WHEN x IN (""" + ", ".join(f"'{w}'" for w in tidy.STOPWORDS) + r""") THEN 'stopword'
  WHEN len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: length(w) > 1)) = 0 THEN 'single letters' WHEN regexp_full_match(x, '[\d\s.,\-_/()]+') THEN 'numeric' END"""


@query_(REL + " SELECT x AS node, " + _JUNK + " AS reason FROM (SELECT node AS x FROM v) WHERE " + _JUNK + " IS NOT NULL")
def junk_nodes(spark, sf):
    return rel(spark, sf).nodes.select("node", tidy.junk_reason(F.col("node")).alias("reason")).where("reason IS NOT NULL")


def labels(spark, sf) -> DataFrame:
    """Distinct text concepts, and some of them with an s, as labels."""
    c = cut(tg.text_concepts(spark, sf).select(F.explode("concepts").alias("node")).distinct())
    return c.union(c.where("node < 'c'").select(F.concat("node", F.lit("s")))).distinct()


_LABELS = CONCEPTS + ", lc AS (SELECT DISTINCT token AS node FROM con), lb AS (SELECT node FROM lc UNION SELECT node || 's' FROM lc WHERE node < 'c')"


@query_(_LABELS + " SELECT a.node AS a, b.node AS b FROM lb a JOIN lb b ON rtrim(a.node, 's') = rtrim(b.node, 's') AND a.node < b.node AND abs(length(a.node) - length(b.node)) <= 2")
def plural_pairs(spark, sf):
    return tidy.plural_pairs(labels(spark, sf))


@query_(_LABELS + ", pc AS (SELECT a.node AS s, b.node AS l FROM lb a JOIN lb b ON length(a.node) > 4 AND length(a.node) < length(b.node) AND contains(b.node, a.node)) SELECT DISTINCT least(s, l) AS a, greatest(s, l) AS b FROM pc")
def containment_pairs(spark, sf):
    return tidy.containment_pairs(labels(spark, sf))


_TG = """tg AS (SELECT DISTINCT node, substr('  ' || node || '  ', i, 3) AS g FROM (SELECT node, unnest(range(1, length(node) + 3)) AS i FROM lb)),
tn AS (SELECT node, count(*) AS n FROM tg GROUP BY node), sh AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM tg x JOIN tg y ON x.g = y.g AND x.node < y.node GROUP BY ALL),
tp AS (SELECT a, b, c / (p.n + q.n - c) AS similarity FROM sh JOIN tn p ON a = p.node JOIN tn q ON b = q.node WHERE c / (p.n + q.n - c) >= 0.85)"""
_TRIGRAMS = _LABELS + ", " + _TG


@query_(_TRIGRAMS + " SELECT a, b, round(similarity, 6) AS similarity FROM tp")
def trigram_pairs(spark, sf):
    return tidy.trigram_pairs(labels(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


_PLURALS = "pp AS (SELECT a.node AS a, b.node AS b FROM lb a JOIN lb b ON rtrim(a.node, 's') = rtrim(b.node, 's') AND a.node < b.node AND abs(length(a.node) - length(b.node)) <= 2)"
_HOLDS = "hc AS (SELECT DISTINCT least(a.node, b.node) AS a, greatest(a.node, b.node) AS b FROM lb a JOIN lb b ON length(a.node) > 4 AND length(a.node) < length(b.node) AND contains(b.node, a.node))"
#: Components of pairs pr (a, b), and the longest label of each.
_SPREAD = """arc AS MATERIALIZED (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
cc(node, c) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM arc GROUP BY a UNION SELECT arc.b, min(cc.c) FROM cc JOIN arc ON arc.a = cc.node JOIN recurring.cc AS r ON r.node = arc.b WHERE cc.c < r.c GROUP BY arc.b),
m AS (SELECT node, c FROM cc), best AS (SELECT c, arg_min(node, (-length(node), o)) AS name FROM m JOIN lo USING (node) GROUP BY c), ren AS (SELECT node, name FROM m JOIN best USING (c) WHERE node <> name)"""
_MERGE = "WITH RECURSIVE" + _TRIGRAMS.removeprefix("WITH") + ", " + _PLURALS + ", " + _HOLDS + ", pr AS MATERIALIZED (SELECT a, b FROM pp UNION SELECT a, b FROM tp UNION SELECT a, b FROM hc), lo AS (SELECT node, node AS o FROM lb), " + _SPREAD


@query_(_MERGE + " SELECT node, name AS merged_into FROM ren")
def dedup_components(spark, sf):
    nodes = labels(spark, sf).withColumn("node_ord", F.col("node"))
    return tidy.merge_names(nodes, tidy.duplicate_pairs(nodes)).withColumnRenamed("to", "merged_into")


@query_(_MERGE + """, ce AS (SELECT x.token AS src, y.token AS dst, count(*) AS c FROM con x JOIN con y ON x.doc_id = y.doc_id AND x.rk < y.rk GROUP BY ALL),
re AS (SELECT coalesce(p.name, src) AS src, coalesce(q.name, dst) AS dst, c FROM ce LEFT JOIN ren p ON src = p.node LEFT JOIN ren q ON dst = q.node)
SELECT src, dst, sum(c)::BIGINT AS edge_count FROM re WHERE src <> dst GROUP BY src, dst""")
def apply_merges(spark, sf):
    g = words(spark, sf)
    nodes = labels(spark, sf).withColumn("node_ord", F.col("node"))
    return tidy.relabel(g, tidy.merge_names(nodes, tidy.duplicate_pairs(nodes))).edges.select("src", "dst", "edge_count")


@query_(WORDS + """, k AS (SELECT e.*, v.node_ord AS o FROM e JOIN v ON e.src = v.node), r AS (SELECT *, count(*) FILTER (cooc) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS n,
row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY edge_count DESC, o) AS rn FROM k) SELECT src, dst, edge_count FROM r WHERE n < 2 OR rn = 1""")
def reciprocal_prune(spark, sf):
    return tidy.prune_reciprocal(words(spark, sf)).edges.select("src", "dst", "edge_count")


@query_(REL + ", q AS (SELECT node FROM d WHERE degree >= 2) SELECT src, dst FROM e WHERE src IN (SELECT node FROM q) AND dst IN (SELECT node FROM q)")
def isolate_prune(spark, sf):
    return tidy.prune_isolates(rel(spark, sf), 2).edges.select("src", "dst")


@query_(REL + " SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, count(*) FILTER (degree = 0) AS isolates, round(2 * (SELECT count(*) FROM e) / count(*), 2) AS mean_degree, round((SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 4) AS density, (SELECT string_agg(node || ': ' || degree, ', ' ORDER BY degree DESC, node_ord) FROM (SELECT * FROM d ORDER BY degree DESC, node_ord LIMIT 10)) AS top_nodes FROM d")
def node_report(spark, sf):
    return tidy.node_report(rel(spark, sf))


_TIDY = (
    WORDS
    + ", nm AS (SELECT node, node_ord, CASE WHEN x = '' THEN node ELSE " + _EXPAND.format(c="x") + " END AS name FROM (SELECT node, node_ord, " + _LABEL.format(c="node") + " AS x FROM v)),"
    + " v1 AS (SELECT name AS x, min(node_ord) AS o FROM nm GROUP BY name), lo AS MATERIALIZED (SELECT x AS node, o FROM v1 WHERE " + _JUNK + " IS NULL), lb AS (SELECT node FROM lo),"
    + " e1 AS (SELECT a.name AS src, b.name AS dst, sum(edge_count)::BIGINT AS c FROM e JOIN nm a ON e.src = a.node JOIN nm b ON e.dst = b.node WHERE a.name <> b.name AND a.name IN (FROM lb) AND b.name IN (FROM lb) GROUP BY ALL), "
    + _TG + ", " + _PLURALS + ", " + _HOLDS + ", pr AS MATERIALIZED (SELECT a, b FROM pp UNION SELECT a, b FROM tp UNION SELECT a, b FROM hc), " + _SPREAD
    + """, lm AS (SELECT coalesce(name, node) AS node, min(o) AS o FROM lo LEFT JOIN ren USING (node) GROUP BY 1),
e2 AS (SELECT coalesce(p.name, src) AS s, coalesce(q.name, dst) AS t, c FROM e1 LEFT JOIN ren p ON src = p.node LEFT JOIN ren q ON dst = q.node),
e3 AS (SELECT s AS src, t AS dst, sum(c)::BIGINT AS c FROM e2 WHERE s <> t GROUP BY s, t),
r AS (SELECT src, dst, c, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY c DESC, o) AS rn FROM e3 JOIN lm ON src = node)
SELECT src, dst, c AS edge_count, 'co-occurs with' AS label FROM r WHERE rn = 1"""
)


@query_(_TIDY)
def tidy_graph(spark, sf):
    return tidy.tidy(words(spark, sf)).edges.select("src", "dst", "edge_count", "label")


#: The greedy pass, a pair at a time: whose pairs are open (head), what is merged so far (gone) and where to (moves).
_GREEDY = (
    "WITH RECURSIVE" + _TRIGRAMS.removeprefix("WITH") + ", " + _PLURALS
    + """, gp AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS k, a AS x, b AS y FROM (SELECT a, b FROM pp UNION SELECT a, b FROM tp)),
st(k, head, open, gone, moved, kept) AS (SELECT 0::BIGINT, '', false, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR
  UNION ALL SELECT k, x, o, CASE WHEN hit THEN list_append(gone, CASE WHEN length(x) >= length(y) THEN y ELSE x END) ELSE gone END,
    CASE WHEN hit THEN CASE WHEN length(x) >= length(y) THEN y ELSE x END END, CASE WHEN hit THEN CASE WHEN length(x) >= length(y) THEN x ELSE y END END
  FROM (SELECT *, o AND NOT list_contains(gone, y) AS hit FROM (SELECT gp.k, gp.x, gp.y, st.gone, CASE WHEN gp.x = st.head THEN st.open ELSE NOT list_contains(st.gone, gp.x) END AS o FROM st JOIN gp ON gp.k = st.k + 1)))
SELECT moved AS node, arg_max(kept, k) AS merged_into FROM st WHERE moved IS NOT NULL GROUP BY moved"""
)


@query_(_GREEDY)
def merge_greedy(spark, sf):
    nodes = cut(labels(spark, sf).withColumn("node_ord", F.col("node")))
    return tidy.replay_names(nodes, tidy.duplicate_pairs(nodes, containment=False)).withColumnRenamed("to", "merged_into")


# --- queries ------------------------------------------------------------------------------------------------------


@query_(RELW + " SELECT node FROM fv WHERE node = 'asia'")
def lookup_exact(spark, sf):
    return query.lookup_exact(ready(spark, sf), "  ASIA ")


@query_(RELW + " SELECT node FROM fv WHERE contains(node, 'brand#1') OR contains('brand#1', node)")
def lookup_substring(spark, sf):
    return query.lookup_substring(ready(spark, sf), "Brand#1").select("node")


@query_()
def lookup_fuzzy(spark, sf):
    return query.lookup_fuzzy(ready(spark, sf), "uropee")


@query_(RELW + " SELECT 'out' AS direction, dst AS other, label, round(weight, 3) AS weight FROM fe WHERE src = 'brand#11' UNION ALL SELECT 'in', src, label, round(weight, 3) FROM fe WHERE dst = 'brand#11'")
def neighbours(spark, sf):
    return query.neighbours(ready(spark, sf), "brand#11").drop("edge_ord")


_REACH = ", arc AS (SELECT src AS a, dst AS b FROM fe UNION SELECT dst, src FROM fe), r1 AS (SELECT 'asia' AS node UNION SELECT b FROM arc WHERE a = 'asia'), r2 AS (SELECT node FROM r1 UNION SELECT b FROM arc JOIN r1 ON a = node)"


@query_(RELW + _REACH + " SELECT src, dst, label FROM fe WHERE src IN (SELECT node FROM r2) AND dst IN (SELECT node FROM r2)")
def subgraph_bfs(spark, sf):
    return traverse.subgraph(ready(spark, sf), "asia", 2).edges.select("src", "dst", "label")


@query_(
    RELW
    + """, arc AS (SELECT src AS a, dst AS b FROM fe UNION SELECT dst, src FROM fe),
bf(node, hop) AS (SELECT x, 0 FROM (SELECT min(lower(p_name)) AS x FROM part) UNION SELECT b, hop + 1 FROM bf JOIN arc ON a = node WHERE hop < 6),
lv AS (SELECT node, min(hop) AS hop FROM bf GROUP BY node),
bk(node, hop) AS (SELECT node, hop FROM lv WHERE node = (SELECT max(lower(p_name)) FROM part) UNION ALL
  SELECT (SELECT min(a) FROM arc JOIN lv ON lv.node = arc.a WHERE arc.b = bk.node AND lv.hop = bk.hop - 1), bk.hop - 1 FROM bk WHERE bk.hop > 0),
st AS (SELECT x.hop AS step, y.node AS src, x.node AS dst FROM bk x JOIN bk y ON y.hop = x.hop - 1)
SELECT step::INT AS step, st.src, st.dst, coalesce(p.label, q.label) AS label FROM st LEFT JOIN fe p ON p.src = st.src AND p.dst = st.dst LEFT JOIN fe q ON q.src = st.dst AND q.dst = st.src"""
)
def shortest_path(spark, sf):
    ends = tg.read(spark, sf, "part").agg(F.min(F.lower("p_name")), F.max(F.lower("p_name"))).first()
    return traverse.shortest_path(ready(spark, sf), ends[0], ends[1])


@query_(RELW + " SELECT node, degree, in_degree, out_degree, frequency, round(weight, 3) AS weight FROM fd ORDER BY degree DESC, node_ord LIMIT 10")
def hubs(spark, sf):
    return query.hubs(ready(spark, sf))


@query_(RELW + " SELECT node FROM fv WHERE contains(node, '#2')")
def keyword_search(spark, sf):
    return query.search(ready(spark, sf), "#2").select("node")


@query_(RELW + " SELECT DISTINCT label FROM fe WHERE label NOT IN ('', 'co-occurs with')")
def relation_types(spark, sf):
    return query.relation_types(ready(spark, sf))


@query_(
    r"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in query.QUESTION_STOPWORDS)
    + ")), '|') AS keywords FROM conversations"
)
def question_keywords(spark, sf):
    rows = tg.read(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.array_join(query.question_keywords(F.col("text")), "|").alias("keywords"))


@query_(
    RELW
    + """, q AS (SELECT * FROM (VALUES ('asia', 0), ('brand#11', 1), ('brand#22', 2)) AS x(node, node_pos)),
x AS (SELECT node_pos, 0 AS direction, src, dst, label, weight, edge_ord FROM fe JOIN q ON src = node UNION ALL SELECT node_pos, 1, src, dst, label, weight, edge_ord FROM fe JOIN q ON dst = node),
r AS (SELECT *, row_number() OVER (PARTITION BY node_pos, direction ORDER BY round(weight, 3) DESC, edge_ord) AS rank FROM x)
SELECT node_pos::INT AS node_pos, direction::INT AS direction, rank::INT AS rank, '  ' || src || ' --[' || label || ']--> ' || dst AS line FROM r WHERE rank <= 4 AND label <> 'co-occurs with'"""
)
def context_lines(spark, sf):
    return query.context_edges(ready(spark, sf), ["asia", "brand#11", "brand#22"])


@query_(
    RELW
    + """ SELECT (SELECT count(*) FROM fv) AS nodes, (SELECT count(*) FROM fe) AS edges, round((SELECT count(*) FROM fe) / ((SELECT count(*) FROM fv) * ((SELECT count(*) FROM fv) - 1)), 4) AS density,
  (SELECT string_agg(node, ', ' ORDER BY degree DESC, node) FROM (SELECT node, degree FROM fd ORDER BY degree DESC, node_ord LIMIT 5)) AS top_concepts,
  (SELECT string_agg(label, '|' ORDER BY label) FROM (SELECT DISTINCT label FROM fe WHERE label NOT IN ('', 'co-occurs with'))) AS relation_types"""
)
def engine_summary(spark, sf):
    return query.graph_summary(ready(spark, sf)).withColumn("relation_types", F.array_join("relation_types", "|"))


#: The nodes of a question: "asia" is a label, "brand#1" only a part of some; the other words find nothing or do not count.
_QUESTION = "What do Asia and BRAND#1 tell"
_PICK = RELW + """, kw AS (SELECT * FROM (VALUES ('asia', 0), ('brand#1', 1)) AS x(word, w)), ex AS (SELECT w, node, 0::BIGINT AS r FROM kw JOIN fv ON node = word),
su AS (SELECT w, node, row_number() OVER (PARTITION BY w ORDER BY node_ord) AS r FROM kw JOIN fv ON contains(node, word) OR contains(word, node) WHERE w NOT IN (SELECT w FROM ex)),
pick AS (SELECT node, (row_number() OVER (ORDER BY w, r) - 1)::INT AS node_pos FROM (FROM ex UNION ALL FROM su WHERE r <= 2))"""


@query_(_PICK + " SELECT node_pos, node FROM pick")
def context_pick(spark, sf):
    found = query.context_nodes(ready(spark, sf), _QUESTION)
    return spark.createDataFrame(list(enumerate(found)), "node_pos int, node string")


@query_(
    _PICK
    + """, x AS (SELECT node_pos, 0 AS direction, src, dst, label, weight, edge_ord FROM fe JOIN pick ON src = node UNION ALL SELECT node_pos, 1, src, dst, label, weight, edge_ord FROM fe JOIN pick ON dst = node),
r AS (SELECT *, row_number() OVER (PARTITION BY node_pos, direction ORDER BY round(weight, 3) DESC, edge_ord) AS rank FROM x)
SELECT 'Knowledge graph context:' || chr(10) || string_agg('  ' || src || ' --[' || label || ']--> ' || dst, chr(10) ORDER BY node_pos, direction, rank) AS context FROM r WHERE rank <= 4 AND label <> 'co-occurs with'"""
)
def context_text(spark, sf):
    return spark.createDataFrame([(query.build_context(ready(spark, sf), _QUESTION),)], "context string")


# --- sources ------------------------------------------------------------------------------------------------------


@query_("WITH " + tg.REL_SQL + " SELECT subject, predicate, object, chunk_id, doc_name FROM t")
def triplet_csv(spark, sf):
    """Written as CSV to the shared folder and read again."""
    path = f"{shared_dir(spark)}/triplets-{uuid.uuid4().hex}"
    files.write_triplets(tg.relational(spark, sf), path)
    return files.read_triplets(spark, path).drop("row_ord")


@query_("WITH " + tg.EVENT_SQL + " SELECT subject, predicate, object, chunk_id, doc_name FROM t")
def triplet_parquet(spark, sf):
    path = f"{shared_dir(spark)}/triplets-{uuid.uuid4().hex}"
    files.write_triplets(tg.event(spark, sf), path, "parquet")
    return files.read_triplets(spark, path, "parquet").drop("row_ord")


# --- view ---------------------------------------------------------------------------------------------------------

_VIEW = RELW + """, tv AS (SELECT * FROM fd ORDER BY degree DESC, node_ord LIMIT 50), te AS (SELECT * FROM fe WHERE src IN (SELECT node FROM tv) AND dst IN (SELECT node FROM tv)),
td AS (SELECT tv.node, tv.node_ord, (coalesce(i, 0) + coalesce(u, 0))::BIGINT AS degree FROM tv LEFT JOIN (SELECT dst AS node, count(*) AS i FROM te GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS u FROM te GROUP BY 1) USING (node)),
tw AS (SELECT *, round(0.5 + (weight - min(weight) OVER ()) / CASE WHEN max(weight) OVER () > min(weight) OVER () THEN max(weight) OVER () - min(weight) OVER () ELSE 1 END * 7.5, 2) AS width,
  CASE WHEN NOT is_llm_edge THEN 'cooc' WHEN predicate_strength = 'strong' THEN 'llm_strong' ELSE 'llm_weak' END AS kind FROM te)"""


def trimmed(spark, sf) -> Graph:
    return view.trim(ready(spark, sf)).settled()


@query_(_VIEW + " SELECT src, dst FROM te")
def view_trim(spark, sf):
    return trimmed(spark, sf).edges.select("src", "dst")


@query_(_VIEW + " SELECT node, degree, trunc(10 + (degree - min(degree) OVER ()) / CASE WHEN max(degree) OVER () > min(degree) OVER () THEN max(degree) OVER () - min(degree) OVER () ELSE 1 END * 50)::INT AS size FROM td")
def view_sizes(spark, sf):
    return view.view_nodes(trimmed(spark, sf)).select("node", "degree", "size")


@query_(_VIEW + ", p AS (SELECT node, (row_number() OVER (ORDER BY degree DESC, node_ord) - 1) / count(*) OVER () AS p FROM td) SELECT node, CASE WHEN p <= 0.1 THEN 'hub' WHEN p <= 0.25 THEN 'major' WHEN p <= 0.6 THEN 'normal' ELSE 'minor' END AS tier FROM p")
def view_tiers(spark, sf):
    return view.view_nodes(trimmed(spark, sf)).select("node", "tier")


@query_(_VIEW + " SELECT src, dst, width FROM tw")
def view_edge_widths(spark, sf):
    return view.view_edges(trimmed(spark, sf)).select("src", "dst", "width")


@query_(_VIEW + " SELECT src, dst, kind, CASE kind WHEN 'cooc' THEN '#555555' WHEN 'llm_strong' THEN '#1D9E75' ELSE '#5DCAA5' END AS colour, CASE WHEN is_llm_edge THEN label ELSE '' END AS text FROM tw")
def view_edge_colours(spark, sf):
    return view.view_edges(trimmed(spark, sf)).select("src", "dst", "kind", "colour", "text")
