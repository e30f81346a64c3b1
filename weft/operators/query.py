"""Lookups, neighbours, hubs, search, summary and the context of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COOCCURS
from .graph import Graph, counts, degrees, density, top_nodes

#: Words of a question that are no keywords: fixed values.
QUESTION_STOPWORDS = ["what", "how", "why", "is", "are", "the", "a", "an", "does", "do", "tell", "me", "about", "between", "and", "or", "in", "of", "to", "from"]


def lookup_exact(g: Graph, query: str) -> DataFrame:
    return g.nodes.where(F.col("node") == query.strip().lower()).select("node")


def lookup_substring(g: Graph, query: str) -> DataFrame:
    """Nodes that hold the query or that it holds, with their order."""
    q = F.lit(query.strip().lower())
    return g.nodes.where(F.col("node").contains(q) | q.contains(F.col("node"))).select("node", "node_ord")


def lookup_fuzzy(g: Graph, query: str, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """(node, ratio) of the n labels most like the query by matching blocks; ties to the larger label.

    The length bound on the ratio is exact and runs first, so Python sees only labels that can reach the cutoff.
    """
    q = query.strip().lower()

    @F.pandas_udf("double")
    def ratio(labels):
        from difflib import SequenceMatcher

        matcher = SequenceMatcher()
        matcher.set_seq2(q)
        out = []
        for label in labels:
            matcher.set_seq1(label)
            out.append(matcher.ratio() if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff else 0.0)
        return labels.__class__(out, dtype="float64")

    n_chars = F.char_length("node")
    able = g.nodes.where(2 * F.least(n_chars, F.lit(len(q))) >= cutoff * (n_chars + len(q)) - 1e-9)
    return able.select("node", ratio("node").alias("ratio")).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), F.desc("node")).limit(n)


def find_node(g: Graph, query: str, cutoff: float = 0.6, most: int | None = None) -> list[str]:
    """Labels for a query: the exact one alone, else all substring matches (or the first `most`) in node order, then fuzzy ones."""
    exact = [r.node for r in lookup_exact(g, query).collect()]
    if exact:
        return exact
    matches = lookup_substring(g, query).orderBy("node_ord")
    found = [r.node for r in (matches if most is None else matches.limit(most)).collect()]
    return found + [r.node for r in lookup_fuzzy(g, query, cutoff=cutoff).collect() if r.node not in found]


def neighbours(g: Graph, node: str, direction: str = "both") -> DataFrame:
    """(direction, other, label, weight, edge_ord): the edges of one node, weight to 3 places."""
    own = lambda d, end, other: g.edges.where(F.col(end) == node).select(F.lit(d).alias("direction"), F.col(other).alias("other"), F.coalesce("label", F.lit("relates to")).alias("label"), F.round("weight", 3).alias("weight"), "edge_ord")
    out, into = own("out", "src", "dst"), own("in", "dst", "src")
    return out if direction == "out" else into if direction == "in" else out.union(into)


def hubs(g: Graph, n: int = 10) -> DataFrame:
    """(node, degree, in_degree, out_degree, frequency, weight) of the n nodes of highest degree, ties by first place."""
    rows = degrees(g).join(g.nodes.select("node", "frequency", "weight", "node_ord"), "node")
    return rows.orderBy(F.desc("degree"), "node_ord").limit(n).select("node", "degree", "in_degree", "out_degree", "frequency", F.round("weight", 3).alias("weight"))


def search(g: Graph, keyword: str) -> DataFrame:
    """Nodes that hold the keyword literally, whatever its case."""
    return g.nodes.where(F.lower("node").contains(keyword.strip().lower())).select("node", "node_ord")


def relation_types(g: Graph) -> DataFrame:
    return g.edges.where((F.col("label") != "") & (F.col("label") != COOCCURS)).select("label").distinct()


def graph_summary(g: Graph) -> DataFrame:
    """One row: nodes, edges, density, names of the five top nodes, relation types."""
    names = top_nodes(g, 5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "node"))), lambda x: x["node"]), ", ").alias("top_concepts"))
    types = relation_types(g).agg(F.array_sort(F.collect_list("label")).alias("relation_types"))
    out = counts(g).crossJoin(F.broadcast(names)).crossJoin(F.broadcast(types))  # one row each
    return out.select("nodes", "edges", F.round(density(F.col("nodes"), F.col("edges")), 4).alias("density"), "top_concepts", "relation_types")


def question_keywords(question: Column) -> Column:
    """Lower-case words of more than two characters that are no question words; punctuation stays."""
    return F.filter(F.split(F.lower(F.regexp_replace(question, r"(?U)^\s+|\s+$", "")), r"(?U)\s+"), lambda w: (F.char_length(w) > 2) & ~w.isin(QUESTION_STOPWORDS))


def context_nodes(g: Graph, question: str, max_nodes: int = 8) -> list[str]:
    """The first two matches of each keyword in order, else the five top hubs; max_nodes at most."""
    words = [w for w in question.lower().split() if len(w) > 2 and w not in QUESTION_STOPWORDS]
    found = list(dict.fromkeys(n for w in words for n in find_node(g, w, most=2)[:2]))
    return (found or [r.node for r in top_nodes(g, 5).collect()])[:max_nodes]


def context_edges(g: Graph, nodes: list[str], most: int = 4) -> DataFrame:
    """(node_pos, direction, rank, line): each node's heaviest edges either way; co-occurrences count but give no line."""
    order = g.nodes.sparkSession.createDataFrame([(n, k) for k, n in enumerate(nodes)], "node string, node_pos int")  # a handful of nodes
    own = lambda d, end: g.edges.join(F.broadcast(order.withColumnRenamed("node", end)), end).select("node_pos", F.lit(d).alias("direction"), "src", "dst", "label", "weight", "edge_ord")
    rows = own(0, "src").union(own(1, "dst"))
    best = Window.partitionBy("node_pos", "direction").orderBy(F.desc(F.round("weight", 3)), "edge_ord")
    rows = rows.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= most) & (F.col("label") != COOCCURS))
    return rows.select("node_pos", "direction", "rank", F.concat(F.lit("  "), "src", F.lit(" --["), "label", F.lit("]--> "), "dst").alias("line"))


def build_context(g: Graph, question: str, max_nodes: int = 8) -> str:
    lines = [r.line for r in context_edges(g, context_nodes(g, question, max_nodes)).orderBy("node_pos", "direction", "rank").collect()]
    return "\n".join(["Knowledge graph context:", *(lines or ["  (no specific context found)"])])


def ask_messages(g: Graph, question: str) -> list[dict]:
    """Messages that ask a model to answer from the graph alone."""
    s = graph_summary(g).first()
    overview = f"The graph has {s.nodes} concepts and {s.edges} relations; key concepts: {s.top_concepts}; relations such as: {', '.join(s.relation_types[:8])}."
    return [{"role": "user", "content": f"Answer the question briefly and only from this graph.\n{overview}\n\n{build_context(g, question)}\n\nQuestion: {question}\nAnswer:"}]
