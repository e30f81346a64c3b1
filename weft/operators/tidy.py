"""Graph cleaning in five passes: labels, junk, duplicates, reciprocal pairs, isolated nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COOCCURS
from ..functions.text import inner_trigrams, normalise_label, trigrams
from ..staging import cut
from .graph import Graph, components, counts, degrees, density, top_nodes

#: Labels that are no concepts: fixed values.
STOPWORDS = [
    "the", "a", "an", "this", "that", "these", "those", "it", "its", "they", "them", "their", "we", "our",
    "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do", "does", "did", "for",
    "of", "in", "on", "at", "by", "with", "from", "to", "and", "or", "but", "not", "no", "so",
    "as", "if", "then", "than", "also", "each", "all", "text", "data", "information", "system", "approach", "method", "way",
    "type", "kind", "form", "example", "use", "used", "using", "based", "new", "many", "large", "small", "different", "specific",
    "various",
]

#: Abbreviations and what they stand for: fixed values.
ABBREVIATIONS = {
    "ml": "machine learning",
    "dl": "deep learning",
    "ai": "artificial intelligence",
    "nlp": "natural language processing",
    "llm": "large language model",
    "llms": "large language model",
    "nn": "neural network",
    "nns": "neural networks",
    "rl": "reinforcement learning",
    "cv": "computer vision",
    "gd": "gradient descent",
    "bp": "backpropagation",
    "tl": "transfer learning",
    "kg": "knowledge graph",
    "kgs": "knowledge graph",
}


def expand(label: Column) -> Column:
    """The long form of a label that is exactly an abbreviation."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.coalesce(F.element_at(table, label), label)


def relabel(g: Graph, names: DataFrame) -> Graph:
    """The graph with nodes renamed by (node, to); nodes and edges that fall together merge, loops go.

    Counts and frequencies add up, sets unite, the label is that of the heaviest edge (ties by first place), first
    document and places are the earliest.
    """
    nodes = g.nodes.join(names, "node", "left").withColumn("node", F.coalesce("to", "node"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    nodes = nodes.groupBy("node").agg(F.sum("frequency").alias("frequency"), flat("doc_sources"), F.min("node_ord").alias("node_ord"))
    to = lambda end: names.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
    edges = g.edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left").withColumns({"src": F.coalesce("src_to", "src"), "dst": F.coalesce("dst_to", "dst")}).where("src != dst")
    edges = edges.groupBy("src", "dst").agg(
        F.sum("edge_count").alias("edge_count"),
        F.min_by("label", F.struct((-F.col("edge_count")).alias("n"), "edge_ord")).alias("label"),
        *[flat(c) for c in ("predicates", "chunk_ids", "chunks")],
        F.min_by("doc_name", "edge_ord").alias("doc_name"),
        F.min("edge_ord").alias("edge_ord"),
    )
    return Graph(nodes, edges)


def normalise_labels(g: Graph) -> Graph:
    """Pass 1: labels normalised and abbreviations expanded; labels that become empty keep their old form."""
    new = expand(normalise_label(F.col("node")))
    names = g.nodes.select("node", F.when(new == "", F.col("node")).otherwise(new).alias("to")).where("to != node")
    return relabel(g, names)


def junk_reason(node: Column) -> Column:
    """Why a label is no concept (the first reason that holds), null if it is one."""
    words = F.filter(F.split(node, r"(?U)\s+"), lambda w: w != "")
    return (
        F.when(F.char_length(node) < 2, "too short")
        .when(F.size(words) < 1, "no words")
        .when(F.size(words) > 5, "too many words")
        .when(node.isin(STOPWORDS), "stopword")
        .when(F.forall(words, lambda w: F.char_length(w) <= 1), "single letters")
        .when(node.rlike(r"^[\d\s.,\-_/()]+$"), "numeric")
    )


def keep_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """The subgraph that some nodes induce."""
    ids = nodes.select("node")
    end = lambda c: ids.withColumnRenamed("node", c)
    return Graph(g.nodes.join(ids, "node", "left_semi"), g.edges.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi"))


def drop_junk(g: Graph) -> Graph:
    return keep_nodes(g, g.nodes.where(junk_reason(F.col("node")).isNull()))


# --- duplicate labels: three kinds of pairs, each by an equi-join on a block ----------------------------------------


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def plural_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: equal without their final s, at most two characters apart."""
    own = nodes.select("node", F.regexp_replace("node", "s+$", "").alias("stem"))
    a, b = own.select(F.col("node").alias("a"), "stem"), own.select(F.col("node").alias("b"), "stem")
    return a.join(b, "stem").where((F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 2)).select("a", "b")


def containment_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: one of two labels of more than four characters holds the other.

    The shorter label is looked up by its rarest trigram in an index of all labels' trigrams, then verified.
    """
    own = cut(nodes.where(F.char_length("node") > 4).select("node", F.explode(inner_trigrams(F.col("node"))).alias("g")))
    rare = own.join(own.groupBy("g").agg(F.count("*").alias("df")), "g").groupBy("node").agg(F.min_by("g", F.struct("df", "g")).alias("g")).withColumnRenamed("node", "short")
    pairs = rare.join(own, "g").where((F.char_length("short") < F.char_length("node")) & F.col("node").contains(F.col("short")))
    return _ordered(pairs.select(F.col("short").alias("a"), F.col("node").alias("b")))


def trigram_pairs(nodes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity), a < b: trigram sets with Jaccard similarity of threshold or more.

    Prefix filter: of two such sets the rarest size - ceil(threshold * size) + 1 trigrams of each (by one global order
    of rarity) share one, so only those meet; sizes must fit; survivors are verified on the whole sets. The labels'
    sets and the prefixes are cut in the shared folder, as both ends of the join read them.
    """
    own = cut(nodes.select("node", trigrams(F.col("node")).alias("gs")).withColumn("n", F.size("gs")))
    flat = own.select("node", "n", F.explode("gs").alias("g"))
    ranked = flat.join(flat.groupBy("g").agg(F.count("*").alias("df")), "g").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("df", "g")))
    prefix = cut(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("node", "n", "g"))
    a, b = prefix.select(F.col("node").alias("a"), F.col("n").alias("na"), "g"), prefix.select(F.col("node").alias("b"), F.col("n").alias("nb"), "g")
    candidates = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sets = lambda end: own.select(F.col("node").alias(end), F.col("gs").alias(f"g{end}"))
    both = candidates.join(sets("a"), "a").join(sets("b"), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.withColumn("similarity", shared / (F.size("ga") + F.size("gb") - shared)).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def duplicate_pairs(nodes: DataFrame, threshold: float = 0.85, containment: bool = True) -> DataFrame:
    parts = plural_pairs(nodes).union(trigram_pairs(nodes, threshold).select("a", "b"))
    return (parts.union(containment_pairs(nodes)) if containment else parts).distinct()


def merge_names(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, to): each component of the pairs takes its longest label, ties by first place."""
    linked = Graph(nodes, cut(pairs).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    own = cut(components(linked)).join(nodes.select("node", "node_ord"), "node")
    best = own.groupBy("component").agg(F.min_by("node", F.struct((-F.char_length("node")).alias("n"), "node_ord")).alias("to"))
    return own.join(best, "component").where("node != to").select("node", "to")


def replay_names(nodes: DataFrame, pairs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(node, to) as a greedy pass over pairs in node order gives them: of each pair the shorter label (of equal ones
    the later node) goes to the other, a merged node opens no more pairs and is no more a partner.

    The pass is sequential, so candidate pairs come to the driver; more than `most` of them are an error.
    """
    ords = nodes.select("node", "node_ord")
    rows = pairs.join(ords.withColumnsRenamed({"node": "a", "node_ord": "oa"}), "a").join(ords.withColumnsRenamed({"node": "b", "node_ord": "ob"}), "b")
    swap = F.col("oa") > F.col("ob")
    rows = rows.select(F.when(swap, F.struct("ob", "oa", F.col("b").alias("x"), F.col("a").alias("y"))).otherwise(F.struct(F.col("oa").alias("ob"), F.col("ob").alias("oa"), F.col("a").alias("x"), F.col("b").alias("y"))).alias("p")).select("p.*").orderBy("ob", "oa")
    got = rows.select("x", "y").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} candidate pairs; use merge_names")
    to: dict[str, str] = {}
    head, open_ = None, False
    for x, y in got:
        if x != head:
            head, open_ = x, x not in to
        if open_ and y not in to:
            keep = x if len(x) >= len(y) else y
            to[y if keep == x else x] = keep
    return nodes.sparkSession.createDataFrame(list(to.items()) or [], "node string, to string")


def merge_duplicates(g: Graph, threshold: float = 0.85, containment: bool = True, greedy: bool = False) -> Graph:
    """Pass 3: duplicate labels become one node, by components of their pairs or by the greedy pass."""
    pairs = duplicate_pairs(g.nodes, threshold, containment)
    return relabel(g, (replay_names if greedy else merge_names)(g.nodes, pairs))


def prune_reciprocal(g: Graph, treat_all_as_cooc: bool = False) -> Graph:
    """Pass 4: of two co-occurrence edges u->v and v->u the lighter goes; of equal ones that from the later node."""
    edges = g.edges.withColumn("_c", F.lit(True) if treat_all_as_cooc else F.array_contains("predicates", COOCCURS))
    ords = g.nodes.select(F.col("node").alias("src"), F.col("node_ord").alias("_o"))
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    ranked = edges.join(ords, "src", "left").withColumns({"_n": F.count_if("_c").over(pair), "_r": F.row_number().over(pair.orderBy(F.desc("edge_count"), "_o"))})
    return Graph(g.nodes, ranked.where("_n < 2 OR _r = 1").drop("_c", "_o", "_n", "_r"))


def prune_isolates(g: Graph, min_degree: int = 1) -> Graph:
    """Pass 5: one round, nodes of a lower degree and their edges go."""
    return keep_nodes(g, degrees(g).where(F.col("degree") >= min_degree))


def tidy(g: Graph, threshold: float = 0.85, containment: bool = True, min_degree: int = 1, greedy: bool = False) -> Graph:
    """All five passes. Passes 1 and 3 are cut in the shared folder: what follows reads them several times."""
    g = drop_junk(normalise_labels(g)).settled()
    g = merge_duplicates(g, threshold, containment, greedy).settled()
    return prune_isolates(prune_reciprocal(g), min_degree)


def node_report(g: Graph) -> DataFrame:
    """One row: nodes, edges, isolated nodes, mean degree (2 places), density (4 places), the ten nodes of highest
    degree with it, ties by first place."""
    d = degrees(g).agg(F.count_if(F.col("degree") == 0).alias("isolates"))
    best = top_nodes(g, 10).join(g.nodes.select("node", "node_ord"), "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "node_ord", "node"))).alias("t"))
    names = best.select(F.array_join(F.transform("t", lambda x: F.concat(x["node"], F.lit(": "), (-x["d"]).cast("string"))), ", ").alias("top_nodes"))
    out = counts(g).crossJoin(F.broadcast(d)).crossJoin(F.broadcast(names))  # one row each
    return out.select("nodes", "edges", "isolates", F.round(F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0), 2).alias("mean_degree"), F.round(density(F.col("nodes"), F.col("edges")), 4).alias("density"), "top_nodes")
