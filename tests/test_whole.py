"""Registered queries do the whole job: nothing behind a prefix is lost, and graph passes run over tables."""

import re

import duckdb

from weft.operators import graph, query, traverse
from weft.plans.registry import ORACLES, QUERIES


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


LONG = "Graph theory, " + "filler words, " * 20 + "tail concept, 3. numbered one, a " + "very " * 6 + "long one. Last: item, x, end"


def test_concepts_of_whole_text(spark, tmp_path):
    texts = [LONG, "short one, short two", "", None]

    def concepts(t):
        raw = re.sub(r"\n+", ", ", "1. " + t.replace(".", ".\n- "))
        raw = re.sub(r"(^|(?<=,))\s*[-*•]\s*", "", re.sub(r"(^|(?<=,))\s*\d+\.\s*", "", raw))
        parts = [x.strip().strip(".:;'\"-").lower() for x in raw.split(",")]
        return {x for x in parts if 2 <= len(x) <= 60 and len(x.split()) <= 5}

    got = {tuple(r) for r in QUERIES["concept_parse"](spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {(k, c) for k, t in enumerate(texts) if t is not None for c in concepts(t)}
    assert {(0, "tail concept"), (0, "end")} <= got


def test_triplets_of_whole_text(spark, tmp_path):
    # The 400th character falls into the second line, whose first three parts are no triplet.
    cut = "one two, uses, " + "x" * 20 + ", four, five"
    texts = ["p" * 370 + "\n" + cut + "\nfar away, is in, the tail\na, b, c.", "a, b, c", "", None]

    def triplets(t):
        for line in t.split("\n"):
            parts = [x.strip().lower().strip(".:;'\"") for x in re.sub(r"^[-*•]\s*", "", line.strip()).split(", ")]
            if len(parts) == 3 and all(x and len(x.split()) <= 8 for x in parts):
                yield tuple(parts)

    got = sorted(tuple(r) for r in QUERIES["triplet_parse"](spark, documents(spark, tmp_path, texts)).collect())
    assert got == sorted((k, *x) for k, t in enumerate(texts) if t is not None for x in triplets(t))
    assert (0, "far away", "is in", "the tail") in got


WORDS = ["learn learning learned", "unlearning learning graph graphs", "stone cornerstone graph", "brick bricks paper learning"]


def roots(labels):
    """The longest label of each component of plural, containment and trigram pairs, ties by the label."""
    tri = lambda w: {f"  {w}  "[k : k + 3] for k in range(len(w) + 2)}
    plural = lambda a, b: a.rstrip("s") == b.rstrip("s") and abs(len(a) - len(b)) <= 2
    holds = lambda a, b: min(len(a), len(b)) > 4 and len(a) != len(b) and (a in b or b in a)
    near = lambda a, b: len(tri(a) & tri(b)) >= 0.85 * len(tri(a) | tri(b))
    part = {x: {x} for x in labels}
    for a in labels:
        for b in labels:
            if a < b and (plural(a, b) or holds(a, b) or near(a, b)):
                both = part[a] | part[b]
                part.update(dict.fromkeys(both, both))
    return {x: min(c, key=lambda y: (-len(y), y)) for x, c in part.items()}


def test_merges_by_containment(spark, tmp_path):
    folder = documents(spark, tmp_path, WORDS)
    tokens = {x for t in WORDS for x in t.split() if len(x) >= 5}
    to = roots(tokens | {x + "s" for x in tokens if x < "c"})
    assert to["learn"] == "unlearning" and to["stone"] == "cornerstone"
    assert dict(map(tuple, QUERIES["dedup_components"](spark, folder).collect())) == {x: y for x, y in to.items() if x != y}
    want = {}
    for t in WORDS:
        words = sorted({x for x in t.split() if len(x) >= 5}, key=lambda x: (-t.split().count(x), x))
        for k, a in enumerate(words):
            for b in words[k + 1 :]:
                if to[a] != to[b]:
                    want[to[a], to[b]] = want.get((to[a], to[b]), 0) + 1
    assert {(r.src, r.dst): r.edge_count for r in QUERIES["apply_merges"](spark, folder).collect()} == want


def test_label_passes_over_tables(spark):
    """The registered SQL at the smallest scale."""
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("nation", "region", "supplier", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("triplet_normalise", "relabel_merge", "abbrev_expand", "junk_nodes"):
        got = QUERIES[name](spark, sf)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name


def test_graph_passes_over_documents(spark, tmp_path):
    folder = documents(spark, tmp_path, ["stone paper stone", "paper stone paper", "paper stone paper", "brick their paper", "cornerstone brick"])
    assert {tuple(r) for r in QUERIES["reciprocal_prune"](spark, folder).collect()} == {("paper", "stone", 2), ("brick", "paper", 1), ("brick", "their", 1), ("paper", "their", 1), ("brick", "cornerstone", 1)}
    got = {(r.src, r.dst): r.edge_count for r in QUERIES["tidy_graph"](spark, folder).collect()}
    assert got == {("paper", "cornerstone"): 2, ("brick", "paper"): 1, ("brick", "cornerstone"): 1}


def test_paths_and_many_matches(spark):
    schema = "subject string, predicate string, object string, chunk_id int, doc_name string, row_ord long"
    arcs = ["ab", "cb", "cd", "ae", "ed", "df", "xy"]
    g = graph.build_graph(spark.createDataFrame([(s, "uses", o, 0, "x", k) for k, (s, o) in enumerate(arcs)], schema)).settled()
    path = traverse.shortest_path(g, "b", "f").orderBy("step").collect()
    assert [tuple(r) for r in path] == [(1, "b", "c", "uses"), (2, "c", "d", "uses"), (3, "d", "f", "uses")]
    assert traverse.shortest_path(g, "a", "x").count() == 0
    star = graph.build_graph(spark.createDataFrame([("hub", "uses", f"leaf {k}", 0, "x", k) for k in range(1200)], schema)).settled()
    assert set(query.find_node(star, "leaf")) == {f"leaf {k}" for k in range(1200)}
    assert query.find_node(star, "leaf", most=2)[:2] == ["leaf 0", "leaf 1"]
