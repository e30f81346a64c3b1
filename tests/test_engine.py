import difflib
import random

import pytest
from pyspark.sql import functions as F

from weft.functions.text import clean_text, normalise_label, parse_concepts, parse_triplet_lines, sentences
from weft.operators import chunking, extract, graph, query, tidy, traverse, view, weights
from weft.operators.components import components
from weft.plans import repl, testgraphs
from weft.plans.pipeline import triplets_of, weighted_graph
from weft.sources import files


#: Labels for the cleaning passes: abbreviations, plurals, containment, junk and reciprocal pairs.
DIRTY = [
    ("ML", "uses", "neural networks", 0),
    ("machine learning", "is part of", "(Graph).", 0),
    ("neural network", "enables", "machine learning", 0),
    ("learning", "co-occurs with", "machine learning", 1),
    ("alpha node", "co-occurs with", "beta node", 1),
    ("alpha node", "co-occurs with", "beta node", 2),
    ("beta node", "co-occurs with", "alpha node", 2),
    ("alpha node", "uses", "gamma node", 2),
    ("gamma node", "uses", "alpha node", 3),
    ("data", "uses", "3.14", 3),
    ("x", "uses", "2020-01", 3),
    ("a b c", "uses", "one two three four five six", 3),
    ("neural_networks", "uses", "knowledge graphs", 4),
    ("kg", "is a type of", "knowledge graph", 4),
    ("ai", "co-occurs with", "chain", 5),
    ("deep  learning!", "is a subset of", "ML", 5),
]


def dirty(spark):
    rows = [(s, p, o, c, "dirty", k) for k, (s, p, o, c) in enumerate(DIRTY)]
    return spark.createDataFrame(rows, "subject string, predicate string, object string, chunk_id int, doc_name string, row_ord long")


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("learn-\ning", "learning"), ("x\n 12 \n\n\nPage 3 of 9\ny", "x\n\ny"), ("a😀b", "ab"), ("“q” – it’s", '"q" - it\'s'), ("a   b", "a b"), ("", ""), (None, None)])
def test_clean(spark, text, want):
    assert one(spark, text, clean_text) == want


def test_sentences(spark):
    text = "Dr. Smith went home. He slept!\nThen U.S.A. Is here? Yes it costs 3.14 now. Mrs. Jones ran."
    assert one(spark, text, sentences) == ["Dr. Smith went home.", "Then U.S.A. Is here?", "Yes it costs 3.14 now."]
    assert one(spark, None, sentences) == []


@pytest.mark.parametrize(("raw", "want"), [("1. Machine Learning, 2. neural net", ["machine learning", "neural net"]), ("- a1\n- b2\n- a1", ["a1", "b2"]), ("x, ab", ["ab"]), ("one two three four five six", []), ("foo -", ["foo "]), ("", []), (None, [])])
def test_concepts(spark, raw, want):
    assert one(spark, raw, parse_concepts) == want


@pytest.mark.parametrize(("raw", "want"), [("1) A | uses | B.", [("a", "uses", "b")]), ("a | b\na | b | c | d", []), ("a |  | c", []), ("a | b | " + "w " * 9, []), (None, [])])
def test_triplet_lines(spark, raw, want):
    assert [tuple(r) for r in one(spark, raw, parse_triplet_lines)] == want


def test_chunks_have_tails(spark):
    text = " ".join(f"Sentence number {k} has exactly so many words in it as the others have today." for k in range(15))
    spans = chunking.chunk_spans(spark.createDataFrame([("d", text), ("empty", ""), ("null", None)], "doc_name string, text string"))
    got = {r.doc_name: [(x.s, x.e) for x in r.sp] for r in spans.collect()}
    assert got == {"d": [(1, 15), (14, 15), (15, 15)], "empty": [], "null": []}


def test_labels_and_tidy(spark):
    assert one(spark, "(graph).", normalise_label) == "graph"
    assert one(spark, "neural_networks", normalise_label) == "neuralnetworks"
    g = tidy.tidy(graph.build_graph(dirty(spark)))
    nodes = {r.node for r in g.nodes.collect()}
    assert "machine learning" in nodes and not nodes & {"ml", "learning", "data", "x", "3.14", "a b c"}


def test_reciprocal(spark):
    rows = [("a", "co-occurs with", "b"), ("a", "co-occurs with", "b"), ("b", "co-occurs with", "a"), ("c", "uses", "d"), ("d", "uses", "c")]
    t = spark.createDataFrame([(s, p, o, 0, "x", k) for k, (s, p, o) in enumerate(rows)], "subject string, predicate string, object string, chunk_id int, doc_name string, row_ord long")
    pairs = lambda **kw: {(r.src, r.dst) for r in tidy.prune_reciprocal(graph.build_graph(t), **kw).edges.collect()}
    assert pairs() == {("a", "b"), ("c", "d"), ("d", "c")}
    assert pairs(treat_all_as_cooc=True) == {("a", "b"), ("c", "d")}


def test_pair_joins_equal_brute_force(spark):
    words = ["learning", "machine learning", "neural network", "neural networks", "networks", "network", "abcdefghij klm", "abcdefghij klmn", "chain", "ai", "deep learnings", "deep learning"]
    nodes = spark.createDataFrame([(w,) for w in words], "node string")

    def tri(w):
        p = f"  {w}  "
        return {p[k : k + 3] for k in range(len(p) - 2)}

    pairs = [(a, b) for a in words for b in words if a < b]
    assert {tuple(r) for r in tidy.plural_pairs(nodes).collect()} == {(a, b) for a, b in pairs if a.rstrip("s") == b.rstrip("s") and abs(len(a) - len(b)) <= 2}
    assert {tuple(r) for r in tidy.containment_pairs(nodes).collect()} == {(a, b) for a, b in pairs if min(len(a), len(b)) > 4 and (a in b or b in a)}
    want = {(a, b) for a, b in pairs if len(tri(a) & tri(b)) / len(tri(a) | tri(b)) >= 0.7}
    assert want and {(r.a, r.b) for r in tidy.trigram_pairs(nodes, 0.7).collect()} == want


@pytest.fixture(scope="module")
def small(spark):
    return weighted_graph(testgraphs.relational(spark, "/root/testdata/sf0.001"))


def test_graph_invariants(small):
    w = [r.weight for r in small.edges.collect()]
    assert all(0 <= x <= 1 for x in w) and max(w) == 1
    assert graph.degrees(small).agg(F.sum("degree")).first()[0] == 2 * small.edges.count()
    assert traverse.subgraph(small, "asia", 1).nodes.count() == 1 + query.neighbours(small, "asia").select("other").distinct().count()
    assert traverse.subgraph(small, "no such node").nodes.count() == 0


def test_path_is_symmetric(small):
    a, b = "asia", small.nodes.where("node like 'customer%'").agg(F.min("node")).first()[0]
    assert traverse.shortest_path(small, a, b).count() == traverse.shortest_path(small, b, a).count()


def test_repl_and_page(small, tmp_path):
    assert repl.answer(small, "quit") is None
    assert "hops" in repl.answer(small, "path asia, europe") or "no path" in repl.answer(small, "path asia, europe")
    assert repl.answer(small, "neighbours ASIA").startswith("asia")
    assert repl.answer(small, "summary") and repl.answer(small, "hubs") and repl.answer(small, "search asia") == "asia"
    page = view.render(small, str(tmp_path / "g.html"))
    assert "<svg" in open(page, encoding="utf-8").read()
    assert repl.answer(small, "subgraph asia", str(tmp_path)).endswith("subgraph-asia.html")


def test_empty_table(spark):
    g = graph.build_graph(spark.createDataFrame([], "subject string, predicate string, object string, chunk_id int, doc_name string, row_ord long"))
    assert graph.summary(g).first().nodes == 0
    assert weights.weigh(g).edges.count() == 0 and weights.weight_histogram(weights.weigh(g).edges).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.txt").write_bytes(b"caf\xe9 is a place. Next sentence is here.\r\nEnd of it.")
    (tmp_path / "in/a.TXT").write_text("One line of text stands here.")
    (tmp_path / "in/blank.txt").write_text(" \n")
    (tmp_path / "in/other.md").write_text("no")
    got = {r.doc_name: r.text for r in files.load_documents(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a.TXT", "b.txt"} and got["b.txt"].startswith("café")
    t = triplets_of(spark.createDataFrame(list(got.items()), "doc_name string, text string"))
    files.write_triplets(t, str(tmp_path / "t.csv"))
    assert files.read_triplets(spark, str(tmp_path / "t.csv")).count() == t.count() > 0


def test_model_extractor(spark):
    chunks = spark.createDataFrame([("d", 0, "some text")], "doc_name string, chunk_id int, text string")
    answers = extract.model_answers(chunks, None, lambda: lambda messages: " Graphs, nodes ")
    assert answers.first().raw == "Graphs, nodes"
    with pytest.raises(ConnectionError):
        extract.check_model(lambda: (_ for _ in ()).throw(OSError()))


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_components_of_a_path_take_few_rounds(spark, caplog):
    order = [*range(5, 4097), 1]
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    with caplog.at_level("INFO", logger="weft.operators.components"):
        got = dict(map(tuple, components(spark.range(1, 4097), edges).collect()))
    assert got == {k: k if k in (2, 3, 4) else 1 for k in range(1, 4097)}
    assert int(caplog.messages[-1].split()[1]) <= 20


def test_components_equal_brute_force(spark):
    r = random.Random(7)
    pairs = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(200)] + [("n1", "n1"), ("n1", None)]
    part = {f"n{k}": {f"n{k}"} for k in range(300)}
    for a, b in pairs[:-1]:
        both = part[a] | part[b]
        part.update(dict.fromkeys(both, both))
    nodes = spark.createDataFrame([(x,) for x in [*part, "n5", None]], "id string")
    got = components(nodes, spark.createDataFrame(pairs, "a string, b string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(x, min(c)) for x, c in part.items()] + [("n5", min(part["n5"])), (None, None)], key=repr)
    assert components(nodes.limit(0), spark.createDataFrame([], "a string, b string")).count() == 0


def test_greedy_merge_equals_a_sequential_pass(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 6))) for _ in range(60)})
    r.shuffle(words)
    place = {w: k for k, w in enumerate(words)}
    pairs = [tuple(r.sample(words, 2)) for _ in range(80)]
    to = {}
    for x in words:
        if x in to:
            continue
        partners = sorted({b if a == x else a for a, b in pairs if x in (a, b)}, key=place.get)
        for y in partners:
            if place[y] > place[x] and y not in to:
                keep = x if len(x) >= len(y) else y
                to[y if keep == x else x] = keep
    nodes = spark.createDataFrame(list(place.items()), "node string, node_ord int")
    got = tidy.replay_names(nodes, spark.createDataFrame(pairs, "a string, b string").distinct())
    assert {r.node: r.to for r in got.collect()} == to
    with pytest.raises(ValueError):
        tidy.replay_names(nodes, spark.createDataFrame(pairs, "a string, b string"), most=10)


def test_fuzzy_lookup_equals_close_matches(spark):
    r = random.Random(2)
    labels = sorted({"".join(r.choice("abcd ") for _ in range(r.randrange(3, 12))).strip() or "x" for _ in range(300)})
    g = graph.build_graph(spark.createDataFrame([(x, "uses", "hub", 0, "d", k) for k, x in enumerate(labels)], "subject string, predicate string, object string, chunk_id int, doc_name string, row_ord long")).settled()
    for q in ("abcd", "dcba abc", "bbb", "zzzz"):
        assert [r.node for r in query.lookup_fuzzy(g, q).collect()] == difflib.get_close_matches(q, [*labels, "hub"], n=5, cutoff=0.6)


def test_spans_equal_a_walk():
    r = random.Random(1)
    for _ in range(50):
        w, size, overlap = [r.randrange(1, 40) for _ in range(r.randrange(30))], r.randrange(1, 90), r.randrange(4)
        want, at = [], 0
        while at < len(w):
            end = at
            while end + 1 < len(w) and sum(w[at : end + 2]) <= size:
                end += 1
            want.append((at + 1, end + 1))
            at += max(1, end - at + 1 - overlap)
        assert chunking.span_lists([w], size, overlap) == [want]


def test_triplets_are_built_once_and_loaded_then(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("Machine learning uses neural networks. Machine learning enables speech systems.")
    folder, saved = str(tmp_path / "docs"), str(tmp_path / "saved")
    first = sorted(map(tuple, repl.triplets_at(spark, folder, saved).drop("row_ord").collect()))
    (tmp_path / "docs" / "a.txt").write_text("Something else altogether was written here today.")
    assert first and first == sorted(map(tuple, repl.triplets_at(spark, folder, saved).drop("row_ord").collect()))
