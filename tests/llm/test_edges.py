"""Every operator on null ids and texts, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from weft.llm import fingerprint, linededup, mixing, ngram_join, pii, queries, sentencepiece_codec, textmodels, topk, urlfilter

#: Names that operators use inside or that their results have.
NAMES = ["row", "key", "id", "map", "keep", "k", "i", "m", "r", "h", "part", "may", "block", "found", "flag", "name", "w0", "b", "copy", "size", "s", "last", "whole", "twice", "gone", "n", "score", "n_lines", "n_replaced", "held_out", "_k", "_id", "_s", "host", "canon", "label", "y", "w", "url", "rule", "place", "first"]
RESULTS = {"n_lines", "n_replaced", "held_out", "score", "host", "rule"}


def table(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    plain = [" ".join(word() for _ in range(30)) + "\n" + " ".join(word() for _ in range(9)) for _ in range(20)]
    long = " ".join(word() for _ in range(60_000))
    texts = [*plain, plain[0], plain[0], None, None, "", "", " \n\t ", "x", long, "Mr John Smith a@b.org", "ß" * 5000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, plain[3]), (3, plain[3]), (3, "other text of id 3"), (None, plain[4]), (None, None), (None, "y"), (None, "y")]
    docs = spark.createDataFrame([(i, t, None if j % 4 == 0 else f"s{j % 3}") for j, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    return docs.select("*", *[F.lit(7).alias(c) for c in NAMES]).repartition(3)


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3) for k in range(20)] + [(None, 1, 1), (4, None, None), (5, 1, 2), (5, 0, 0)], "doc_id long, toxic int, quality int")


WHOLE = {  # these keep every row and all other columns
    "pii": lambda s, d: pii.replace_pii(d, "k"),
    "quality": lambda s, d: textmodels.grade_quality(d, labels(s), steps=5),
    "lines": lambda s, d: linededup.dedup_lines(d),
    "toxicity": lambda s, d: textmodels.classify_toxicity(d, labels(s), steps=5),
    "urls": lambda s, d: urlfilter.judge_urls(d.withColumn("page", F.col("text")), queries.RULES, d.select(F.concat(F.lit("http://x.org/"), "doc_id").alias("u")), "text", "u").drop("page"),
}
ROWS = {  # these give a row a document
    "sentencepiece": lambda s, d: sentencepiece_codec.encode_documents(d, queries.tokenizer_path()),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "fingerprint": lambda s, d: fingerprint.fingerprint_edits(d),
    "jaccard": lambda s, d: ngram_join.jaccard_components(d),
}
SOME = {"repeat": lambda s, d: mixing.repeat_documents(d), "one_of_each": lambda s, d: ngram_join.keep_one_of_each(d)}


@pytest.mark.parametrize("name", [*WHOLE, *ROWS, *SOME])
def test_odd_rows(spark, name):
    docs = table(spark)
    f = {**WHOLE, **ROWS, **SOME}[name]
    got = f(spark, docs)
    rows = got.collect()
    if name in SOME:
        assert got.columns == docs.columns and 0 < len(rows)
    else:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    if name not in ROWS:
        assert all(r[c] == 7 for r in rows for c in NAMES if c not in RESULTS)
    empty = f(spark, docs.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def test_odd_rows_have_their_results(spark):
    docs = table(spark)
    lines = {(r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()}
    assert (22, None) in lines and (24, "") in lines and (None, None) in lines
    sets = ngram_join.jaccard_components(docs).collect()
    assert {r.component_id for r in sets if r.doc_id in (0, 20, 21)} == {0} and all(r.component_id is None for r in sets if r.doc_id is None)
    assert {r.n_shingles for r in sets if r.doc_id in (22, 24, 26)} == {0} and {r.component_id for r in sets if r.doc_id == 24} == {24}
    taken = mixing.mix_sources(docs).collect()
    assert all(r.taken == 0 for r in taken if r.size == 0) and all(r.taken <= 2 * r.size for r in taken)
    kept = ngram_join.keep_one_of_each(docs).collect()
    assert sum(r.doc_id == 3 for r in kept) == 1 and not any(r.doc_id in (20, 21) for r in kept) and sum(r.doc_id is None for r in kept) == 4
    tox = textmodels.classify_toxicity(docs, labels(spark), steps=5).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in tox) and all(r.held_out for r in tox if r.doc_id is None)


def test_top_k_on_odd_vectors(spark):
    data = [(k, [1.0, float(k % 3)]) for k in range(60)] + [(20, [9.0, 9.0]), (20, [9.0, 9.0]), (None, [1.0, 1.0]), (61, []), (80, [None, 1.0]), (100, [2.0])]
    got = topk.exact_top_k(spark.createDataFrame([(*r, 7) for r in data], "vec_id long, embedding array<double>, b int"), k=3).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 100} and all(r.vec_id != r.query_id and r.vec_id not in (80, None) for r in got)
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [(1, 0), (2, 1), (3, 2)]  # ties
    with pytest.raises(ValueError):
        topk.exact_top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"))
