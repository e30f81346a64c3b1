"""The corpus pipeline on 200 documents against plain Python."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece

from weft.llm import textmodels
from weft.llm.queries import tokenizer_path

N = 200


def corpus():
    r = random.Random(11)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [prose(8) for _ in range(5)]
    docs = []
    for k in range(N):
        lines = [prose(r.randrange(5, 25)) for _ in range(r.randrange(1, 6))]
        if k % 7 == 0:
            lines.insert(0, r.choice(shared))
        if k % 11 == 0:
            line = r.choice(shared)
            lines.append(line[:9] + "x" + line[10:])
        text = "\n".join(lines)
        if k % 5 == 4 and docs:  # a near copy of an earlier one, on one line
            text = docs[r.randrange(len(docs))][1].replace("\n", " ") + " " + r.choice(words)
        if k % 8 == 3:
            text += " you are a stupid idiot"
        docs.append((k, text, ["web", "books", None][r.randrange(3)]))
    return docs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in corpus()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 8 == 3)) for k in range(N)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 20 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def lines_kept(docs):
    seen, out = [], []
    for i, text, s in docs:
        kept, full = [], 0
        for line in text.split("\n"):
            x = line.strip()
            full += bool(x)
            if not x or not any(near(x, y) for y in seen):
                kept.append(line)
            if x:
                seen.append(x)
        if full == 0 or any(x.strip() for x in kept):
            out.append((i, "\n".join(kept), s))
    return out


def one_of_each(docs):
    def shingles(t):
        w = t.lower().split()
        n = min(5, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    sets = {i: shingles(t) for i, t, _ in docs}
    part = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                both = part[a] | part[b]
                part.update(dict.fromkeys(both, both))
    return [d for d in docs if d[0] == min(part[d[0]])]


def mixed(docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    own = Counter()
    for i, _, s in docs:
        own[s] += size[i]
    order = sorted(own, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(own.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * own[s]}
        for s in full or open_:
            target[s] = 2.0 * own[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        whole, rest = divmod(int(target[s] + 0.5), own[s])
        for i, t, _ in sorted((d for d in docs if d[2] == s), key=lambda d: hashlib.md5(f"mix-1:{d[0]}".encode()).hexdigest()):
            part = max(0, min(size[i], rest))
            rest -= size[i]
            out += [(i, t, s)] * (whole + (part > 0 and 2 * part >= size[i]))
    return out


def test_stages_and_the_whole(spark, folder):
    docs, want = spark.read.parquet(f"{folder}/documents.parquet"), corpus()
    columns = docs.columns
    predicted = textmodels.classify_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).select("doc_id", "predicted").collect()
    clean = {r.doc_id for r in predicted if not r.predicted}
    assert sum((k in clean) == (k % 8 != 3) for k in range(N)) >= 0.97 * N
    steps = [lambda d: [x for x in d if x[0] in clean], lines_kept, one_of_each, mixed]
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs, want = stage(spark, docs, folder), step(want)
        got = docs.collect()
        assert docs.columns == columns and sorted((r.doc_id, r.text, r.source) for r in got) == sorted(want, key=lambda d: d[:2]), name
        assert len(want) > 50 and all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, docs.schema)
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    ids = {i: lib.encode(t, add_bos=True, add_eos=True) for i, t, _ in want}
    expected = sorted((i, len(ids[i]), hashlib.sha256(lib.decode(ids[i]).encode()).hexdigest()) for i, _, _ in want)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    for result in (last, corpus_pipeline.run(spark, folder)):
        assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in result.collect()) == expected


def test_each_operator_has_its_query(spark, folder):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{k}_") for q in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    for q in ("op1_pii", "op2_quality", "op3_linededup", "op4_sentencepiece", "op5_toxicity", "op6_mixing", "op7_fingerprint", "op10_ngram_join"):
        assert names[q](spark, folder).count() == N, q
