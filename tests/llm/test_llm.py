import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import fingerprint, linededup, mixing, ngram_join, pii, sentencepiece_codec, textmodels, topk, urlfilter
from weft.llm.queries import RULES, tokenizer_path

DOC = "doc_id long, text string, source string, extra string"


def rows(spark, texts, schema=DOC):
    return spark.createDataFrame([(k, t, f"s{k % 3}" if k % 4 else None, "x") for k, t in enumerate(texts)], schema)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_pii_distinct_and_coreferent(spark):
    text = "Mr John Smith met Mrs Smith. A@B.org a@b.org +1 (974) 555-3436 4111 1111 1111 1111 10.0.0.1 2020-01-15"
    docs = rows(spark, [text, "again 10.0.0.1 and 10.0.0.2, a@b.org", None, "", "plain words"])
    out = {r.doc_id: r for r in pii.replace_pii(docs, "k").collect()}
    assert [out[k].n_replaced for k in range(5)] == [7, 3, 0, 0, 0]
    assert out[2].text is None and out[4].text == "plain words" and "2020-01-15" in out[0].text
    for secret in ("Smith", "10.0.0.1", "555-3436", "4111", "b.org"[:1] + "@"):
        assert secret not in out[0].text
    a, b = out[1].text.split()[1], out[1].text.split()[3]
    assert a in out[0].text and a != b.rstrip(",")
    assert pii.replace_pii(docs.limit(0), "k").count() == 0


def test_surrogates_of_short_formats_stay_distinct(spark):
    found = spark.createDataFrame([("email", f"a{k}@b.io") for k in range(10)] + [("name-latin-m", n) for n in ("john", "paul", "bob")], "kind string, norm string")
    got = pii.assign(found, "k").collect()
    assert len(got) == 13 and len({(r.kind, r.sur) for r in got}) == 13
    assert not {(r.kind, r.sur) for r in got} & {(r.kind, r.norm) for r in got}


def test_ordinal_orders_three_grades(spark):
    texts = [f"{prose(k, 20)} {['bad !!! ###', 'fair enough', 'good excellent'][k % 3]}" for k in range(240)]
    docs = rows(spark, texts)
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("quality"))
    got = textmodels.grade_quality(docs, labels).where("held_out").withColumn("g", F.col("doc_id") % 3).groupBy("g").agg(F.avg("expected_grade").alias("e")).orderBy("g").collect()
    assert got[0].e < 0.7 < got[1].e < 1.4 < got[2].e
    none = textmodels.grade_quality(docs, labels.limit(0))
    assert none.count() == 240 and none.where("selected or expected_grade is not null").count() == 0


def test_toxicity_held_out(spark):
    texts = [prose(k, 60) + (" you idiot" if k % 4 == 0 else "") for k in range(400)] + [None, ""]
    docs = rows(spark, texts)
    labels = docs.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = textmodels.classify_toxicity(docs, labels)
    held = got.where("held_out and doc_id < 400").select("doc_id", "predicted").collect()
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert got.where("doc_id >= 400 and predicted = 0").count() == 2
    assert textmodels.classify_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_lines_equal_brute_force(spark):
    r = random.Random(3)
    base = [prose(k, 6) for k in range(12)]
    base += ["x" * 31, "x" * 32, "x" * 33, "short line", "short lin", "", "  "]

    def edit(s):
        k = r.randrange(max(1, len(s)))
        return r.choice([s[:k] + "q" + s[k:], s[:k] + s[k + 1 :], s[:k] + "z" + s[k + 1 :]])

    texts = ["\n".join(edit(x) if r.random() < 0.4 else x for x in r.choices(base, k=6)) for _ in range(40)] + [None, ""]
    seen, near = [], lambda a, b: a == b or (min(len(a), len(b)) >= linededup.MIN_NEAR and abs(len(a) - len(b)) <= 1 and lev1(a, b))

    def lev1(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    want = []
    for t in texts:
        if t is None:
            want.append(None)
            continue
        out = []
        for line in t.split("\n"):
            s = line.strip()
            if not s or not any(near(s, x) for x in seen):
                out.append(line)
            if s:
                seen.append(s)
        want.append("\n".join(out))
    got = linededup.dedup_lines(rows(spark, texts)).orderBy("doc_id").collect()
    assert [g.text for g in got] == want


def test_sentencepiece_equals_library(spark):
    texts = ["", " ", "a  b", "\n\nx", "▁ y", "é😀　z", "a" * 300, "tab\there", None, "a\U0010ffff  b\U0010ffff c", "x\U0010ffff", "a\n b\n", "\u0085 \u2028", "y" * 250 + ". z." * 3, *(prose(k, 30) for k in range(5))]
    got = sentencepiece_codec.encode_documents(rows(spark, texts), tokenizer_path(), check_one_in=1).orderBy("doc_id").collect()
    lib = sentencepiece_codec.Codec(tokenizer_path()).library
    for t, g in zip(texts, got, strict=True):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("boundary", ["words", "documents"])
def test_mix_meets_targets(spark, boundary):
    docs = rows(spark, [prose(k, 5 + k % 40) if k % 50 else None for k in range(300)])
    got = mixing.mix_sources(docs, boundary=boundary).groupBy("source", "target", "source_size").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    slack = 0.51 if boundary == "words" else 45
    assert len(got) == 4 and all(abs(r.t - r.target) <= slack and r.over <= 0 and r.target <= 2 * r.source_size for r in got)
    assert abs(sum(r.target for r in got) - 1.5 * sum(r.source_size for r in got)) < 1e-6
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = [prose(k, 300, 100_000) for k in range(9)] + ["", None, "one two"]
    got = fingerprint.fingerprint_edits(rows(spark, texts)).orderBy("doc_id").collect()
    for k, g in enumerate(got):
        t, x = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        n = len(t) // 4
        assert g.edited_sha256 == hashlib.sha256((t[: len(t) - n] + x[:n]).encode()).hexdigest()
        assert g.fingerprint == fingerprint.to_text(fingerprint.sketch(t))
    assert all(0.3 < g.near_edited < 0.9 and g.near_next < 0.05 and g.held_by_edited > g.near_edited for g in got[:8])
    a, b = fingerprint.sketch(texts[0]), fingerprint.sketch(texts[0] + " " + texts[1])
    assert fingerprint.containment(a, b) > 0.95 and np.array_equal(fingerprint.from_text(fingerprint.to_text(a)), a)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.org/es/x?q", "http://example.org/en/12#a", "http://x.com/de/1", "http://notexample.net", "https://bad.net/p/", "http://www.bad.net/p?x=1"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://bad.net/p",), (None,)], "url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, RULES, listed).orderBy("page_id").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3:6] == [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.com", "/de/1", "com/de/", "block")]
    assert [g[3] for g in got[6:]] == ["allow", "block", "block"]
    assert urlfilter.judge_urls(pages, RULES, listed.limit(0)).where("verdict = 'block'").count() == 3


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    m = (r.normal(size=(300, 8)) * r.choice([0.1, 1, 5], size=(300, 1))).astype(np.float32)
    m[50:90] = m[50]
    data = [(k, v.tolist()) for k, v in enumerate(m)] + [(300, None), (301, [float("nan")] * 8), (320, [float("inf")] * 8), (None, [1.0] * 8)]
    got = {}
    for x in topk.exact_top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    q = np.floor(64 * m.astype(float))
    for i in range(0, 300, 20):
        s = q @ q[i]
        best = sorted((k for k in range(300) if k != i), key=lambda k: (-s[k], k))[:20]
        assert sorted(got[i]) == [(n + 1, k, int(s[k])) for n, k in enumerate(best)]
    assert set(got) == set(range(0, 300, 20))


def test_jaccard_components_equal_brute_force(spark):
    r = random.Random(5)
    texts = []
    for k in range(12):
        base = prose(k, 60, 5000).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(60)] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "a b", "A  b", "", None, "x"]

    def shingles(t):
        w = (t or "").lower().split()
        n = min(5, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    s, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {x.doc_id: x for x in ngram_join.jaccard_components(rows(spark, texts).repartition(3)).collect()}
    assert {k: (x.n_shingles, x.component_id) for k, x in got.items()} == {k: (len(s[k]), top(k)) for k in range(len(s))}
    kept = ngram_join.keep_one_of_each(rows(spark, [*texts, None]).withColumn("doc_id", F.when(F.col("text") != "x", F.col("doc_id")))).count()
    assert kept >= len({top(k) for k in range(len(s))})


def test_empty_tables(spark):
    docs = rows(spark, ["a"]).limit(0)
    assert ngram_join.jaccard_components(docs).count() == 0
    assert linededup.dedup_lines(docs).count() == 0
    assert fingerprint.fingerprint_edits(docs).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lines_that_differ_behind_an_equal_character(spark):
    lines = ["the order 1100 was paid today", "the order 1200 was paid today", "aabb" * 8, "aabb" * 4 + "aacb" + "aabb" * 3, "the order 1300 was lost again", "the order 1220 was paid today"]
    got = [r.text for r in linededup.dedup_lines(rows(spark, ["\n".join(lines), *lines])).orderBy("doc_id").collect()]
    assert got[0] == "\n".join([lines[0], lines[2], lines[4]])
    assert got[1:] == [""] * len(lines)


def test_grades_of_any_number(spark):
    texts = [f"{prose(k, 20)} " + " ".join(["good"] * (k % 20)) for k in range(600)]
    docs = rows(spark, texts)
    labels = docs.select("doc_id", (F.col("doc_id") % 100 / 4).alias("quality"))
    model = textmodels.fit_ordinal(docs, labels, steps=5)
    assert model["grades"].tolist() == sorted({k % 100 / 4 for k in range(600) if zlib.crc32(str(k).encode()) % 5})
    assert len(model["grades"]) > 90 and (np.diff(model["theta"]) > 0).all()
    got = textmodels.score_quality(docs.limit(20), model, tail_from=10.0).collect()
    assert all(0 <= g.tail_probability <= 1 and 0 <= g.expected_grade <= 24.75 for g in got)
    assert textmodels.score_quality(docs, model, tail_from=0.0).where("tail_probability != 1").count() == 0
    many = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") / 7).alias("quality"))
    with pytest.raises(ValueError):
        textmodels.sample_labels(many, "quality")


def test_ordinal_equals_a_dense_fit():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 6))
    y = np.digitize(x @ [1.0, -2, 0.5, 0, 0, 1] + r.logistic(size=400), [-2.0, 0.0, 1.5])
    weight, l2 = r.uniform(0.5, 2, 400), 1e-2

    def loss(w, theta):
        cdf = 1 / (1 + np.exp(-(np.concatenate([[-np.inf], theta, [np.inf]])[None, :] - (x @ w)[:, None])))
        return -(weight / weight.sum() * np.log(np.diff(cdf)[np.arange(400), y])).sum() + l2 / 2 * (w @ w)

    w, theta = textmodels.solve_ordinal(np.full(400, 6), np.tile(np.arange(6), 400), x.ravel(), y, weight, 6, 2000, l2)
    best = loss(w, theta)
    point, step = np.concatenate([w, theta]), 1e-4
    for k in range(9):  # at the optimum no parameter's change lowers the loss
        for d in (step, -step):
            moved = point.copy()
            moved[k] += d
            assert loss(moved[:6], moved[6:]) > best - 1e-8
    plain = np.zeros(9)
    plain[6:] = [-1, 0, 1]
    for _ in range(4000):  # and plain descent with numeric slopes ends in the same place
        slope = np.array([(loss(*np.split(plain + 1e-5 * e, [6])) - loss(*np.split(plain - 1e-5 * e, [6]))) / 2e-5 for e in np.eye(9)])
        plain -= 1.0 * slope
        if np.abs(slope).max() < 1e-6:
            break
    assert np.allclose(plain, point, atol=2e-3)


def test_training_rows_stay_bounded(spark):
    docs = spark.createDataFrame([(k % 10, f"text {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 10, k % 2) for k in range(300)], "doc_id long, toxic int")
    assert textmodels._labelled(docs, labels, "toxic", 4).groupBy("doc_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("k, near, alphabet, lengths", [(1, 20, "ab1. ", (30, 31, 32, 33, 63, 64, 65)), (1, 2, "ab1é", (2, 3, 4, 7, 8, 9, 15, 16, 17)), (2, 3, "ab1.", (4, 6, 8, 9, 12)), (0, 0, "ab", (1, 2, 3))])
def test_lines_within_any_bound_equal_brute_force(spark, k, near, alphabet, lengths):
    r = random.Random(k)

    def edited(line):
        for _ in range(r.randrange(4)):
            at, kind = r.randrange(len(line) + 1), r.randrange(3)
            line = line[:at] + (r.choice(alphabet) if kind < 2 else "") + line[at + (kind > 0) :]
        return line

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    base = ["".join(r.choice(alphabet) for _ in range(r.choice(lengths))) for _ in range(20)] + ["-" * max(lengths)]
    texts = ["\n".join(edited(r.choice(base)) for _ in range(5)) for _ in range(30)] + [None, "", " \n"]
    seen, want = [], []
    for t in texts:
        out = []
        for line in [] if t is None else t.split("\n"):
            s = line.strip()
            if not s or not any(s == x or (min(len(s), len(x)) >= near and abs(len(s) - len(x)) <= k and distance(s, x) <= k) for x in seen):
                out.append(line)
            seen += [s] * bool(s)
        want.append(None if t is None else "\n".join(out))
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, keep int, row int, id int")
    assert [g.text for g in linededup.dedup_lines(docs, k, near).orderBy("doc_id").collect()] == want


def test_pii_names_numbers_and_what_stays(spark):
    texts = [
        "Mr John Smith wrote. Smith left and JOHN SMITH too. Smithson did not.",
        "MR JOHN SMITH and mr john smith",
        "Maria Garden, Sarah The, Miss Universe, 1234567890123456 items, 999.1.2.3, DE88 3704 0044 0532 0130 00",
        "my name is Priya Raman; Raman writes. DE89 3704 0044 0532 0130 00",
        "Smith alone, in another text",
    ]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, map int, k int, row int")
    out = [r.text for r in pii.replace_pii(docs, "k").orderBy("doc_id").collect()]
    assert not {"John", "Smith", "JOHN", "SMITH"} & set(out[0].replace(".", " ").split()) and "Smithson" in out[0]
    given, last = out[0].split()[1:3]
    assert out[0].split()[4:5] == [last] or last in out[0].split(".")[1]
    assert out[1].lower().count(f"{given} {last}".lower()) == 2 and "smith" not in out[1].lower()
    assert out[2] == texts[2] and out[4] == texts[4] and out[5] == out[0]
    assert "Raman" not in out[3] and "Priya" not in out[3] and "DE89 3704" not in out[3]
    iban = out[3].split(". ")[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert given in pii.GIVEN["latin", "m"]


def test_surrogates_are_a_permutation_of_each_format(spark):
    norms = [("email", f"{a}{b}{c}@b.io") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghij"]
    norms += [("ssn", f"{k:09d}") for k in range(300)] + [("ip", f"{k}.0.0.{k % 7}") for k in range(256)] + [("name-latin-s", x) for x in ("smith", "smyth", "o'brien", "müller", "li")]
    norms += [("name-latin-m", x.lower()) for x in pii.GIVEN["latin", "m"]] + [("phone", f"+1555{k:07d}") for k in range(200)]
    got = pii.assign(spark.createDataFrame(norms, "kind string, norm string").repartition(4), "k").collect()
    assert {(r.kind, r.norm) for r in got} == set(norms) and len({(r.kind, r.sur) for r in got}) == len(norms)
    shape = lambda x: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in x)
    assert all(shape(r.norm) == shape(r.sur) for r in got if r.kind not in ("ip", "name-latin-m"))
    assert {r.sur for r in got if r.kind == "name-latin-m"} == {x.lower() for x in pii.GIVEN["latin", "m"]}
    few = pii.assign(spark.createDataFrame(norms[:500:7], "kind string, norm string"), "k").collect()
    assert sum((r.kind, r.norm, r.sur) in set(map(tuple, got)) for r in few) >= 0.5 * len(few)  # a larger table moves only collisions


def test_a_format_that_is_used_up(spark):
    full = [("email", f"{a}@{b}.io") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.assign(spark.createDataFrame(full, "kind string, norm string"), "k").collect()
    assert len({r.sur for r in got}) == len(full) and not [r for r in got if r.norm == r.sur]


def test_fingerprints_estimate_exact_figures(spark):
    texts = [prose(k, 200 + 40 * k, 3000) for k in range(24)]
    texts = [x for t in texts for x in (t, t + " " + prose(len(t), 400, 3000))]  # each text is a part of the next one
    docs = spark.createDataFrame([(f"id {k:03d}", t, 1, 2) for k, t in enumerate(texts)], "doc_id string, text string, part int, id int")
    got = fingerprint.fingerprint_edits(docs.repartition(3)).orderBy("doc_id").collect()

    def exact(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    errors = []
    for k, g in enumerate(got):
        t, x = texts[k], texts[(k + 1) % len(texts)]
        n = len(t) // 4
        a, b, c = exact(t), exact(t[: len(t) - n] + x[:n]), exact(x)
        errors += [(g.near_edited, len(a & b) / len(a | b)), (g.near_next, len(a & c) / len(a | c)), (g.held_by_edited, len(a & b) / len(a)), (g.held_by_next, len(a & c) / len(a))]
    assert max(abs(a - b) for a, b in errors) < 0.25 and sum(abs(a - b) for a, b in errors) / len(errors) < 0.04
    a, b = fingerprint.sketch(texts[0]), fingerprint.sketch(texts[9])
    both = np.union1d(fingerprint.shingles(texts[0]), fingerprint.shingles(texts[9])) >> np.uint64(16)
    assert np.array_equal(fingerprint.merged(a, b), both[both < np.uint64(fingerprint.LIMIT)])


def test_fingerprints_of_repeated_and_null_ids(spark):
    texts = [prose(k % 7, 30, 500) for k in range(200)]
    docs = spark.createDataFrame([(None if k % 3 == 0 else 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = fingerprint.fingerprint_edits(docs).collect()
    assert len(got) == 200 and sum(g.doc_id is None for g in got) == sum(k % 3 == 0 for k in range(200))
    ring = {}
    for g in got:
        ring.setdefault(g.fingerprint, set()).add(g.n_chars)
    assert len(ring) == 7  # equal texts have equal fingerprints


def test_bloom_filter_of_one_and_many_blocks(spark, monkeypatch):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("u"))
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("u"), F.lit(1).alias("may"), F.lit(2).alias("row"))
    for most in (1 << 18, 4):  # broadcast, and joined by block
        monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", most)
        got = urlfilter.listed(rows, "u", keys, "u").where("listed").count()
        assert got == 4000
    one = urlfilter.bloom(keys, "u", 1)
    assert one.count() == 1 and urlfilter.probe(rows, F.col("u"), one, 1).where("may").count() == 20_000  # full: all pass
    blocks = urlfilter.n_blocks(4000)
    passed = urlfilter.probe(rows, F.col("u"), urlfilter.bloom(keys, "u", blocks), blocks).where("may").count()
    assert 4000 <= passed < 4000 + 0.05 * 16_000
