"""Extractors: concepts and triplets of chunks by rules, from recorded answers, or from a language model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COOCCURS
from ..functions.text import parse_concepts, parse_triplet_lines


def top_tokens(rows: DataFrame, keys: list[str], text: str = "text", n: int = 8) -> DataFrame:
    """(keys, concepts): the n most frequent tokens [a-z]{5,} of the lower-cased text, ties by code point, best first."""
    tokens = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{5,}"), F.lit(0))).alias("token"))
    counts = tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "token"))).where(F.col("rank") <= n)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("concepts"))


def rule_concepts(chunks: DataFrame, n: int = 8) -> DataFrame:
    """Offline extractor: (doc_name, chunk_id, concepts) by top_tokens."""
    return top_tokens(chunks, ["doc_name", "chunk_id"], n=n)


def replay_concepts(answers: DataFrame) -> DataFrame:
    """Concepts from recorded answers (doc_name, chunk_id, raw_concepts)."""
    return answers.select("doc_name", "chunk_id", parse_concepts(F.col("raw_concepts")).alias("concepts"))


def replay_triplets(answers: DataFrame) -> DataFrame:
    """Triplets (kind 0) from recorded answers (doc_name, chunk_id, raw_relations)."""
    rows = answers.select("doc_name", "chunk_id", F.posexplode(parse_triplet_lines(F.col("raw_relations"))).alias("seq", "t"))
    return rows.select("t.subject", "t.predicate", "t.object", "chunk_id", "doc_name", F.lit(0).alias("kind"), "seq")


def concept_prompt(text: str) -> list[dict]:
    """Messages that ask a model for the concepts of a text, in the form that parse_concepts reads."""
    rules = "List 5 to 15 key concepts of the text: nouns or noun phrases of at most four words, lower case, no duplicates. Answer with one comma-separated line and nothing else."
    return [{"role": "system", "content": "You extract concepts for a knowledge graph and keep to the format."}, {"role": "user", "content": f"{rules}\n\nText:\n{text}"}]


def relation_prompt(text: str, concepts: list[str]) -> list[dict]:
    """Messages that ask a model for triplets, in the form that parse_triplet_lines reads."""
    known = ", ".join(concepts) if concepts else "none identified"
    rules = "Give 3 to 10 relations that the text states, one a line, as: subject | predicate | object. Short lower-case phrases, no numbering."
    return [{"role": "system", "content": "You extract relations for a knowledge graph and keep to the format."}, {"role": "user", "content": f"{rules}\n\nKnown concepts: {known}\n\nText:\n{text}"}]


def model_answers(chunks: DataFrame, concepts: DataFrame | None, connect: Callable[[], Callable[[list[dict]], str]]) -> DataFrame:
    """(doc_name, chunk_id, raw) from a language model: concepts if concepts is None, else relations.

    connect makes one client a task (a function from messages to text). A failed call gives an empty answer.
    """
    rows = chunks.select("doc_name", "chunk_id", "text")
    if concepts is not None:
        rows = rows.join(concepts, ["doc_name", "chunk_id"], "left")
    asks_relations = concepts is not None

    def run(frames: Iterator) -> Iterator:
        client = connect()
        for frame in frames:
            raw = []
            for k, text in enumerate(frame["text"]):
                known = frame["concepts"].iloc[k] if asks_relations else None
                messages = relation_prompt(text, list(known) if known is not None else []) if asks_relations else concept_prompt(text)
                try:
                    raw.append(client(messages).strip())
                except Exception:  # noqa: BLE001  one failed call must not lose the chunk
                    raw.append("")
            yield frame[["doc_name", "chunk_id"]].assign(raw=raw)

    return rows.mapInPandas(run, "doc_name string, chunk_id int, raw string")


def check_model(connect: Callable[[], Callable[[list[dict]], str]]) -> None:
    """One probe on the driver before the job; raises ConnectionError if the model does not answer."""
    try:
        connect()([{"role": "user", "content": "ping"}])
    except Exception as e:
        raise ConnectionError("the language model does not answer") from e


def cooccurrence(concepts: DataFrame) -> DataFrame:
    """Triplets (kind 1): every ordered pair i < j of a chunk's concept list. A list is short, so pairs stay in a row."""
    pairs = F.expr("flatten(transform(concepts, (a, i) -> transform(slice(concepts, i + 2, size(concepts)), b -> named_struct('s', a, 'o', b))))")
    rows = concepts.where(F.size("concepts") >= 2).select("doc_name", "chunk_id", F.posexplode(pairs).alias("seq", "p"))
    return rows.select(F.col("p.s").alias("subject"), F.lit(COOCCURS).alias("predicate"), F.col("p.o").alias("object"), "chunk_id", "doc_name", F.lit(1).alias("kind"), "seq")


def triplet_table(*parts: DataFrame) -> DataFrame:
    """All triplets in one table; row_ord orders them by document, chunk, kind and place."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("row_ord", F.struct("doc_name", "chunk_id", "kind", "seq")).drop("kind", "seq")


def concept_count(triplets: DataFrame) -> DataFrame:
    """One row: number of distinct subjects and objects."""
    return triplets.select(F.explode(F.array("subject", "object")).alias("c")).agg(F.countDistinct("c").alias("n_concepts"))
