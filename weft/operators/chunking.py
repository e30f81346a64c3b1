"""Overlapping chunks of sentences, as one fold over each document's word counts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, word_count

def span_lists(counts: Iterable[list[int]], size: int, overlap: int) -> list[list[tuple[int, int]]]:
    """Spans of 1-based first and last sentences for each list of word counts; a binary search in the prefix sums each."""
    out = []
    for w in counts:
        sums = np.concatenate([[0], np.cumsum(np.asarray(w, np.int64))])
        spans, at = [], 1
        while at <= len(w):
            end = max(at, int(np.searchsorted(sums, sums[at - 1] + size, "right")) - 1)
            spans.append((at, end))
            at += max(1, end - at + 1 - overlap)
        out.append(spans)
    return out


def sentence_rows(docs: DataFrame, key: str = "doc_name", text: str = "text") -> DataFrame:
    """(key, sent_idx from 0, sentence, n_words)."""
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("sent_idx", "sentence"))
    return rows.withColumn("n_words", word_count(F.col("sentence")))


def chunk_spans(docs: DataFrame, key: str = "doc_name", text: str = "text", size: int = 300, overlap: int = 2) -> DataFrame:
    """docs' key and text with sentences ss and word counts w, and spans sp of 1-based first and last sentences.

    Word counts are positive, so where a chunk ends depends on where it starts only: the last sentence whose prefix
    sum stays within size, one sentence at least. The next one starts max(1, sentences - overlap) later, also at the
    end of a document, which therefore ends in short chunks. No shuffle: a document is a row. A start depends on the
    chunk before, so the walk is a vectorised UDF over the word counts alone, linear in the sentences. Each step is
    exploded out of an array of one, which keeps the optimizer from copying it into the lambdas of the next.
    """
    own = docs.select(key, text, F.explode(F.array(sentences(F.col(text)))).alias("ss"))
    own = own.select(key, text, "ss", F.explode(F.array(F.transform("ss", word_count))).alias("w"))

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def spans(counts):
        return counts.__class__(span_lists(counts, size, overlap), dtype=object)

    return own.withColumn("sp", spans("w"))


def chunk_documents(docs: DataFrame, key: str = "doc_name", text: str = "text", size: int = 300, overlap: int = 2, drop_tail: bool = False) -> DataFrame:
    """(key, chunk_id from 0, text, word_count, char_start, char_end).

    Offsets are those of the first place where the first and the last sentence occur in the text. drop_tail leaves
    out chunks that end where the chunk before ended.
    """
    spans = chunk_spans(docs, key, text, size, overlap)
    if drop_tail:
        spans = spans.withColumn("sp", F.expr("filter(sp, (x, i) -> i = 0 OR x.e > sp[i - 1].e)"))
    rows = spans.select(key, F.col(text).alias("_t"), "ss", "w", F.posexplode("sp").alias("chunk_id", "x"))
    own = F.slice("ss", F.col("x.s"), F.col("x.e") - F.col("x.s") + 1)
    first, last = F.element_at("ss", F.col("x.s")), F.element_at("ss", F.col("x.e"))
    return rows.select(
        key,
        "chunk_id",
        F.array_join(own, " ").alias("text"),
        F.aggregate(F.slice("w", F.col("x.s"), F.col("x.e") - F.col("x.s") + 1), F.lit(0), lambda a, b: a + b).alias("word_count"),
        (F.instr("_t", first) - 1).alias("char_start"),
        (F.instr("_t", last) - 1 + F.char_length(last)).alias("char_end"),
    )
