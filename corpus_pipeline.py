"""A corpus pipeline of five training-data operators; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import cut, ship, table
from weft.llm.linededup import dedup_lines
from weft.llm.mixing import repeat_documents
from weft.llm.ngram_join import keep_one_of_each
from weft.llm.queries import tokenizer_path
from weft.llm.sentencepiece_codec import encode_documents
from weft.llm.textmodels import classify_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; one that scores 0.5 or more goes."""
    ship(spark)
    return classify_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, n_chars anew; one that loses all its lines to earlier documents goes."""
    ship(spark)
    out = dedup_lines(docs).where("n_kept > 0 or n_lines = 0")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group that is linked by 0.75 Jaccard on five-word shingles."""
    ship(spark)
    return keep_one_of_each(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: no row, one or two of each."""
    ship(spark)
    return repeat_documents(docs).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row."""
    ship(spark)
    return encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_dedup", ngram_dedup), ("mixing", mix), ("sentencepiece", sentencepiece)]

#: SQL cannot express the classifier, the edit-distance join and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage keeps is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
