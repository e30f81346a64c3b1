"""Documents from folders, triplet tables as CSV or Parquet, pages as HTML."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TRIPLETS
from ..functions.text import clean_text, strip


def decode(content: Column) -> Column:
    """UTF-8, or ISO-8859-1 for a whole file that is not UTF-8; line ends become line feeds."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("doc_name", F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B")))


def pdf_pages(files: DataFrame, strict: bool) -> DataFrame:
    """(doc_name, text) of PDF files: page texts joined by blank lines. Needs the optional pypdf.

    Encrypted files are tried with an empty password, pages that fail are left out, and a file without any text is an
    error if strict, else left out.
    """
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e

    def run(frames: Iterator) -> Iterator:
        import io

        import pandas as pd
        from pypdf import PdfReader

        for frame in frames:
            out = []
            for name, content in zip(frame["doc_name"], frame["content"], strict=True):
                pages = []
                try:
                    reader = PdfReader(io.BytesIO(content))
                    if reader.is_encrypted:
                        reader.decrypt("")
                    for page in reader.pages:
                        try:
                            pages.append(page.extract_text() or "")
                        except Exception:  # noqa: BLE001  a page that cannot be read is left out
                            continue
                except Exception:
                    if strict:
                        raise
                text = "\n\n".join(p for p in pages if p.strip())
                if text:
                    out.append((name, text))
                elif strict:
                    raise ValueError(f"{name} has no text")
            yield pd.DataFrame(out, columns=["doc_name", "text"])

    return files.select("doc_name", "content").mapInPandas(run, "doc_name string, text string")


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_name, text) of the .txt and .pdf files right in a folder, cleaned; blank files are left out."""
    read = lambda glob: _named(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder))
    plain = read("*.[tT][xX][tT]").select("doc_name", decode(F.col("content")).alias("text"))
    pdf = read("*.[pP][dD][fF]")
    if pdf.select("doc_name").limit(1).count():
        plain = plain.unionByName(pdf_pages(pdf, strict=False))
    return plain.where(strip(F.col("text")) != "").withColumn("text", clean_text(F.col("text")))


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One file by name; any suffix but .pdf is text. A missing file is an error."""
    files = _named(spark.read.format("binaryFile").load(path))
    if path.lower().endswith(".pdf"):
        return pdf_pages(files, strict=True).withColumn("text", clean_text(F.col("text")))
    return files.select("doc_name", clean_text(decode(F.col("content"))).alias("text"))


def write_triplets(triplets: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, or Parquet (kind="parquet"); what is there is replaced."""
    out = triplets.select("subject", "predicate", "object", "chunk_id", "doc_name").write.mode("overwrite")
    out.parquet(path) if kind == "parquet" else out.csv(path, header=True, escape='"')


def read_triplets(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Triplets by an explicit schema, with a row order from their own columns (never from the place in the file)."""
    read = spark.read.schema(TRIPLETS)
    got = read.parquet(path) if kind == "parquet" else read.option("header", True).option("escape", '"').csv(path)
    kind_ = (F.col("predicate") == "co-occurs with").cast("int")
    return got.withColumn("row_ord", F.struct("doc_name", "chunk_id", kind_.alias("kind"), "subject", "object", "predicate"))


def write_html(page: str, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path
