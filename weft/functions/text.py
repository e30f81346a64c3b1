"""Text functions. Regular expressions carry (?U) where white space and word characters mean Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that is folded, one character for one.
FOLD_FROM, FOLD_TO = "\u2013\u2014\u2018\u2019\u201c\u201d\u00a0", "--''\"\" "

#: Characters that a concept loses at its ends, and that the parts of a triplet lose.
CONCEPT_EDGE, TRIPLET_EDGE = ".:;'\"-", ".:;'\""


def strip(c: Column) -> Column:
    """Without white space at either end; SQL's trim takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Typographic marks folded, control and astral characters, page numbers and surplus white space gone."""
    steps = [
        (r"[^\x09\x0A\x0D\x20-\x7E\u00A0-\uFFFF]", ""),
        (r"(?U)-\n(\S)", "$1"),
        (r"(?Umd)^\s*\d+\s*$", ""),
        (r"(?Umid)^page\s+\d+\s*(of\s+\d+)?\s*$", ""),
        (r"\n{3,}", "\n\n"),
    ]
    out = reduce(lambda t, s: F.regexp_replace(t, *s), steps, F.translate(c, FOLD_FROM, FOLD_TO))
    lines = F.transform(F.split(out, r"\r\n|[\n\r\u2028\u2029]", -1), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), " {2,}", " "))


def raw_sentences(c: Column) -> Column:
    """Pieces between white space that follows . ! ? and precedes A-Z, except after forms like U.S. and Dr."""
    return F.split(c, r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=[.!?])\s+(?=[A-Z])", -1)


def sentences(c: Column, longer_than: int = 10) -> Column:
    """Stripped sentences of more than ten characters; null text has none."""
    return F.coalesce(F.filter(F.transform(raw_sentences(c), strip), lambda s: F.char_length(s) > longer_than), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def edge_trim(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def parse_concepts(raw: Column) -> Column:
    """A model's comma-separated answer as distinct lower-case concepts, first mention first.

    Line feeds are commas; list numbers and bullets go; what is left has 2 to 60 characters and five words at most.
    """
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\n+", ", ")
    t = F.regexp_replace(t, r"(?U)(^|(?<=,))\s*\d+\.\s*", "")
    t = F.regexp_replace(t, r"(?U)(^|(?<=,))\s*[-*•]\s*", "")
    parts = F.transform(F.split(t, ","), lambda p: F.lower(edge_trim(strip(p), CONCEPT_EDGE)))
    return F.array_distinct(F.filter(parts, lambda p: F.char_length(p).between(2, 60) & (word_count(p) <= 5)))


def parse_triplet_lines(raw: Column) -> Column:
    """A model's lines subject | predicate | object as structs; other than three parts, empty or long ones go."""

    def parts(line: Column) -> Column:
        t = F.regexp_replace(strip(line), r"(?U)^\d+[.)]\s*", "")
        t = F.regexp_replace(t, r"(?U)^[-*•]\s*", "")
        return F.transform(F.split(t, r"\|", -1), lambda p: edge_trim(F.lower(strip(p)), TRIPLET_EDGE))

    good = F.filter(
        F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), parts),
        lambda p: (F.size(p) == 3) & F.forall(p, lambda x: (x != "") & (word_count(x) <= 8)),
    )
    return F.transform(good, lambda p: F.struct(p[0].alias("subject"), p[1].alias("predicate"), p[2].alias("object")))


def normalise_label(c: Column) -> Column:
    """Lower case, without quotes and mark-up, white space folded, without punctuation at the ends."""
    t = F.regexp_replace(strip(F.lower(c)), "[\"'`*_#@!?]", "")
    return F.btrim(F.regexp_replace(t, r"(?U)\s+", " "), F.lit(".,;:-()"))


def trigrams(c: Column) -> Column:
    """Distinct character trigrams of the label between two blanks on either side."""
    padded = F.concat(F.lit("  "), c, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) + 2), lambda i: F.substring(padded, i, F.lit(3))))


def inner_trigrams(c: Column) -> Column:
    return F.when(F.char_length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
