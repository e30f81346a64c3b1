"""URL filters: a blocked Bloom filter of listed canonical URLs, an exact hash join behind it, and host/path rules."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, ascii_lower, cut

#: Bits by key, bits set by key, and bits of a block. A block is four 64-bit words and so one cache line at most.
BITS_PER_KEY, WORDS = 16, 4
#: A filter of up to so many blocks is broadcast (40 bytes each as rows: 10 MB, four million keys); a larger one is
#: joined to the rows by block number.
BROADCAST_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one or if null."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://` or if null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host without a leading `www.` plus path without `/` at its end; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _words(key: Column) -> tuple[Column, list[Column]]:
    """The block's hash, and for each of its words a mask with one bit set."""
    h1, h2 = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    return h1, [_bit(F.shiftrightunsigned(h2, 6 * k).bitwiseAND(F.lit(63))) for k in range(WORDS)]


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def n_blocks(n_keys: int) -> int:
    """BITS_PER_KEY bits for each key, however many there are: the share of false hits is the same for any list."""
    return 1 << max(0, math.ceil(n_keys * BITS_PER_KEY / (64 * WORDS)) - 1).bit_length()


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (b, w0..w3): the blocked Bloom filter of a column, at most `blocks` rows."""
    h, bits = _words(F.col(key))
    rows = keys.where(F.col(key).isNotNull()).select(F.pmod(h, F.lit(blocks)).alias("b"), *[m.alias(f"m{k}") for k, m in enumerate(bits)])
    return rows.groupBy("b").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])


def probe(rows: DataFrame, key: Column, filter_: DataFrame, blocks: int) -> DataFrame:
    """(row, key, may): rows as a struct each, its key, and whether the filter lets it pass; it passes every listed one."""
    h, bits = _words(F.col("key"))
    packed = rows.select(F.struct(*[named(c) for c in rows.columns]).alias("row"), key.alias("key")).withColumn("block", F.pmod(h, F.lit(blocks)))
    probed = packed.join(F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_, F.col("block") == F.col("b"), "left")
    passes = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(m) != 0 for k, m in enumerate(bits)])
    return probed.select("row", "key", F.coalesce(passes, F.lit(False)).alias("may"))


def listed(rows: DataFrame, key: str, keys: DataFrame, keys_key: str, flag: str = "listed") -> DataFrame:
    """Adds a boolean column: is rows[key] among keys[keys_key]? Null keys are not. Other columns may have any names.

    The list is made distinct and cut once. Rows that the filter turns away never meet it; the rest do in a hash join,
    an outer one on both sides' own exchanges, so adaptive execution can split a URL that a third of all rows share.
    """
    names = cut(keys.select(F.col(keys_key).alias("name")).where(F.col("name").isNotNull()).distinct())
    blocks = n_blocks(names.count())
    probed = probe(rows, F.col(key), cut(bloom(names, "name", blocks)), blocks)
    hits = probed.where("may").join(names.withColumn("found", F.lit(True)), F.col("key") == F.col("name"), "left")
    both = hits.select("row", F.coalesce("found", F.lit(False)).alias("flag")).unionByName(probed.where("not may").select("row", F.lit(False).alias("flag")))
    return both.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], F.col("flag").alias(flag))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits: same host or a subdomain, path with the rule's as prefix.

    Returns struct(rule, verdict), null where none fits. Rules are a short parameter list, tried from the longest on;
    of two equally long ones the first by code point.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame, url: str = "url", blocked_url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict: a fitting rule's verdict, else block if the canonical URL is on the list.

    Null URLs and those without `://` have empty host and path, fit no rule and are allowed. Repeated rows are each
    judged; an empty list or table gives a result of the same columns. Columns of pages named host, path, rule or
    verdict are replaced, others stay, whatever their names.
    """
    own = pages.drop("host", "path", "rule", "verdict")
    rows = own.select(F.struct(*[named(c) for c in own.columns]).alias("page"), F.coalesce(host_of(named(url)), F.lit("")).alias("host"), F.coalesce(path_of(named(url)), F.lit("")).alias("path"))
    rows = rows.withColumn("canon", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    names = blocked.select(named(blocked_url).alias("u")).select(canonical(host_of(F.col("u")), path_of(F.col("u"))).alias("c")).where("c != ''")
    rows = listed(rows, "canon", names, "c", "on_list").withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("on_list"), "block").otherwise("allow"))
    return rows.select(*[F.col("page").getField(c).alias(c) for c in own.columns], "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
