"""URL rules by a blocked Bloom filter in front of an exact join.

A rule is a host and a path prefix; it fits the host, its subdomains and every path that starts
with the prefix. Canonical rule keys (``host/path``) set bits in a filter of 512-bit blocks: one
hash picks the block, others the bits in it. A URL probes the keys of its host's suffixes and of
its path's prefixes of the listed lengths. Only URLs with a possible hit reach the exact join,
which drops the false positives. The filter is a table with a row per block, one block for each
``PER_BLOCK`` rules, joined to the probes by the number of the block; it is written once, so its size
is known and a small one is sent to all tasks. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BITS = 4
PER_BLOCK = 32
# The rules of the registered query, as (verdict, host, path prefix).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _bits(key: Column) -> list[Column]:
    """Positions 0 to 511 in the block, from hashes apart from the one that picks the block."""
    mixed = F.xxhash64(key, F.lit("bits"))
    return [F.pmod(F.shiftrightunsigned(mixed, 13 * i), F.lit(64 * WORDS)).cast("int") for i in range(BITS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """block and its ``WORDS`` words of 64 bits; blocks without a key are left out."""
    placed = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
    mask = F.expr("shiftleft(1L, bit % 64)")
    words = [F.coalesce(F.bit_or(F.when(F.expr("bit div 64") == w, mask)), F.lit(0).cast("long")) for w in range(WORDS)]
    return placed.groupBy("block").agg(F.array(*words).alias("words"))


def _may_contain(words: Column, key: Column) -> Column:
    found = F.lit(True)
    for bit in _bits(key):
        word = F.get(words, F.floor(bit / 64).cast("int"))
        found = found & (F.getbit(word, F.pmod(bit, F.lit(64))) == 1)
    return found


def possible(asked: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``asked`` whose ``key`` the filter of ``keys`` may contain."""
    bits = stored(bloom_filter(keys, blocks), "url-filter")
    met = asked.withColumn("block", _block(F.col("key"), blocks)).join(bits, "block")
    return met.where(_may_contain(F.col("words"), F.col("key"))).select(*asked.columns)


def probes(at: DataFrame, lengths: Column) -> DataFrame:
    """host, path, key: each suffix of the host with each prefix of the path of the listed lengths."""
    suffixes = at.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("_labels"))
    parts = suffixes.select(
        "host",
        "path",
        F.expr("substring_index(host, '.', -_labels)").alias("_suffix"),
        F.explode(lengths).alias("_n"),
    )
    return parts.where("_n <= length(path)").select(
        "host", "path", F.concat("_suffix", F.expr("substring(path, 1, _n)")).alias("key")
    )


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (``host`` + ``path`` of the longest that fits, or null), verdict.

    rules: verdict, host, path (starting with a slash). Of rules with one key, block wins. Where no
    rule fits, the filter has not listed the URL and the verdict is ``default``. Null URLs and URLs
    without ``://`` have an empty host and path. Repeated pages are rows of their own.
    """
    listed = (
        rules.where("verdict IN ('allow', 'block') AND host IS NOT NULL AND path IS NOT NULL")
        .groupBy(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"))
        .agg(F.max("verdict").alias("verdict"), F.length(F.first("path")).alias("length"))
    )
    listed = stored(listed, "url-rules")
    lengths = listed.agg(F.collect_set("length").alias("lengths")).scalar()
    blocks = 1 + listed.count() // PER_BLOCK
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = possible(probes(at.where("path <> ''"), lengths), listed.select("key"), blocks).distinct()
    # What the filter passes is judged once per distinct host and path and joined back.
    hits = (
        asked.join(listed, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("hit"))
    )
    return at.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


JUDGED_SQL = r"""
  WITH cut AS (
    SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  placed AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
  rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                          ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
  one AS (SELECT DISTINCT host, path FROM placed),
  hits AS (SELECT host, path, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) AS hit
           FROM one JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
           GROUP BY host, path)
  SELECT page_id, p.host, p.path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict
  FROM placed p LEFT JOIN hits h ON p.host = h.host AND p.path = h.path
"""
