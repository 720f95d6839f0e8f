"""Contiguous shards of near equal bytes, with groups of equal texts kept together.

Groups are ordered by the SHA-256 of their text and cut into consecutive shards so that the
largest shard is as small as it can be: the capacity is found by binary search, each guess checked
by filling shards greedily. The driver sees sums over ranges of that order, never the groups: it
starts with the ranges of the first hex digits, and only ranges into which a cut can fall for a
capacity still possible are asked for in finer pieces, until the cuts lie between groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import ranked, stored

SHARDS = 8
DIGITS = 3
HEX = 64


Range = tuple[str, int, int]


def fill(ranges: list[Range], sums: list[int], most: int, shards: int, fluid: bool) -> list[tuple[int, int]] | None:
    """Greedy check of a capacity: (range, byte offset) of each cut, null if there are too many shards.

    A range of one group is never parted. A range of several groups is parted at any byte if
    ``fluid``, which may only ask for too little, and not at all otherwise, which may ask for too much.
    """
    cuts: list[tuple[int, int]] = []
    base = 0
    while True:
        at = bisect_right(sums, base + most)
        if at == len(sums):
            return cuts
        before = sums[at - 1] if at else 0
        end = base + most if fluid and ranges[at][2] > 1 else before
        if end <= base or len(cuts) == shards - 1:
            return None
        cuts.append((at, end))
        base = end


def least_capacity(ranges: list[Range], sums: list[int], shards: int, fluid: bool) -> int:
    """The smallest capacity with which the ordered ranges fit the shards."""
    low, high = 1, sums[-1]
    while low < high:
        middle = (low + high) // 2
        if fill(ranges, sums, middle, shards, fluid) is None:
            low = middle + 1
        else:
            high = middle
    return low


def open_ranges(ranges: list[Range], sums: list[int], low: int, high: int, shards: int) -> set[int]:
    """Ranges of several groups in which a greedy cut may lie for a capacity from low to high."""
    found: set[int] = set()
    first = last = 0
    for _ in range(shards - 1):
        a, b = bisect_right(sums, first + low), bisect_right(sums, last + high)
        found.update(i for i in range(a, min(b, len(sums) - 1) + 1) if ranges[i][2] > 1)
        if a == len(sums):
            break
        # At the earliest the shard ends where its last range begins, at the latest it is full.
        first, last = (sums[a - 1] if a else 0), last + high
    return found


def find_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Keys (hex prefixes) at which a new shard begins, ascending; at most shards - 1."""
    depth = DIGITS
    ranges = _ranges(groups, depth)
    while ranges:
        sums = list(accumulate(r[1] for r in ranges))
        low = least_capacity(ranges, sums, shards, True)
        high = least_capacity(ranges, sums, shards, False)
        opened = open_ranges(ranges, sums, low, high, shards)
        if not opened or depth >= HEX:
            return [ranges[at][0] for at, _ in fill(ranges, sums, high, shards, False)]
        depth = min(HEX, depth + DIGITS)
        finer = _ranges(groups.where(_under([ranges[i][0] for i in opened])), depth)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in opened] + finer)
    return []


def _under(prefixes: list[str]) -> Column:
    by_length: dict[int, list[str]] = {}
    for p in prefixes:
        by_length.setdefault(len(p), []).append(p)
    condition = F.lit(False)
    for n, values in by_length.items():
        condition = condition | F.substring("key", 1, n).isin(values)
    return condition


def _ranges(groups: DataFrame, depth: int) -> list[Range]:
    """(prefix, bytes, groups) of the ranges of the first ``depth`` hex digits, in order."""
    rows = (
        groups.groupBy(F.substring("key", 1, depth).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return sorted((r.prefix, r["size"], r.n) for r in rows)


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 1. Null texts have size 1 and crc32 0 and are a group with
    the empty text. Every group of equal texts is in one shard, so a group larger than a fair share
    sets the capacity. Shards of an empty tail may stay empty. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        ),
        "sized",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = find_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    placed = ranked(rows.withColumn("shard", shard), ["shard"], ["doc_id", "key"], "slot", buckets=512)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
