"""How the sources of a language differ from each other and from the whole language.

Term counts of each (language, source) become smoothed shares in billionths, all in integers. Two
questions are answered: how far the shares of two sources lie apart in sum, and which terms a source
uses more than its language does.

The second is a top-k search without scoring every term. A term's excess grows with its count in the
source and falls with its count in the language, and equal excesses go by the term's bytes. So a term
is dominated by another of at least its source count, at most its language count and earlier bytes,
and a term that k others dominate is never among the first k. Each partition keeps its terms dominated
by fewer than k others (its skyband), the skybands are merged, and only the rest is ranked by exact
values.

The first takes terms in blocks: a block holds the counts of some terms in all sources of their
language, so sums of any number of terms are spread over tasks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.llm.store import in_tasks, stored
from wakefold.llm.terms import LETTERS, Terms, text_bytes

LEAST_DOCUMENTS = 30
FIRST = 50
SMOOTHING = 5
WHOLE = 1_000_000_000
BLOCK_TERMS = 4096
MERGE_BUCKETS = 16
_HELD = 400_000
_CELLS = 1 << 22
_COUNTS = "lang string, source string, term string, n long, held long"
_SKYBAND = "lang string, source string, term string, n long, lang_n long"
_APART = "lang string, source string, item string, part_sum long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a row without term for each group met."""
    terms, counts, held, entries = Terms(LETTERS), defaultdict(Counter), defaultdict(Counter), 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            documents, words = held[lang, source], list(found)
            for first in range(0, len(words) + 1, 1 << 16):
                part = words[first : first + (1 << 16)]
                own = [None] if first == 0 else []
                yield pa.record_batch(
                    {
                        "lang": pa.array([lang] * (len(part) + len(own)), pa.string()),
                        "source": pa.array([source] * (len(part) + len(own)), pa.string()),
                        "term": pa.array(own + part, pa.binary()).cast(pa.string()),
                        "n": pa.array([0] * len(own) + [found[w] for w in part], pa.int64()),
                        "held": pa.array([0] * len(own) + [documents[w] for w in part], pa.int64()),
                    }
                )

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, seen = counts[lang, source], set()
            before = len(found)
            for words in terms.lists(text):
                found.update(words)
                seen.update(words)
            held[lang, source].update(seen)
            entries += len(found) - before
            if entries >= _HELD:
                yield from rows()
                counts, held, entries = defaultdict(Counter), defaultdict(Counter), 0
    yield from rows()


def kept_counts(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n, first: the kept terms of a language with their counts.

    A row with a null term stands for each group itself. ``first`` marks one row per language and term.
    """
    rows = documents.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text_bytes().alias("text")
    )
    counts = in_tasks(rows, _count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    over = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("lang_n", F.sum("n").over(over))
        .withColumn("lang_held", F.sum("held").over(over))
        .withColumn("first", F.min("source").over(over) == F.col("source"))
        .where(F.col("term").isNull() | (F.col("lang_held") >= least))
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def _totals(kept: DataFrame) -> DataFrame:
    """One row per group: lang, source, whole (its denominator), lang_whole, v (kept terms of the language)."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    once = F.col("first") & F.col("term").isNotNull()
    langs = kept.groupBy("lang").agg(
        F.count_if(once).alias("v"), F.coalesce(F.sum(F.when(once, F.col("lang_n"))), F.lit(0)).alias("lang_total")
    )
    return groups.join(langs, "lang").select(
        "lang",
        "source",
        "v",
        (F.col("total") + SMOOTHING * F.col("v")).alias("whole"),
        (F.col("lang_total") + SMOOTHING * F.col("v")).alias("lang_whole"),
    )


def _share(count: Column | int, whole: str) -> Column:
    """1 + floor(WHOLE * (count + SMOOTHING) / whole), exact beyond 64 bits; null for a whole of 0."""
    top = F.lit(WHOLE).cast("decimal(10,0)") * ((F.lit(count) if isinstance(count, int) else count) + SMOOTHING).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, F.when(F.col(whole) > 0, F.col(whole)).cast("decimal(20,0)"))


def skyband(terms: list[bytes], n: np.ndarray, lang_n: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms dominated by fewer than k others.

    Terms are taken in order of their bytes, so only earlier ones can dominate. Dominance is transitive:
    a term with k dominators has k dominators inside the skyband, so the others need not be compared.
    """
    order = np.array(sorted(range(len(terms)), key=terms.__getitem__), np.int64)
    kept = np.zeros(0, np.int64)
    for first in range(0, len(order), 256):
        block = order[first : first + 256]
        mine, whole = n[block], lang_n[block]
        dominators = ((n[kept] >= mine[:, None]) & (lang_n[kept] <= whole[:, None])).sum(1)
        inside = (mine >= mine[:, None]) & (whole <= whole[:, None])
        dominators += np.tril(inside, -1).sum(1)
        kept = np.concatenate([kept, block[dominators < k]])
    return kept


def _skybands(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0

        def reduce() -> int:
            for group, rows in held.items():
                places = skyband([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), k)
                held[group] = [rows[i] for i in places]
            return sum(map(len, held.values()))

        def rows() -> Iterator[pa.RecordBatch]:
            flat = [(*group, *row) for group, some in held.items() for row in some]
            if flat:
                lang, source, term, count, whole = zip(*flat, strict=True)
                yield pa.record_batch(
                    {
                        "lang": pa.array(lang, pa.string()),
                        "source": pa.array(source, pa.string()),
                        "term": pa.array(term, pa.binary()).cast(pa.string()),
                        "n": pa.array(count, pa.int64()),
                        "lang_n": pa.array(whole, pa.int64()),
                    }
                )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for lang, source, term, count, whole in zip(*columns, strict=True):
                held[lang, source].append((term.encode(), count, whole))
            n += batch.num_rows
            if n >= _HELD:
                n = reduce()
                # A subset's skyband holds all that the whole one has of it, so it may go out early.
                if n >= _HELD // 2:
                    yield from rows()
                    held.clear()
                    n = 0
        reduce()
        yield from rows()

    return run


def overused_terms(kept: DataFrame, totals: DataFrame, first: int = FIRST) -> DataFrame:
    """lang, source, item, value, rank: the first terms by excess of the source's share over the language's."""
    rows = kept.where("term IS NOT NULL AND n > 0").select("lang", "source", "term", "n", "lang_n")
    partial = in_tasks(rows, _skybands(first), _SKYBAND)
    bucket = F.pmod(F.xxhash64("term"), F.lit(MERGE_BUCKETS))
    merged = in_tasks(partial.repartition("lang", "source", bucket), _skybands(first), _SKYBAND)
    p, q = _share(F.col("n"), "whole"), _share(F.col("lang_n"), "lang_whole")
    valued = merged.join(totals, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return valued.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of absolute share differences of all pairs of sources over one block of terms.

    A block's rows are neighbours: first each source of the language with its share of an absent
    term, then the present terms, equal terms side by side.
    """

    def sums(lang: str, sources: list[str], absent: np.ndarray, cells: list[tuple[int, int, int]], n: int):
        shares = np.tile(absent, (n, 1))
        if cells:
            at = np.array(cells, np.int64)
            shares[at[:, 0], at[:, 1]] = at[:, 2]
        for i in range(len(sources) - 1):
            total = np.abs(shares[:, i + 1 :] - shares[:, i : i + 1]).sum(0)
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * len(total), pa.string()),
                    "source": pa.array([sources[i]] * len(total), pa.string()),
                    "item": pa.array(sources[i + 1 :], pa.string()),
                    "part_sum": pa.array(total, pa.int64()),
                }
            )

    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (lang, _), block in groupby(rows, key=lambda r: r[:2]):
        place, absent, cells, last, n, usual = {}, [], [], None, 0, None
        for _, _, source, term, share in block:
            if term is None:
                place[source] = len(place)
                absent.append(share or 0)
                continue
            if usual is None:
                usual = np.array(absent, np.int64)
            if term != last:
                if n >= max(1, _CELLS // len(place)):
                    yield from sums(lang, list(place), usual, cells, n)
                    cells, n = [], 0
                last, n = term, n + 1
            cells.append((n - 1, place[source], share))
        yield from sums(lang, list(place), np.array(absent, np.int64), cells, n)


def distances(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: all other sources of the language by the sum of share differences."""
    here = kept.where("term IS NOT NULL").select("lang", "source", "term", "n").join(totals, ["lang", "source"])
    blocks = 1 + F.floor(F.col("v") / BLOCK_TERMS).cast("long")
    present = here.select(
        "lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", _share(F.col("n"), "whole").alias("share")
    )
    absent = totals.select(
        "lang",
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"),
        "source",
        F.lit(None).cast("string").alias("term"),
        _share(0, "whole").alias("share"),
    )
    dealt = present.union(absent).repartition("lang", "block").sortWithinPartitions("lang", "block", "term", "source")
    once = in_tasks(dealt, _apart, _APART).groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("value"))
    both = once.union(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return both.withColumn("rank", F.row_number().over(order))


def audited(documents: DataFrame, least: int = LEAST_DOCUMENTS, first: int = FIRST) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank from 1 within group and part.

    Null texts are empty; null languages and sources are ''. Repeated rows and ids are documents of
    their own. Equal values go by the item's bytes. A group without kept terms still takes part in
    pairs; where a language has none, all values are 0. An empty table gives no rows. Only lang, source
    and text are read.
    """
    kept = stored(kept_counts(documents, least), "kept-terms")
    totals = stored(_totals(kept), "group-totals")
    fields = ["lang", "source", "part", "item", "value", "rank"]
    pairs = distances(kept, totals).withColumn("part", F.lit("pair")).select(fields)
    return pairs.union(overused_terms(kept, totals, first).withColumn("part", F.lit("term")).select(fields))


AUDIT_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w GROUP BY ALL),
grid AS (
    SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, l.ln
    FROM g JOIN l ON g.lang = l.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
p AS (
    SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER x + 5 * count(*) OVER x) AS p,
           1 + (1000000000::HUGEINT * (ln + 5)) // (sum(ln) OVER x + 5 * count(*) OVER x) AS q
    FROM grid WINDOW x AS (PARTITION BY lang, source)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
