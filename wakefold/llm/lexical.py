"""Ranked search of many queries at once, with their common parts computed once.

A document's score for an item is a sum of integer weights over the item's terms, so any shared set
of terms has one partial sum per document that all items holding it can use. Shared sets are mined
from the items: terms stand in the order of how many items hold them, neighbours that meet in
two or more items become one node, and so on until no two items share neighbours. That gives a DAG
from terms over shared sets to items. Each task turns some documents into a matrix of term values,
fills the nodes from below, adds up the items, and keeps each item's best documents.

Documents are read once to find the terms of the items (a compact table of term numbers is kept) and
that table once to score. Items are taken in blocks of bounded size, one after the other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakefold.llm.store import in_tasks, stored
from wakefold.llm.terms import LETTERS_AND_DIGITS, Terms, text_bytes

FIRST = 50
BLOCK_TERMS = 1 << 18
_CELLS = 1 << 22
_FOUND = "doc_id long, n long, terms array<int>, times array<long>"
_BEST = "item int, doc_id long, score long"


class SharedSums:
    """Sums over sets of terms as a DAG in which a set that several items share is one node.

    ``items`` are the terms of each item as numbers from 0 to ``terms`` - 1. Nodes from ``terms`` on are
    pairs of nodes, in levels: a level only needs those before it.
    """

    def __init__(self, items: list[list[int]], terms: int):
        often = Counter(t for item in items for t in item)
        left = [sorted(item, key=lambda t: (-often[t], t)) for item in items]
        pairs: dict[tuple[int, int], int] = {}
        while True:
            met = Counter(p for seq in left for p in zip(seq, seq[1:], strict=False))
            if not any(n > 1 for n in met.values()):
                break
            left = [self._merged(seq, met, pairs, terms) for seq in left]
        self.terms = terms
        self._compact(left, {node: pair for pair, node in pairs.items()})

    @staticmethod
    def _merged(seq: list[int], met: Counter, pairs: dict, terms: int) -> list[int]:
        out, i = [], 0
        while i < len(seq):
            here = met[seq[i], seq[i + 1]] if i + 1 < len(seq) else 0
            after = met[seq[i + 1], seq[i + 2]] if i + 2 < len(seq) else 0
            if here > 1 and here >= after:
                out.append(pairs.setdefault((seq[i], seq[i + 1]), terms + len(pairs)))
                i += 2
            else:
                out.append(seq[i])
                i += 1
        return out

    def _compact(self, left: list[list[int]], parts: dict[int, tuple[int, int]]) -> None:
        """Opens nodes that only one place uses, numbers the others by level."""
        uses = Counter(x for seq in left for x in seq)
        for node in sorted(parts, reverse=True):
            if uses[node]:
                uses.update(parts[node])
        once = {x for x in parts if uses[x] == 1}

        def opened(x: int) -> list[int]:
            stack, flat = [x], []
            while stack:
                at = stack.pop()
                if at in once:
                    stack.extend(reversed(parts[at]))
                else:
                    flat.append(at)
            return flat

        content = {x: [y for part in parts[x] for y in opened(part)] for x in parts if uses[x] > 1}
        level: dict[int, int] = {}
        for x in sorted(content):
            level[x] = 1 + max(level.get(y, 0) for y in content[x])
        order = sorted(content, key=lambda x: (level[x], x))
        number = {x: self.terms + i for i, x in enumerate(order)}
        name = lambda x: number.get(x, x)
        self.levels = []
        for depth in range(1, 1 + max(level.values(), default=0)):
            nodes = [x for x in order if level[x] == depth]
            self.levels.append((number[nodes[0]], *self._lists([[name(y) for y in content[x]] for x in nodes])))
        self.filled = [i for i, seq in enumerate(left) if seq]
        self.items = self._lists([[name(y) for x in left[i] for y in opened(x)] for i in self.filled])
        self.nodes = self.terms + len(order)
        self.width = self.nodes + len(self.items[0])

    @staticmethod
    def _lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(x) for x in lists]
        return np.array([y for x in lists for y in x], np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)

    def additions(self) -> int:
        """Additions for one document."""
        return sum(len(members) - len(starts) for *_, members, starts in [*self.levels, self.items])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """One row per filled item from one row per term; columns are documents."""
        nodes = np.zeros((self.nodes, values.shape[1]), np.int64)
        nodes[: self.terms] = values
        for first, members, starts in self.levels:
            nodes[first : first + len(starts)] = np.add.reduceat(nodes[members], starts, axis=0)
        members, starts = self.items
        return np.add.reduceat(nodes[members], starts, axis=0)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = Terms(LETTERS_AND_DIGITS)
    for batch in batches:
        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for words in cut.lists(text):
                found = list(dict.fromkeys(words))
                yield pa.record_batch({"item_id": pa.array([item] * len(found), pa.int64()), "term": pa.array(found, pa.binary()).cast(pa.string())})


def _finder(vocabulary):
    """Number of terms and the known terms with their times of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = Terms(LETTERS_AND_DIGITS), vocabulary.value
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, times = 0, Counter()
                for words in cut.lists(text):
                    n += len(words)
                    for word, k in Counter(words).items():
                        if (t := known.get(word)) is not None:
                            times[t] += k
                if n:
                    rows.append((doc, n, list(times), list(times.values())))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
            yield pa.record_batch({k: pa.array(c, t) for (k, t), c in zip(kinds, columns, strict=True)})

    return run


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, first: int):
        self.first, self.least = first, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3
        self.parts, self.n = [], 0

    def add(self, sums: np.ndarray, ids: np.ndarray) -> None:
        item, place = np.nonzero(sums >= self.least[:, None])
        self.parts.append((item, ids[place], sums[item, place]))
        self.n += len(item)
        if self.n > 1 << 18:
            self.cut()

    def cut(self) -> None:
        item, doc, score = (np.concatenate([old, *new]) for old, new in zip(self.rows, zip(*self.parts, strict=True) if self.parts else [()] * 3, strict=True))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        starts = np.searchsorted(item, np.arange(len(self.least) + 1))
        keep = np.arange(len(item)) - starts[item] < self.first
        self.rows, self.parts, self.n = [item[keep], doc[keep], score[keep]], [], 0
        full = np.flatnonzero(np.diff(starts) >= self.first)
        self.least[full] = score[starts[full] + self.first - 1]


def _scorer(plan, documents: int, occurrences: int, first: int):
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, weights = plan.value
        best = _Best(len(shared.filled), first)
        step = max(1, _CELLS // max(1, shared.width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).fill_null(last).to_numpy(zero_copy_only=False)
                m = np.array([50 + 50 * n * documents // occurrences for n in part.column(1).to_pylist()], np.int64)
                lists = part.column(2)
                owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                terms, times = lists.flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy()
                values = np.zeros((shared.terms, len(ids)), np.int64)
                values[terms, owner] = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[owner]))
                best.add(shared.sums(values), ids)
        best.cut()
        item, doc, score = best.rows
        names = np.array(shared.filled, np.int32)[item]
        # A document without id is the last among equal scores.
        yield pa.record_batch({"item": pa.array(names, pa.int32()), "doc_id": pa.array(doc, pa.int64(), mask=doc == last), "score": pa.array(score, pa.int64())})

    return run


def ranked_documents(documents: DataFrame, items: DataFrame, first: int = FIRST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item.

    Rows that share an item_id are one item with all their terms; a null item_id is an item too.
    Null texts have no terms. Repeated documents are ranked each by itself, equal scores by id, those
    without id last. An item or a document without terms gives no rows, nor does an empty table.
    Only ids and texts are read. A block of items with about ``block_terms`` terms at most, and the
    document counts of those terms, are at the driver at a time.
    """
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))
    terms = stored(in_tasks(rows, _item_terms, "item_id long, term string").distinct(), "item-terms")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    blocks = 1 + terms.count() // block_terms
    ranked = None
    for block in range(blocks):
        own: dict[int | None, list[str]] = {}
        for row in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").toLocalIterator():
            own.setdefault(row.item_id, []).append(row.term)
        names = sorted({t for words in own.values() for t in words})
        number = {t.encode(): i for i, t in enumerate(names)}
        vocabulary = spark.sparkContext.broadcast(number)
        found = stored(in_tasks(texts, _finder(vocabulary), _FOUND), "item-terms-of-documents")
        n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = np.zeros(len(names), np.int64)
        for t, k in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            held[t] = k
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for k in held.tolist()], np.int64)
        shared = SharedSums([[number[t.encode()] for t in words] for words in own.values()], len(names))
        if not shared.filled or not n:
            vocabulary.unpersist()
            continue
        plan = spark.sparkContext.broadcast((shared, weights))
        part = in_tasks(found, _scorer(plan, n, total, first), _BEST)
        ids = spark.createDataFrame([(i, item) for i, item in enumerate(own)], "item int, item_id long")
        named = stored(_first(part, "item", first).join(ids, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        ranked = named if ranked is None else ranked.union(named)
        vocabulary.unpersist()
        plan.unpersist()
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if ranked is None else ranked


def _first(rows: DataFrame, key: str, first: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


RANKED_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
sizes AS (SELECT r, count(*) AS n FROM w GROUP BY r),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
    FROM tf, whole GROUP BY term),
scores AS (
    SELECT q.item_id, tf.r, tf.doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN sizes ON sizes.r = tf.r, whole GROUP BY ALL),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
           doc_id, score
    FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
