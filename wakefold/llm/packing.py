"""Packing of token pieces into sequences of a fixed size by exact complements, then best fit.

Only the number of pieces of each length matters, so the plan is made on a table of at most
``size`` rows, whatever the number of documents: a pattern of lengths and how often to use it. A
pattern starts with the longest length left. Its gap is filled exactly if one, two or three
lengths that are still there add up to it; if not, the longest length that fits goes in and the
gap is tried again. The pattern is then used as often as its lengths last. Pieces get a gapless
rank among those of equal length, and the plan tells the place of every rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.llm.encoding import encoder, vocabulary_path
from wakefold.llm.store import in_tasks, ranked, stored

SIZE = 4096
VOCABULARY = "word_bpe_49k.json"


class Stock:
    """Lengths that are left, indexed for sums of one, two and three of them.

    The index is a bit set of lengths and its mirror image: shifted against each other by a gap,
    their common bits are the lengths whose complement to the gap is there too.
    """

    def __init__(self, counts: np.ndarray):
        self.left = [int(n) for n in counts]
        self.size = len(self.left) - 1
        self.there = self.mirror = 0
        for length, n in enumerate(self.left):
            if n:
                self._flip(length)

    def _flip(self, length: int) -> None:
        self.there ^= 1 << length
        self.mirror ^= 1 << (self.size - length)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] == 0:
            self._flip(length)

    def longest(self, gap: int) -> list[int] | None:
        """The best fit: the longest length that is not over the gap."""
        fits = self.there & ((2 << gap) - 1)
        return [fits.bit_length() - 1] if fits else None

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] else None

    def pair(self, gap: int) -> list[int] | None:
        """Two lengths that fill the gap, the longer one as long as can be."""
        fits = self.there & (self.mirror >> (self.size - gap))
        if gap % 2 == 0 and self.left[gap // 2] == 1:
            fits &= ~(1 << (gap // 2))
        high = fits.bit_length() - 1
        return [high, gap - high] if high > 0 else None

    def triple(self, gap: int) -> list[int] | None:
        """Three lengths that fill the gap; the first is tried from the longest down."""
        fits = self.there & ((1 << max(0, gap - 1)) - 1)
        while fits:
            length = fits.bit_length() - 1
            if 3 * length < gap:  # no sum of three can reach it any more
                return None
            fits ^= 1 << length
            self.take(length, 1)
            rest = self.pair(gap - length)
            self.left[length] += 1
            if self.left[length] == 1:
                self._flip(length)
            if rest:
                return [length, *rest]
        return None


def plan_patterns(counts: np.ndarray, size: int) -> Iterator[tuple[dict[int, int], int]]:
    """(times each length is in the pattern, number of sequences of that pattern)."""
    stock = Stock(counts)
    while chosen := stock.longest(size):
        pattern: dict[int, int] = {}
        gap = size
        while chosen:
            for length in chosen:
                pattern[length] = pattern.get(length, 0) + 1
                stock.take(length, 1)
                gap -= length
            chosen = None
            if gap:
                chosen = stock.single(gap) or stock.pair(gap) or stock.triple(gap) or stock.longest(gap)
        more = min(stock.left[k] // m for k, m in pattern.items())
        if more:
            for k, m in pattern.items():
                stock.take(k, more * m)
        yield pattern, more + 1


def plan_table(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a sequence, first offset), sorted."""
    used = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for pattern, times in plan_patterns(counts, size):
        offset = 0
        for length, m in pattern.items():
            rows.append((length, used[length], sequence, m, offset))
            used[length] += m * times
            offset += m * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True).encode_all
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = []
                for doc_id, found in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(found, np.uint16(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), size)):
                        piece = ids[at : at + size]
                        out.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes())))
                columns = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = table[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            past = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def packed(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end_id``, so null and empty texts are one id long. Only longer
    documents are cut, into pieces of ``size``. Repeated rows, ids and null ids are documents of
    their own. An empty table gives no rows. Other columns are not read.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(
        in_tasks(texts, _cut(path, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"),
        "pieces",
    )
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        counts[row["length"]] = row["count"]
    plan = documents.sparkSession.sparkContext.broadcast(plan_table(counts, size))
    ranks = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    return in_tasks(
        ranks.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")),
        _place(plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
