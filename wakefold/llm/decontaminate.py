"""Benchmark decontamination by greedy string tiling.

Benchmark items are read in blocks of bounded size. The hashes of all runs of ``least`` tokens of a
block go to every task; a document that shares one is tiled against the item it came from: the
longest unmarked common run is marked in both, again and again, until none of ``least`` tokens is
left. Runs are met by rolling hashes of falling length and confirmed token by token. Tiles may lie
in any order, so reordered passages count. A document is contaminated when its tiles cover enough
of an item. An item of fewer tokens than ``least`` is met by its whole sequence only.

Memory is linear in the item and the document, also where one token is repeated all over both.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import document_key, in_tasks, stored
from wakefold.llm.textcore import IS_PUNCTUATION, LOWER, Slice, gram_hashes, prefix_hashes, range_hashes, slices

BLOCK_BYTES = 16 << 20
_SCHEMA = "k1 long, k2 long, item_id long, tiled long, item_tokens long, n_tiles long"

# Scripts written without blanks (first and last code point); each character is a token.
UNSPACED = [
    (0x0E00, 0x0EFF),  # Thai, Lao
    (0x1000, 0x109F),  # Myanmar
    (0x1780, 0x17FF),  # Khmer
    (0x3005, 0x3007),  # ideographic marks
    (0x3040, 0x30FF),  # kana
    (0x31F0, 0x31FF),  # small kana
    (0x3400, 0x4DBF),  # ideographs
    (0x4E00, 0x9FFF),  # ideographs
    (0xF900, 0xFAFF),  # ideographs
    (0xFF66, 0xFF9F),  # narrow kana
    (0x20000, 0x3FFFF),  # ideographs
]
_APART, _ALONE = 1, 2


@cache
def _kinds() -> np.ndarray:
    """Per code point: 0 for a character of a word, or whether it parts words or is a word alone."""
    kinds = np.fromiter(
        (unicodedata.category(chr(c))[0] in "PSZC" for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1
    )
    kinds[:128] = IS_PUNCTUATION[:128]
    for first, last in UNSPACED:
        part = kinds[first : last + 1]
        part[part == 0] = _ALONE
    return kinds


def _byte_kinds(data: np.ndarray) -> np.ndarray:
    """Kind of the character each byte of UTF-8 text belongs to."""
    kinds = IS_PUNCTUATION[data].astype(np.uint8)
    if not (data >= 128).any():
        return kinds
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    at = np.flatnonzero((data & 0xC0) == 0xC0)
    lead = data[at]
    more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    code = lead & (0x3F >> more)
    for k in range(1, 4):
        code = np.where(more >= k, code << 6 | (padded[at + k] & 0x3F), code)
    kind = _kinds()[np.minimum(code, sys.maxunicode)]
    kinds[at] = kind
    for k in range(1, 4):
        rest = (more >= k) & ((padded[at + k] & 0xC0) == 0x80)
        kinds[at[rest] + k] = kind[rest]
    return kinds


class Tokens:
    """Tokens of a slice: the text each belongs to, a 64-bit hash, bounds per text.

    A token is a run of letters, marks and digits, A-Z in lower case, or one character of a script
    that is written without blanks.
    """

    def __init__(self, piece: Slice):
        data = LOWER[piece.data]
        kinds = _byte_kinds(data)
        inside = kinds != _APART
        heads = (data & 0xC0) != 0x80
        first = np.zeros(len(data) + 1, bool)
        first[piece.starts] = True
        alone = kinds == _ALONE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1] | (heads[1:] & (alone[1:] | alone[:-1]))
        begin = np.flatnonzero(begins)
        stops = np.ones(len(data) + 1, bool)
        stops[:-1] = begins | ~inside | first[:-1]
        places = np.flatnonzero(stops)
        end = places[np.searchsorted(places, begin, "right")] if len(begin) else begin
        self.doc = np.searchsorted(piece.starts, begin, "right") - 1
        self.hash = range_hashes(prefix_hashes(data), begin, end)
        #: bounds[i], bounds[i + 1]: the tokens of text i
        self.bounds = np.searchsorted(self.doc, np.arange(len(piece) + 1))


def _near(tokens: np.ndarray, seeds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens in runs with a seed's hash and one place after each stretch; which tokens are in such runs."""
    edge = np.zeros(len(tokens) + 1, np.int64)
    hit = np.flatnonzero(np.isin(gram_hashes(tokens, least), seeds))
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + least, -1)
    covered = np.cumsum(edge)[:-1] > 0
    after = covered.copy()
    after[1:] |= covered[:-1]
    return np.flatnonzero(after), covered


def tiles(item: np.ndarray, document: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in document, length) of the greedy tiling, in the order of marking.

    Of equally long runs the one first in the item, then first in the document, is marked first.
    """
    if len(item) < least or len(document) < least or least < 1:
        return []
    # Document tokens outside all shared seeds cannot be in a tile; one stays between stretches, marked.
    place, covered = _near(document, np.unique(gram_hashes(item, least)), least)
    if not len(place):
        return []
    text, free_text, free_item = document[place], covered[place], np.ones(len(item), bool)
    sums_item, sums_text = prefix_hashes(item), prefix_hashes(text)

    def windows(free: np.ndarray, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked runs of a length, and their hashes."""
        marked = np.concatenate([[0], np.cumsum(~free)])
        starts = np.flatnonzero(marked[length:] == marked[:-length])
        return starts, range_hashes(sums, starts, starts + length)

    def shared(length: int) -> bool:
        return bool(np.isin(windows(free_item, sums_item, length)[1], windows(free_text, sums_text, length)[1]).any())

    found = []
    most = min(len(item), len(text))
    while most >= least:
        # If a run of some length is shared, so is one of every smaller length.
        low, high = least - 1, most
        if shared(high):
            low = high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if shared(middle) else (low, middle)
        length = low
        if length < least:
            break
        starts, hashes = windows(free_item, sums_item, length)
        places, others = windows(free_text, sums_text, length)
        order = np.argsort(others, kind="stable")
        others, places = others[order], places[order]
        for i, h in zip(starts.tolist(), hashes, strict=True):
            if not free_item[i : i + length].all():
                continue
            at, upto = np.searchsorted(others, h, "left"), np.searchsorted(others, h, "right")
            while at < upto:
                j = int(places[at])
                taken = np.flatnonzero(~free_text[j : j + length])
                if len(taken):
                    at += np.searchsorted(places[at:upto], j + taken[-1] + 1)
                elif (item[i : i + length] == text[j : j + length]).all():
                    free_item[i : i + length] = False
                    free_text[j : j + length] = False
                    found.append((i, int(place[j]), length))
                    break
                else:
                    at += 1
        most = length - 1
    return found


class _Block:
    """Items of one block: token hashes and, per seed length, the items behind each seed hash."""

    def __init__(self, ids: list, texts: list, least: int):
        self.items: list[tuple[int, np.ndarray]] = []
        hashes: dict[int, list] = {}
        owners: dict[int, list] = {}
        for piece in slices(pa.array(texts, pa.string())):
            words = Tokens(piece)
            for i in range(len(piece)):
                tokens = words.hash[words.bounds[i] : words.bounds[i + 1]]
                n = min(least, len(tokens))
                if n:
                    seeds = np.unique(gram_hashes(tokens, n))
                    hashes.setdefault(n, []).append(seeds)
                    owners.setdefault(n, []).append(np.full(len(seeds), len(self.items)))
                self.items.append((ids[piece.first + i], tokens))
        self.seeds = {}
        for n, parts in sorted(hashes.items()):
            joined = np.concatenate(parts)
            order = np.argsort(joined, kind="stable")
            self.seeds[n] = joined[order], np.concatenate(owners[n])[order]


def _tiler(shared, least: int):
    def met(block: _Block, words: Tokens) -> Iterator[tuple[int, int]]:
        """(text, item) where both hold a seed."""
        for n, (hashes, owners) in block.seeds.items():
            grams = gram_hashes(words.hash, n)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            inside = words.doc[: len(grams)] == words.doc[n - 1 :]
            hit = np.flatnonzero((hashes[at] == grams) & inside)
            # Each seed once per text, however often the text repeats it.
            once = np.unique(np.stack([words.doc[hit], at[hit]]), axis=1)
            last = np.searchsorted(hashes, hashes[once[1]], "right")
            for doc, begin, end in zip(*once.tolist(), last.tolist(), strict=True):
                yield from ((doc, owner) for owner in owners[begin:end].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for piece in slices(batch.column(2)):
                words = Tokens(piece)
                out = []
                for doc, owner in sorted(set(met(block, words))):
                    item_id, tokens = block.items[owner]
                    document = words.hash[words.bounds[doc] : words.bounds[doc + 1]]
                    found = tiles(tokens, document, min(least, len(tokens)))
                    row = piece.first + doc
                    k1, k2 = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                    out.append((k1, k2, item_id, sum(t[2] for t in found), len(tokens), len(found)))
                if out:
                    names = ["k1", "k2", "item_id", "tiled", "item_tokens", "n_tiles"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names
                    )

    return run


def tiled_items(documents: DataFrame, benchmark: DataFrame, least: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document (k1, k2 of ``document_key``) and item that share a run of tokens.

    Tokens are those of ``Tokens``, so case and punctuation do not count. Items of fewer than ``least``
    tokens must occur as a whole; items without tokens and null texts match nothing. Of several blocks
    of items one at a time is at the driver and in the tasks: its result is stored before the next.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // block_bytes
    texts = documents.select(*document_key(), "text")
    parts = []
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        shared = spark.sparkContext.broadcast(_Block([r.item_id for r in rows], [r.text for r in rows], least))
        part = in_tasks(texts, _tiler(shared, least), _SCHEMA)
        if blocks > 1:
            part = stored(part, "tiled-items")
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.union, parts)


def contamination(documents: DataFrame, benchmark: DataFrame, least: int = 5, percent: int = 50) -> DataFrame:
    """k1, k2, item_id, covered (share of the item's tokens), n_tiles of each contaminated document."""
    covered = F.col("tiled") / F.col("item_tokens")
    return (
        tiled_items(documents, benchmark, least)
        .where(F.col("tiled") * 100 >= F.col("item_tokens") * percent)
        .groupBy("k1", "k2")
        .agg(F.max(F.struct(covered.alias("covered"), F.negative("item_id").alias("i"), "n_tiles")).alias("top"))
        .select("k1", "k2", F.negative("top.i").alias("item_id"), "top.covered", "top.n_tiles")
    )


def judged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, item_id (best covered, least on ties), covered, n_tiles, contaminated."""
    base = documents.select("doc_id", *document_key())
    found = contamination(documents, benchmark)
    return base.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "item_id",
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
        F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"),
        F.col("covered").isNotNull().alias("contaminated"),
    )


def without_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; all columns stay."""
    names = [f"`{n}`" for n in documents.columns]
    keys = [c.alias(f"_{n}") for n, c in zip(("k1", "k2"), document_key(), strict=True)]
    found = contamination(documents, benchmark).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return documents.select("*", *keys).join(found, ["_k1", "_k2"], "left_anti").select(*names)
