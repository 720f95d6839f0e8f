"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

Only suffixes that can have a repeat are sorted. Every run of ``length`` bytes owns an anchor: the
seed of ``SEED`` bytes in it with the least hash. Equal runs own equal anchors at equal offsets, so
a run can be repeated only where its anchor's hash occurs again. Those anchors, with the bytes
around that their runs cover, are dealt by hash. Within a hash the suffixes at the anchor are
sorted: multikey quicksort to a shallow depth, then a blind trie for each group still tied. The
common prefixes of neighbours give the nested groups that share the bytes to the right of the
anchor; sorting the reversed bytes to its left inside such a group tells which runs are repeated.

Equal contexts are merged before the shuffle and counted, so copies of a document or the inside of
a common passage cost one row per task. The edge of a passage that very many documents share has as
many contexts as documents: such an anchor is split by the offsets of its runs, each share dealt by
the bytes that all its runs hold and without the bytes that none of them reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import document_key, in_tasks, stored
from wakefold.llm.textcore import U64, Slice, grouped, prefix_hashes, range_hashes, slices

SEED = 48
SHALLOW = 72
PIECE = 8 << 20
STEP = 8  # offsets that share a task where an anchor is split
HOT = 20_000  # places from which on an anchor is split
MERGED = 20_000  # distinct contexts a task holds before it passes them on
SAME = 4_096  # places of one context that travel in a row
_LOW = U64((1 << 24) - 1)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def multikey_groups(strings: list[bytes], depth: int, shallow: int) -> Iterator[list[int]]:
    """Indices in sorted order, as groups that are equal up to the shallow depth."""
    stack = [(list(range(len(strings))), depth)]
    while stack:
        items, at = stack.pop()
        if len(items) == 1 or at >= shallow or at > max(len(strings[i]) for i in items):
            yield items
            continue
        pivot = _byte(strings[items[len(items) // 2]], at)
        parts: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i in items:
            c = _byte(strings[i], at)
            parts[1 + (c > pivot) - (c < pivot)].append(i)
        for part, next_at in ((parts[2], at), (parts[1], at + 1), (parts[0], at)):
            if part:
                stack.append((part, next_at))


class BlindTrie:
    """A trie that holds branching depths only; the skipped bytes are checked once at the leaf."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list | int = first

    def add(self, new: int) -> None:
        s = self.strings[new]
        node = self.root
        while not isinstance(node, int):
            node = node[1].get(_byte(s, node[0])) or next(iter(node[1].values()))
            if isinstance(node, tuple):
                node = node[0]
        other = self.strings[node]
        depth = common_prefix(s, other)
        here, above, edge = self.root, None, None
        while not isinstance(here, int) and here[0] < depth:
            edge, above = _byte(s, here[0]), here
            here = here[1][edge]
            if isinstance(here, tuple):
                here = here[0]
        if depth == len(s) == len(other) or (not isinstance(here, int) and here[0] == depth):
            if isinstance(here, int):
                here = self._branch(above, edge, [depth, {_byte(other, depth): (here,)}])
            key = _byte(s, depth)
            # Equal strings end at one branch; each copy gets an edge of its own below the ends.
            while key < 0 and key in here[1]:
                key -= 1
            here[1][key] = (new,)
            return
        self._branch(above, edge, [depth, {_byte(other, depth): (here,), _byte(s, depth): (new,)}])

    def _branch(self, above: list | None, edge: int | None, node: list) -> list:
        if above is None:
            self.root = node
        else:
            above[1][edge] = (node,)
        return node

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(index, common prefix with the one before) in order; the first prefix is -1."""
        stack: list[tuple] = [(self.root, -1)]
        while stack:
            node, common = stack.pop()
            if isinstance(node, int):
                yield node, common
                continue
            kids = sorted(node[1].items(), key=lambda kv: (kv[0] >= 0, kv[0]))
            for at in range(len(kids) - 1, -1, -1):
                stack.append((kids[at][1][0], node[0] if at else common))


def deep_shallow_sort(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Sorted order of the strings, and the common prefix of each with the one before it."""
    order: list[int] = []
    common: list[int] = []
    for group in multikey_groups(strings, depth, shallow):
        if len(group) == 1:
            found = [(group[0], -1)]
        else:
            trie = BlindTrie(strings, group[0])
            for i in group[1:]:
                trie.add(i)
            found = list(trie.ordered())
        for i, with_last in found:
            if with_last < 0:
                with_last = common_prefix(strings[order[-1]], strings[i]) if order else 0
            order.append(i)
            common.append(with_last)
    return order, common


def nested_groups(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last + 1) of all runs of neighbours that share at least ``least`` bytes."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        value = common[i] if i < len(common) else -1
        first = i - 1
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def repeated_offsets(members: list[tuple[bytes, bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """Which runs of each context occur again in the group.

    A member is (bytes left of the anchor, reversed; bytes from the anchor on; copies). A run at
    offset o starts o bytes left of the anchor. Returns inclusive ranges of offsets per member.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in members]
    for i, (left, right, copies) in enumerate(members):
        if copies > 1 and len(left) >= length - len(right):
            found[i].append((max(0, length - len(right)), len(left)))
    if len(members) == 2:
        (l1, r1, _), (l2, r2, _) = members
        low, high = length - common_prefix(r1, r2), common_prefix(l1, l2)
        if low <= high:
            found[0].append((max(0, low), high))
            found[1].append((max(0, low), high))
        return found
    if len(members) < 2:
        return found
    rights = [m[1] for m in members]
    same = len({r[:SEED] for r in rights}) == 1 and len(rights[0]) >= SEED
    order, common = deep_shallow_sort(rights, SEED if same else 0)
    lefts = [m[0] for m in members]
    by_left, shared = deep_shallow_sort(lefts)
    neighbours = _Neighbours(by_left, shared)
    for depth, first, last in nested_groups(common, length - max(map(len, lefts))):
        neighbours.add(order[first:last], max(0, length - depth))
    for member, ranges in enumerate(neighbours.ranges()):
        found[member].extend(ranges)
    return found


class _Neighbours:
    """Longest common prefixes to the left inside nested groups, from one sorted order of all lefts.

    A group's members are brought into that order by their ranks. The prefix of two ranks is the least
    one between them, read from minima over spans of powers of two. Groups come inner first, so a member's
    offsets only grow and are kept as its last range.
    """

    def __init__(self, by_left: list[int], shared: list[int]):
        self.by_left = np.array(by_left)
        self.rank = np.empty(len(by_left), np.int64)
        self.rank[self.by_left] = np.arange(len(by_left))
        self.least = [np.array(shared)]
        while 2 << len(self.least) - 1 <= len(shared):
            last, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[:-half], last[half:]))
        self.low = np.full(len(by_left), -1)
        self.high = np.full(len(by_left), -2)
        self.closed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _prefixes(self, ranks: np.ndarray) -> np.ndarray:
        first, last = ranks[:-1] + 1, ranks[1:]
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][first[at]], self.least[k][last[at] - (1 << int(k)) + 1])
        return out

    def add(self, group: list[int], low: int) -> None:
        """Offsets from ``low`` to each member's best prefix with another member of the group."""
        ranks = np.sort(self.rank[group])
        shared = self._prefixes(ranks)
        best = np.zeros(len(ranks), np.int64)
        best[:-1] = shared
        best[1:] = np.maximum(best[1:], shared)
        hit = best >= low
        who, best = self.by_left[ranks[hit]], best[hit]
        apart = low > self.high[who] + 1
        done = who[apart & (self.low[who] >= 0)]
        if len(done):
            self.closed.append((done, self.low[done], self.high[done]))
        self.low[who[apart]] = low
        self.high[who] = np.maximum(self.high[who], best)

    def ranges(self) -> list[list[tuple[int, int]]]:
        found: list[list[tuple[int, int]]] = [[] for _ in self.rank]
        ends = np.flatnonzero(self.low >= 0)
        for who, low, high in (*self.closed, (ends, self.low[ends], self.high[ends])):
            for member, *span in zip(who.tolist(), low.tolist(), high.tolist(), strict=True):
                found[member].append(tuple(span))
        return found


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by least values before and after block edges."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    blocks[:n] = values
    table = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(piece: Slice, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of a slice: text index, place in the slice, first and last run start, hash."""
    n = len(piece.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    prefix = prefix_hashes(piece.data)
    begin = np.arange(n - SEED + 1)
    seeds = range_hashes(prefix, begin, begin + SEED)
    packed = (seeds & ~_LOW) | begin.astype(U64)
    least = (_sliding_least(packed, length - SEED + 1) & _LOW).astype(np.int64)
    valid = np.ones(n + 1, bool)
    for end in piece.ends:
        valid[max(0, end - length + 1) : end] = False
    valid = valid[: len(least)]
    opens, closes = valid.copy(), valid.copy()
    changed = least[1:] != least[:-1]
    opens[1:] &= ~valid[:-1] | changed
    closes[:-1] &= ~valid[1:] | changed
    low, high = np.flatnonzero(opens), np.flatnonzero(closes)
    at = least[low]
    doc = np.searchsorted(piece.starts, low, "right") - 1
    return doc, at, low, high, seeds[at].view(np.int64)


def _pieces(column, length: int) -> Iterator[tuple[int, int, Slice]]:
    """(first text, byte offset in it, slice) with long texts cut into overlapping pieces."""
    for piece in slices(column):
        if len(piece.data) <= PIECE:
            yield piece.first, 0, piece
            continue
        for at in range(0, max(1, len(piece.data) - length + 1), PIECE):
            part = piece.data[at : at + PIECE + length - 1]
            yield piece.first, at, Slice(part, np.array([0]), np.array([len(part)]), piece.first)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, offset, piece in _pieces(batch.column(1), length):
                doc, at, low, high, hashes = anchors(piece, length)
                if not len(doc):
                    continue
                base = piece.starts[doc] - offset
                rows = doc + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[rows]),
                        pa.array((at - base) << 16 | (at - low) << 8 | (high - low)),
                        pa.array(hashes),
                    ],
                    names=["key", "place", "hash"],
                )

    return run


def _shares(key: int, left: int, context: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """The context cut for runs of ``STEP`` neighbouring offsets at a time, each share with a hash of its own.

    Runs at offsets a to b all hold the a bytes left of the anchor and the ``length`` - b bytes from it on, so
    only contexts equal there can repeat them; bytes that none of these runs reach are left out.
    """
    right = len(context) - left
    for a in range(0, length - SEED + 1, STEP):
        b = min(a + STEP - 1, length - SEED)
        if a <= left and b >= length - right:
            common = context[left - a : left + length - b]
            digest = blake2b(common, digest_size=8, salt=a.to_bytes(4, "little"), key=key.to_bytes(8, "little", signed=True))
            kept = min(left, b)
            yield (
                int.from_bytes(digest.digest(), "little", signed=True),
                kept,
                context[left - kept : left + min(right, length - a)],
            )


def _contexts(length: int, wide: bool):
    """Contexts of the listed anchors, merged: with their bytes, or with the places that hold them."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py() or b""
            for place in batch.column(3)[i].as_py():
                at, left = place["place"] >> 16, place["place"] >> 8 & 255
                begin = at - left
                context = text[begin : begin + (place["place"] & 255) + length]
                whole = [(place["hash"], left, context)]
                for key, kept, part in _shares(*whole[0], length) if place["hot"] else whole:
                    digest = blake2b(part, digest_size=16, salt=kept.to_bytes(4, "little")).digest()
                    yield i, at, key, digest, kept, part

    def counted(merged: dict[tuple, list]) -> pa.RecordBatch:
        columns = [(h, d, *v) for (h, d), v in merged.items()]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        return _batch(columns, ["hash", "digest", "left", "context", "copies"], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[tuple, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                if wide:
                    for _, _, h, digest, left, context in rows(part):
                        merged.setdefault((h, digest), [left, context, 0])[2] += 1
                        if len(merged) >= MERGED:
                            yield counted(merged)
                            merged = {}
                else:
                    k1, k2 = part.column(0).to_pylist(), part.column(1).to_pylist()
                    held: dict[tuple, dict[int, list]] = {}
                    for i, at, h, digest, _, _ in rows(part):
                        held.setdefault((h, digest), {}).setdefault(i, []).append(at)
                    if held:
                        yield _held(held, k1, k2)
        if merged:
            yield counted(merged)

    return run


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _held(held: dict[tuple, dict[int, list]], k1: list, k2: list) -> pa.RecordBatch:
    """A row per context with the texts that hold it, each with its places; at most ``SAME`` places in a row."""
    out: list[tuple] = []
    for (h, digest), by_text in held.items():
        row, n = [], 0
        for i, places in by_text.items():
            for a in range(0, len(places), SAME):
                at, *more = places[a : a + SAME]
                if n + len(more) >= SAME:
                    out.append((h, digest, row))
                    row, n = [], 0
                row.append((k1[i], k2[i], at, more))
                n += 1 + len(more)
        out.append((h, digest, row))
    hashes, digests, texts = zip(*out, strict=True)
    first, second, at, more = zip(*(t for row in texts for t in row), strict=True)
    structs = pa.StructArray.from_arrays(
        [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(at, pa.int32()), pa.array(more, pa.list_(pa.int32()))],
        names=["k1", "k2", "at", "more"],
    )
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), structs)],
        names=["hash", "digest", "held"],
    )


def _range_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in grouped(batches):
            merged: dict[bytes, list] = {}
            for _, digest, left, context, copies in rows:
                merged.setdefault(digest, [left, context, 0])[2] += copies
            if len(merged) == 1 and next(iter(merged.values()))[2] == 1:
                continue
            members = [(context[:left][::-1], context[left:], copies) for left, context, copies in merged.values()]
            for digest, ranges in zip(merged, repeated_offsets(members, length), strict=True):
                out.extend((key, digest, low, high) for low, high in _joined(ranges))
            if len(out) > 20_000:
                yield _ranges(out)
                out = []
        if out:
            yield _ranges(out)

    return run


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(high, joined[-1][1]))
        else:
            joined.append((low, high))
    return joined


def _ranges(out: list[tuple]) -> pa.RecordBatch:
    key, digest, low, high = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.int32()), pa.array(high, pa.int32())],
        names=["hash", "digest", "low", "high"],
    )


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = []
                for i in range(part.num_rows):
                    text = part.column(2)[i].as_py() or b""
                    spans = _joined(
                        [
                            (at - s["high"], at - s["low"] + length - 1)
                            for s in part.column(3)[i].as_py()
                            for at in (s["at"], *s["more"])
                        ]
                    )
                    kept, at = [], 0
                    for begin, last in spans:
                        kept.append(text[at:begin])
                        at = last + 1
                    kept.append(text[at:])
                    rest = b"".join(kept)
                    out.append((len(text) - len(rest), len(spans), sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
                removed, n_spans, digests, rests = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(removed, pa.int64()),
                        pa.array(n_spans, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(rests, pa.string()),
                    ],
                    names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept_text"],
                )

    return run


def cut_documents(documents: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept_sha256, kept_text of the documents that lose bytes.

    An anchor found in more than ``hot`` places is split over tasks by its runs; results do not depend on it.

    k1 and k2 are ``document_key``; rows of equal id and text share one result. kept_text leaves out
    a character of which only some bytes are left.
    """
    if not SEED < length < SEED + 256:
        raise ValueError(f"length must lie between {SEED + 1} and {SEED + 255}")
    key = F.xxhash64("k1", "k2").alias("key")
    texts = documents.select(*document_key(), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    # Millions of rows a gigabyte: a row is one key, one packed place and one hash.
    seeds = stored(in_tasks(texts.select(key, "text"), _anchor_rows(length), "key long, place long, hash long"), "anchors")
    found = seeds.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = found.select("hash", (F.col("_n") > hot).alias("hot"))
    places = (
        seeds.join(again, "hash")
        .groupBy("key")
        .agg(F.collect_set(F.struct("place", "hash", "hot")).alias("places"))
    )
    near = stored(texts.withColumn("key", key).join(places, "key").select("k1", "k2", "text", "places"), "contexts")
    contexts = in_tasks(near, _contexts(length, True), "hash long, digest binary, left int, context binary, copies long")
    ranges = in_tasks(
        contexts.repartition("hash").sortWithinPartitions("hash"),
        _range_rows(length),
        "hash long, digest binary, low int, high int",
    )
    held = "hash long, digest binary, held array<struct<k1:long,k2:long,at:int,more:array<int>>>"
    at = in_tasks(near, _contexts(length, False), held)
    # Places of a context are joined as one row and taken apart only when dealt anew, away from the others of its hash;
    # the places that one text has of it stay together up to the cut.
    spans = (
        at.join(ranges, ["hash", "digest"])
        .repartition("hash", "digest", F.col("held")[0])
        .select(F.explode("held").alias("place"), "low", "high")
        .groupBy("place.k1", "place.k2")
        .agg(F.collect_set(F.struct("low", "high", "place.at", "place.more")).alias("spans"))
    )
    cut = in_tasks(
        near.select("k1", "k2", "text").join(spans, ["k1", "k2"]),
        _cutter(length),
        "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string",
    )
    return cut.dropDuplicates(["k1", "k2"])


def removed_bytes(documents: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if some string of ``length`` bytes over it also starts elsewhere in the input,
    overlaps and the same document included. Null texts are empty; rows of one id are documents of
    their own; a null doc_id stays null. Columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(
        "doc_id", *document_key(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole")
    )
    cut = cut_documents(documents, length, hot).drop("kept_text")
    return base.join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, length: int = 200) -> DataFrame:
    """The documents with their repeated bytes removed from ``text``; all rows and columns stay.

    ``n_chars``, where there is one, is counted again.
    """
    names = documents.columns
    mark = [c.alias(f"_{n}") for n, c in zip(("k1", "k2"), document_key(), strict=True)]
    cut = cut_documents(documents, length).select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept_text").alias("_kept")
    )
    joined = documents.select("*", *mark).join(cut, ["_k1", "_k2"], "left")
    new = {"text": F.coalesce("_kept", "text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept")).cast(
            documents.schema["n_chars"].dataType
        )
    return joined.select(*[new.get(n, F.col(f"`{n}`")).alias(n) for n in names])
