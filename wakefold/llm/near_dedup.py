"""Near-duplicate documents by a multi-index Hamming join of min-hash signatures.

A document's set is its distinct w-word shingles. Its signature has ``5 * chunks`` components of
16 bits, each the tail of a minimum under another hash. By the pigeonhole principle two signatures
that differ in at most ``2 * chunks - 1`` components differ in at most one component of some chunk
of five. Each chunk is therefore indexed five times, once without each component: every pair up to
that distance, which is also the limit for candidates, meets in a bucket. With 17 chunks a pair at
similarity 0.8 lies beyond it with probability about 1e-5.

Buckets of any size are used whole, in two steps without rounds. First each set goes to the bucket
centre it meets most often; a centre is the member that meets most others, which in a group of
copies is the text they were made from. Sets of one centre are compared in cells of bounded size.
Then only buckets that still hold several components are searched: members with a partner of another
component within the limit form groups, equal groups of different buckets become one, and each group
is compared. All comparisons count the common shingles of full sets inside the task, so that a cell
gives at most one link for each of its members and pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakefold.llm.components import components
from wakefold.llm.store import in_tasks, stored
from wakefold.llm.textcore import U64, grouped, mix, shingle_sets, slices

CHUNK = 5
BLOCK = 1000
BLOCK_SHINGLES = 500_000
_COLUMNS = 2048


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _signer(words: int, chunks: int):
    size = CHUNK * chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(size)
        for batch in batches:
            ids = batch.column(0)
            for piece in slices(batch.column(1)):
                hashes, bounds = shingle_sets(piece, words)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                values = np.zeros((len(piece), size), np.uint16)
                for k in range(size if len(full) else 0):
                    least = np.minimum.reduceat(hashes * seeds[k], bounds[full])
                    values[full, k] = (mix(least) >> U64(48)).astype(np.uint16)
                nodes = [
                    int.from_bytes(blake2b(hashes[bounds[i] : bounds[i + 1]].tobytes(), digest_size=8).digest(), "little", signed=True)
                    for i in range(len(piece))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(piece.first, len(piece)),
                        batch.column(2).slice(piece.first, len(piece)),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array([v.tobytes() for v in values], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "node", "signature"],
                )

    return run


def _unpacked(column, size: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint16).reshape(-1, size)


def _indexer(chunks: int):
    """One key for each chunk and left-out component: the other four components are 64 bits."""
    size = CHUNK * chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = _seeds(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values = _unpacked(part.column(1), size).astype(U64)
                keys = np.empty_like(values)
                for k in range(size):
                    first = k - k % CHUNK
                    packed = np.zeros(len(values), U64)
                    for j in range(first, first + CHUNK):
                        if j != k:
                            packed = (packed << U64(16)) | values[:, j]
                    keys[:, k] = mix(packed ^ tags[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel().view(np.int64)),
                        pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), size)),
                    ],
                    names=["key", "node"],
                )

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets, as products of 0/1 matrices of bounded width."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(flat) else first
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    both = np.zeros((n, n), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        held = np.zeros((n, min(_COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        both += held @ held.T
    return both


def _joined(near: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``near`` that join the components, one for each joining."""
    _, group = np.unique(comps, return_inverse=True)
    group, links = group.copy(), []
    for i in range(len(near)):
        for g in np.unique(group[near[i] & (group != group[i])]):
            j = int(np.flatnonzero(near[i] & (group == g))[0])
            links.append((i, j))
            group[group == g] = group[i]
    return links


def _linker(words: int, percent: int):
    """Links between members of a cell of different components, confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for _, rows in grouped(batches):
            nodes, comps = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            sets = []
            for piece in slices(pa.array([r[3] for r in rows], pa.string())):
                hashes, bounds = shingle_sets(piece, words)
                sets.extend(hashes[bounds[i] : bounds[i + 1]] for i in range(len(piece)))
            both, sizes = _common(sets), np.array([len(x) for x in sets])
            near = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes - both))
            links += [(int(nodes[i]), int(nodes[j])) for i, j in _joined(near, comps)]
            if len(links) > 100_000:
                yield _pair_batch(links)
                links = []
        if links:
            yield _pair_batch(links)

    return run


def _grouper(chunks: int, percent: int):
    """Groups of a cell's members that reach each other over pairs to compare.

    Such a pair is of different components, of fitting set sizes and within the signature distance.
    A group is named by its members, so the same group from another bucket has the same name.
    """
    size, limit = CHUNK * chunks, 2 * chunks - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for _, rows in grouped(batches):
            nodes, comps, sizes = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            values = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, size)
            label = np.arange(len(rows))
            for i in range(len(rows) - 1):
                low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
                others = np.flatnonzero((comps[i + 1 :] != comps[i]) & (100 * low >= percent * high)) + i + 1
                met = label[others[(values[others] != values[i]).sum(axis=1) <= limit]]
                if len(met):
                    met = np.unique(np.append(met, label[i]))
                    label[np.isin(label, met)] = met[0]
            order = np.lexsort((nodes, label))
            for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                if len(part) > 1:
                    name = blake2b(nodes[part].tobytes(), digest_size=8).digest()
                    out |= {(int.from_bytes(name, "little", signed=True), int(x)) for x in nodes[part]}
            if len(out) > 200_000:
                yield _pair_batch(out)
                out = set()
        if out:
            yield _pair_batch(out)

    return run


def _pair_batch(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])


def _blocks(n: Column, shingles: Column) -> Column:
    """Number of blocks of bounded size for so many members and shingles."""
    return (1 + F.greatest(F.floor(n / BLOCK), F.floor(shingles / BLOCK_SHINGLES))).cast("int")


def _block_of(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _each(first: int | Column, blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(first), blocks - 1))


def _centred(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """cell, node: each set with the centre it meets most often, in cells of bounded size."""
    reach = buckets.groupBy("node").agg(F.sum("n").alias("reach"))
    top = F.max(F.struct("reach", F.negative("node").alias("back"), "node"))
    centres = buckets.join(reach, "node").groupBy("key").agg(top["node"].alias("centre"))
    met = buckets.join(centres, "key").where("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("times"))
    own = met.groupBy("node").agg(F.max(F.struct("times", "centre"))["centre"].alias("centre"))
    dealt = own.join(classes.select("node", "n_shingles"), "node")
    sizes = dealt.groupBy("centre").agg(_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks"))
    members = dealt.join(sizes, "centre").select(F.xxhash64("centre", _block_of("blocks")).alias("cell"), "node")
    centre = sizes.withColumn("block", _each(0, F.col("blocks"))).select(F.xxhash64("centre", "block").alias("cell"), F.col("centre").alias("node"))
    return members.union(centre)


def _open_cells(placed: DataFrame) -> DataFrame:
    """cell, node: members of buckets that hold several components, in cells of bounded size.

    The largest component of a bucket needs no comparison inside itself: its blocks meet the blocks of
    all other members, and those meet each other.
    """
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    whole = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("components"),
        F.max(F.struct("n", "component", "shingles")).alias("main"),
        F.sum("n").alias("n"),
        F.sum("shingles").alias("shingles"),
    )
    open_ = whole.where("components > 1").select(
        "key",
        F.col("main.component").alias("main"),
        _blocks(F.col("main.n"), F.col("main.shingles")).alias("mains"),
        _blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("others"),
    )
    rows = placed.join(open_, "key")
    main, other = rows.where("component = main"), rows.where("component <> main")
    here, there = _block_of("mains"), _block_of("others")
    crossed = main.withColumn("other", _each(0, F.col("others"))).select(F.xxhash64("key", here, "other").alias("cell"), "node")
    crossing = other.withColumn("block", _each(0, F.col("mains"))).select(F.xxhash64("key", "block", there).alias("cell"), "node")
    apart = other.where("others > 1").withColumn("own", there).withColumn("other", _each(0, F.col("others")))
    among = apart.where("own <> other").select(
        F.xxhash64("key", F.lit(-1), F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node"
    )
    return crossed.union(crossing).union(among)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _with_components(documents: DataFrame, words: int, percent: int, chunks: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and node, first doc_id and component of each distinct set."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key"))
    schema = "doc_id long, text_key long, n_shingles long, node long, signature binary"
    signed = stored(in_tasks(texts.select("doc_id", "text", "text_key"), _signer(words, chunks), schema), "signatures")
    one = F.min(F.struct("doc_id", "text_key", "n_shingles", "signature")).alias("one")
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(linkable.groupBy("node").agg(one).select("node", "one.*"), "classes")
    keys = in_tasks(classes.select("node", "signature"), _indexer(chunks), "key long, node long")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(keys.join(met, "key"), "buckets")
    candidates = classes.join(buckets.select("node").distinct(), "node").select("doc_id", "text_key", "node")
    known = stored(texts.join(candidates, ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"]), "candidates")

    def links(cells: DataFrame) -> DataFrame:
        """``cells``: cell, node, component."""
        rows = cells.join(known, "node").select("cell", "node", "component", "text").repartition("cell")
        found = in_tasks(rows.sortWithinPartitions("cell"), _linker(words, percent), "a long, b long")
        return stored(found, "links")

    linked = links(_centred(buckets, classes).withColumn("component", F.col("node")))
    tied = stored(components(linked), "components")
    component = F.coalesce("component", "node").alias("component")
    state = stored(
        classes.join(tied, "node", "left").select("node", component, "n_shingles", "signature"), "placed"
    )
    placed = buckets.select("key", "node").join(state.select("node", "component", "n_shingles"), "node")
    cells = _open_cells(stored(placed, "entries")).join(state, "node").select("cell", "node", "component", "n_shingles", "signature")
    groups = in_tasks(cells.repartition("cell").sortWithinPartitions("cell"), _grouper(chunks, percent), "cell long, node long")
    more = links(groups.distinct().join(state.select("node", "component"), "node"))
    final = stored(components(linked.union(more)), "components")
    return signed, classes.join(final, "node", "left").select("node", "doc_id", component)


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, chunks: int = 17) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Null and wordless texts have n_shingles 0 and no link. Equal sets are one class, whatever the
    number of copies. A row without doc_id is linked with nothing: component_id is null and kept
    true. Rows that repeat a doc_id are rows of their own. Other columns are not read.
    """
    signed, placed = _with_components(documents, words, percent, chunks)
    least = placed.groupBy("component").agg(F.min("doc_id").alias("_least"))
    known = placed.select("node", "component").join(least, "component").select("node", "_least")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(known, "node", "left")
        .select("doc_id", "n_shingles", F.when(linkable, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_near_copies(documents: DataFrame, words: int = 5, percent: int = 80, chunks: int = 17) -> DataFrame:
    """The documents, all columns, with one row of each group of near copies: the least doc_id, then text hash.

    Rows equal in doc_id and text are copies of each other; rows that share a doc_id only are not. Rows
    without doc_id or without words are in no group and all stay.
    """
    signed, placed = _with_components(documents, words, percent, chunks)
    rows = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").join(placed.select("node", "component"), "node")
    chosen = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
    times = rows.groupBy("doc_id", "text_key").agg((F.count(F.lit(1)) > 1).alias("_again"))
    keys = chosen.select("one.*").join(times, ["doc_id", "text_key"]).toDF("_id", "_text", "_again")
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (_text_key() == F.col("_text"))
    found = documents.where(~alone).join(keys, same)
    once = found.where("NOT _again").select(documents["*"])
    again = found.where("_again").select(documents["*"]).dropDuplicates(["doc_id", "text"])
    return once.union(again).union(documents.where(alone))
