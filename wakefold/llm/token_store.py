"""Token ids in shards, with a minimal perfect hash index for keyed access.

A store is a folder of shard rows in ascending order of document: the payload holds raw
little-endian 16-bit ids, the index maps a document key to its offset in the payload. A key's
bucket has a displacement; key hash and displacement give the key's slot among exactly as many
slots as documents. A slot stores the key's fingerprint, so that a key which is not there is told,
and offset and length. A shard's payload is bounded, so neither writing nor reading gathers more
than a shard or one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakefold.llm.encoding import encoder, vocabulary_path
from wakefold.llm.store import in_tasks
from wakefold.llm.textcore import U64, mix
from wakefold.operators.joins import interval_join
from wakefold.sources import shared

VOCABULARY = "byte_bpe_50k.json"
SHARD_IDS = 1 << 20
SHARD_DOCUMENTS = 4096
_SLOT = np.dtype([("fingerprint", "<u8"), ("offset", "<u8"), ("length", "<u8")])
_SHARD = (
    "part int, shard int, first_id long, last_id long, start long, n_ids long, keys binary, missing binary,"
    " payload binary, displacements binary, slots binary"
)


def key_hashes(ids: np.ndarray, missing: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Hashes of (id, whether it is null, how many equal ids came before in the shard)."""
    return mix(mix(ids.astype(np.int64).view(U64)) + repeat.astype(U64) * U64(2) + missing.astype(U64))


def _slots(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes + displacement * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key); every slot is used once."""
    n = len(hashes)
    n_buckets = max(1, n // 3)
    bucket = ((hashes >> U64(32)) % U64(n_buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
    displacements = np.zeros(n_buckets, np.uint32)
    free, slot = np.ones(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-np.diff(bounds), kind="stable"):
        keys = by_bucket[bounds[b] : bounds[b + 1]]
        if not len(keys):
            break
        first, tries = 0, 16
        while True:
            candidates = np.arange(first, first + tries, dtype=U64)
            places = _slots(hashes[keys][None, :], candidates[:, None], n)
            fits = free[places].all(axis=1)
            if len(keys) > 1:
                fits &= (np.diff(np.sort(places, axis=1), axis=1) > 0).all(axis=1)
            if fits.any():
                at = int(np.argmax(fits))
                displacements[b], slot[keys] = first + at, places[at]
                free[places[at]] = False
                break
            first, tries = first + tries, min(tries * 4, 65_536)
    return displacements, slot


def find_slots(hashes: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    bucket = ((hashes >> U64(32)) % U64(len(displacements))).astype(np.int64)
    return _slots(hashes, displacements[bucket].astype(U64), n)


class _Open:
    """A shard being filled."""

    def __init__(self, start: int):
        self.start = start
        self.ids: list[int | None] = []
        self.payload: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.payload.append(ids)
        self.size += len(ids)

    def full(self) -> bool:
        return self.size >= SHARD_IDS or len(self.ids) >= SHARD_DOCUMENTS

    def row(self, part: int, shard: int) -> tuple:
        missing = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], "<i8")
        repeat = np.zeros(len(ids), np.int64)
        for k in range(1, len(ids)):
            if ids[k] == ids[k - 1] and missing[k] == missing[k - 1]:
                repeat[k] = repeat[k - 1] + 1
        hashes = key_hashes(ids, missing, repeat)
        displacements, slot = build_index(hashes)
        lengths = np.array([len(p) for p in self.payload], np.int64)
        table = np.zeros(len(ids), _SLOT)
        table["fingerprint"][slot] = hashes
        table["offset"][slot] = np.cumsum(lengths) - lengths
        table["length"][slot] = lengths
        payload = np.concatenate(self.payload).astype("<u2").tobytes()
        known = ids[~missing]
        low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        return (
            part, shard, low, high, self.start, self.size, ids.tobytes(), missing.tobytes(), payload,
            displacements.astype("<u4").tobytes(), table.tobytes(),
        )


def _writer(path: str, end_id: int):
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32())]
        + [(n, pa.int64()) for n in ("first_id", "last_id", "start", "n_ids")]
        + [(n, pa.binary()) for n in ("keys", "missing", "payload", "displacements", "slots")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, False).encode_all
        shard, part, current = 0, 0, _Open(0)

        def close() -> pa.RecordBatch:
            row = current.row(part, shard)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                part = rows.column(2)[0].as_py()
                found = encode(rows.column(1).to_pylist())
                for doc_id, ids in zip(rows.column(0).to_pylist(), found, strict=True):
                    current.add(doc_id, np.append(ids, np.uint16(end_id)))
                    if current.full():
                        yield close()
                        shard, current = shard + 1, _Open(current.start + current.size)
        if current.ids:
            yield close()

    return run


def write_store(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of doc_id.

    Null texts are empty; null ids come first; rows of equal id follow each other, ordered by a
    hash of their text, and each has a key of its own.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", "_tie"]
    dealt = (
        texts.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    rows = in_tasks(dealt, _writer(vocabulary or vocabulary_path(VOCABULARY), end_id), _SHARD)
    rows.write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard rows with ``start`` counted over the whole store. One total per part is ordered.

    Totals are a row per task that wrote, so they go to the shards: payloads are not shuffled.
    """
    rows = spark.read.schema(_SHARD).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("start") + F.col("_base")).drop("_base")


class Shard:
    """A shard read back; ids of a key in constant time."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["keys"], "<i8")
        self.missing = np.frombuffer(row["missing"], bool)
        self.payload = np.frombuffer(row["payload"], "<u2")
        self.displacements = np.frombuffer(row["displacements"], "<u4")
        self.slots = np.frombuffer(row["slots"], _SLOT)
        self.start = row["start"]

    def places(self, ids: np.ndarray, missing: np.ndarray, repeat: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the shard."""
        hashes = key_hashes(ids, missing, repeat)
        slot = find_slots(hashes, self.displacements, len(self.slots))
        return np.where(self.slots["fingerprint"][slot] == hashes, slot, -1)

    def ids_at(self, slot: int) -> np.ndarray:
        offset = int(self.slots["offset"][slot])
        return self.payload[offset : offset + int(self.slots["length"][slot])]


def _reader():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.slice(row, 1).to_pylist()[0])
                same = (shard.ids[1:] == shard.ids[:-1]) & (shard.missing[1:] == shard.missing[:-1])
                repeat = np.zeros(len(shard.ids), np.int64)
                for k in np.flatnonzero(same) + 1:
                    repeat[k] = repeat[k - 1] + 1
                slots = shard.places(shard.ids, shard.missing, repeat)
                found = [shard.ids_at(s) for s in slots]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.ids, mask=shard.missing),
                        pa.array(shard.slots["offset"][slots].astype(np.int64) + shard.start),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each fetched through the index."""
    return in_tasks(read_shards(spark, path), _reader(), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted doc_ids that the store holds (first row of an id).

    Each wanted id is sent to the shards whose range of ids holds it, by an interval join on the
    shards' bounds that needs few entries for a shard however far apart its ids lie; their indexes answer.
    """
    shards = read_shards(spark, path)
    one = F.lit("").alias("id")
    ranges = shards.where("first_id IS NOT NULL").select(
        one, "part", "shard", F.col("first_id").alias("from_ms"), F.col("last_id").alias("to_ms")
    )
    asked = wanted.select(one, F.col("doc_id").cast("long").alias("ts")).where("ts IS NOT NULL").distinct()
    sent = (
        interval_join(asked, ranges)
        .withColumnRenamed("ts", "doc_id")
        .groupBy("part", "shard")
        .agg(F.collect_list("doc_id").alias("asked"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                keys = np.array(row["asked"], np.int64)
                zero = np.zeros(len(keys), np.int64)
                slots = shard.places(keys, zero.astype(bool), zero)
                held = [(int(k), shard.ids_at(s).astype(np.int32)) for k, s in zip(keys, slots, strict=True) if s >= 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in held], pa.int64()), pa.array([v for _, v in held], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    found = in_tasks(shards.join(sent, ["part", "shard"]), run, "doc_id long, ids array<int>")
    return found.dropDuplicates(["doc_id"])


def store_documents(documents: DataFrame) -> DataFrame:
    """Writes a store of the documents to the shared folder and returns what is read back."""
    spark = documents.sparkSession
    path = shared.new_path(spark, "token-store")
    write_store(documents, path)
    return read_documents(spark, path)
