"""Document quality by a factorisation machine over hashed words and structure.

Inputs of a document are its words, hashed to ``WORDS`` places and weighted by the logarithm of
their count, and measures of its form, each cut into steps that are inputs of their own. Every
input has a weight and a vector of ``RANK`` numbers; the score adds the weights and the products of
all pairs of vectors, the latter in linear time as half of (square of the sum - sum of squares).
It is trained by adaptive gradients on at most ``sample`` labelled rows, the ones with the least
hash of their id; all other work covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import in_tasks
from wakefold.llm.textcore import U64, Slice, Words, gram_hashes, mix, slices

WORDS = 1 << 16
STEPS = 16
RANK = 8
SAMPLE = 8000
PASSES = 8
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>{}[]=_~^@\\/+",
    "stop": b".!?", "comma": b",;:", "line": b"\n", "space": b" \t", "wide": range(128, 256),
}
MEASURES = [*_CLASSES, "words", "word_length", "distinct", "repeated", "line_length", "lines_again"]
INPUTS = WORDS + len(MEASURES) * STEPS


def _steps(name: str, value: float) -> int:
    """Step of a measure: logarithmic for lengths, finer near 0 for shares."""
    if name in ("words", "word_length", "line_length"):
        return min(STEPS - 1, int(2 * np.log2(1 + value) / (3 if name == "words" else 1.5)))
    return min(STEPS - 1, int(np.sqrt(min(max(value, 0.0), 1.0)) * STEPS))


def features(piece: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inputs and their values of each text of a slice; an empty text has its form only."""
    words = Words(piece)
    totals = {
        k: np.concatenate([[0], np.cumsum(np.isin(piece.data, np.frombuffer(bytes(v), np.uint8)))])
        for k, v in _CLASSES.items()
    }
    places = (mix(words.hash) % U64(WORDS)).astype(np.int64)
    trigrams = gram_hashes(words.hash, 3)
    out = []
    for i in range(len(piece)):
        a, b = words.bounds[i], words.bounds[i + 1]
        start, end = piece.starts[i], piece.ends[i]
        n, size = b - a, max(1, end - start)
        where, counts = np.unique(places[a:b], return_counts=True)
        measure = {k: (t[end] - t[start]) / size for k, t in totals.items()}
        measure["words"] = float(n)
        measure["word_length"] = float((words.end[a:b] - words.begin[a:b]).sum()) / max(1, n)
        measure["distinct"] = len(where) / max(1, n)
        grams = trigrams[a : max(a, b - 2)]
        measure["repeated"] = 1 - len(np.unique(grams)) / max(1, len(grams)) if len(grams) else 0.0
        lines = [line for line in piece.text(i).split(b"\n") if line.strip()]
        measure["line_length"] = n / max(1, len(lines))
        measure["lines_again"] = 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0
        form = [WORDS + k * STEPS + _steps(m, measure[m]) for k, m in enumerate(MEASURES)]
        weight = np.log1p(counts)
        weight = weight / max(1e-9, np.sqrt((weight**2).sum()))
        out.append(
            (
                np.concatenate([where, form]).astype(np.int32),
                np.concatenate([weight, np.full(len(form), 0.5)]).astype(np.float32),
            )
        )
    return out


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self._raw(rows)[0], -30, 30)))

    def _raw(self, rows):
        at = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows])
        bounds = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
        vx = self.vectors[at] * x[:, None]
        total = np.add.reduceat(vx, bounds, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, bounds, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weights[at] * x, bounds) + pairs, at, x, vx, total


def trained(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = PASSES, rate: float = 0.1, decay: float = 1e-4
) -> Machine:
    """Logistic loss, both labels of equal weight in sum, adaptive gradients, batches of 64 in a fixed order."""
    chance = np.random.default_rng(7)
    machine = Machine(0.0, np.zeros(INPUTS, np.float32), chance.normal(0, 0.02, (INPUTS, RANK)).astype(np.float32))
    if not len(rows):
        return machine
    share = min(max(float(labels.mean()), 0.01), 0.99)
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    seen_w, seen_v, seen_b = np.full(INPUTS, 1e-3, np.float32), np.full((INPUTS, RANK), 1e-3, np.float32), 1e-3
    for _ in range(passes):
        order = chance.permutation(len(rows))
        for first in range(0, len(order), 64):
            chosen = order[first : first + 64]
            raw, at, x, vx, total = machine._raw([rows[i] for i in chosen])
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]).astype(np.float32) * weights[chosen]
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            places, index = np.unique(at, return_inverse=True)
            step = slope[owner] * x
            grad_w = np.bincount(index, step, len(places)).astype(np.float32) + decay * machine.weights[places]
            each = step[:, None] * (total[owner] - vx)
            grad_v = np.stack([np.bincount(index, each[:, k], len(places)) for k in range(RANK)], axis=1)
            grad_v = grad_v.astype(np.float32) + decay * machine.vectors[places]
            seen_w[places] += grad_w**2
            seen_v[places] += grad_v**2
            seen_b += float(slope.sum()) ** 2
            machine.weights[places] -= rate * grad_w / np.sqrt(seen_w[places])
            machine.vectors[places] -= rate * 0.5 * grad_v / np.sqrt(seen_v[places])
            machine.bias -= rate * float(slope.sum()) / np.sqrt(seen_b)
    return machine


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch.column(1)):
            found = features(piece)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(piece.first, len(piece)),
                    pa.array([f[0].tobytes() for f in found], pa.binary()),
                    pa.array([f[1].tobytes() for f in found], pa.binary()),
                ],
                names=["quality", "inputs", "numbers"],
            )


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            scores = [machine.scores(features(piece)) for piece in slices(batch.column(batch.num_columns - 1))]
            joined = np.concatenate(scores) if scores else np.zeros(0)
            names = [*batch.schema.names[:-1], "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(joined, pa.float64())], names=names)

    return run


def held_out() -> "F.Column":
    """Rows that no training may see: crc32 of the id as text is divisible by 5. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine trained on at most ``sample`` labelled rows outside the held-out ones.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the least counts.
    """
    chosen = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("long").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    found = in_tasks(texts, _feature_rows, "quality long, inputs binary, numbers binary").collect()
    found.sort(key=lambda r: (r.quality, bytes(r.inputs)))
    rows = [(np.frombuffer(r.inputs, np.int32), np.frombuffer(r.numbers, np.float32)) for r in found]
    return trained(rows, np.array([r.quality for r in found], np.float32))


def scored(documents: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``score`` for every document; a null text is empty."""
    machine = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels))
    rows = documents.select(*[F.col(f"`{n}`") for n in keep], F.coalesce("text", F.lit("")).alias("_scored_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return in_tasks(rows, _scorer(machine), ", ".join([*kinds, "score double"]))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.3 on)."""
    rows = scored(documents, labels, ["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def of_quality(documents: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose score is at least ``least``; all columns stay."""
    names = documents.columns
    plain = documents.toDF(*[f"_c{i}" for i in range(len(names))])
    renamed = plain.select("*", plain[names.index("doc_id")].alias("doc_id"), plain[names.index("text")].alias("text"))
    rows = scored(renamed, labels, list(plain.columns))
    return rows.where(F.col("score") >= least).select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
