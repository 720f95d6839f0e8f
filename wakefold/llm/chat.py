r"""Conversations as training windows of whole turns.

A turn is written ``### role: text</turn>`` and a line end. Inside roles and texts a backslash goes
before each backslash and before what could be read as a marker, so the written form can be taken
apart again whatever the texts say. Prefix sums of the turns' tokens choose the spans: a window
takes turns while they fit its budget, a turn over the budget is a window of its own. Every later
window first repeats the system turn and as many of the last turns as fit the history budget;
repeated turns are outside the loss mask, so each assistant text is a target once.

A conversation is streamed in order of its turns; only the open window and the history are held.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import in_tasks, stored

BUDGET = 1024
HISTORY = 256
_END = "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:\n]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_WINDOWS = "conv_id long, `window` long, text string, n_repeated int, loss array<struct<begin:int,end:int>>"


def escape_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "\\</turn>").replace("### ", "\\### ")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a written window."""
    found, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


def n_tokens(text: str) -> int:
    """Size of a turn for the budget: its words, and four for the markers."""
    return len(text.split()) + 4


class Formatter:
    """Windows of one conversation, fed turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history_budget = budget, history
        self.system: tuple[str, str] | None = None
        self.history: deque[tuple[str, str, int]] = deque()
        self.open: list[tuple[str, str]] = []
        self.repeated: list[tuple[str, str]] = []
        self.size = self.number = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        tokens = n_tokens(text)
        if self.open and self.size + tokens > self.budget:
            yield self.close()
            self.repeated = [self.system] if self.system else []
            self.repeated += [(r, t) for r, t, _ in self.history]
            self.size = sum(n_tokens(t) for _, t in self.repeated)
            if self.size + tokens > self.budget:  # the history gives way, the system turn stays
                self.repeated = [self.system] if self.system else []
                self.size = sum(n_tokens(t) for _, t in self.repeated)
        self.open.append((role, text))
        self.size += tokens
        if role == "system" and self.system is None:
            self.system = (role, text)
        else:
            self.history.append((role, text, tokens))
            while self.history and sum(n for _, _, n in self.history) > self.history_budget:
                self.history.popleft()

    def close(self) -> tuple:
        parts, loss, at = [], [], 0
        for k, (role, text) in enumerate([*self.repeated, *self.open]):
            head, body = f"### {escape_role(role)}: ", escape_text(text)
            if role == "assistant" and k >= len(self.repeated):
                loss.append({"begin": at + len(head), "end": at + len(head) + len(body)})
            parts.append(head + body + _END)
            at += len(parts[-1])
        row = (self.number, "".join(parts), len(self.repeated), loss)
        self.number, self.open, self.repeated = self.number + 1, [], []
        return row


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, 1000).columns), strict=True)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _format(budget: int, history: int):
    names = ["conv_id", "window", "text", "n_repeated", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, conv = None, None
        for conv_id, role, text in _rows(batches):
            if current is None or conv_id != conv:
                if current is not None:
                    out.append((conv, *current.close()))
                current, conv = Formatter(budget, history), conv_id
            out.extend((conv, *w) for w in current.add(role, text))
            if len(out) >= 200:
                yield _batch(out, _KINDS, names)
                out = []
        if current is not None:
            out.append((conv, *current.close()))
        if out:
            yield _batch(out, _KINDS, names)

    return run


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_repeated (leading turns seen before), loss (spans of ``text``).

    Turns are ordered by turn, then role and text, so ties and repeated rows have one order. Null
    roles and texts are empty, a null turn comes first, rows without conv_id are one conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    return in_tasks(
        rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text"),
        _format(budget, history),
        _WINDOWS,
    )


class Digest:
    """What a reader of the windows of one conversation finds."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.targets = sha256(), sha256()

    def add(self, text: str, n_repeated: int, loss: list[dict]) -> None:
        for role, said in parse(text)[n_repeated:]:
            self.all.update(f"{role}\n{said}\n".encode())
            self.turns += 1
        for span in loss:
            target = unescape(text[span["begin"] : span["end"]])
            self.targets.update(target.encode())
            self.loss_chars += len(target)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.targets.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    current, conv = None, None
    for conv_id, _, text, n_repeated, loss in _rows(batches):
        if current is None or conv_id != conv:
            if current is not None:
                out.append((conv, *current.row()))
            current, conv = Digest(), conv_id
        current.add(text, n_repeated, loss)
        if len(out) >= 1000:
            yield _batch(out, kinds, names)
            out = []
    if current is not None:
        out.append((conv, *current.row()))
    if out:
        yield _batch(out, kinds, names)


def digests(written: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows in order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_tasks(written.repartition("conv_id").sortWithinPartitions("conv_id", "window"), _digest, schema)


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Writes the windows to the shared folder and returns the digests of what is read back."""
    return digests(stored(windows(conversations), "chat-windows"))
