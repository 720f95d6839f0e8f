"""Personal data in texts: fixed patterns, and a skip-chain conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Tokens that hold a
digit or an at sign are the field's nodes; a label is one of the four kinds or none. Neighbouring
tokens share a chain potential. Tokens of one document that repeat each other or are alike (equal
text, equal last seven digits, an address and its local part) share a skip potential: each such group
has a hidden node of its own, tied to all its tokens, so that a group of any size costs as many
edges as it has tokens. Loopy message passing carries a label to all mentions of an entity in the document.

Weights are learned by pseudo-likelihood from the patterns' own labels on at most ``sample`` tokens
(those of least hash, from about ``4 * sample`` documents chosen by hash), around a prior that knows cue words, check digits and agreement. A token that
the patterns left but a mate or a cue speaks for is no example of a token without label. Labels of pattern
matches stay fixed. A token gets a label of its own only above ``threshold``, and where it either
shares a long group with a pattern match or has the digits or the form that the kind needs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.llm.store import in_tasks
from wakefold.llm.terms import text_bytes

SAMPLE = 20_000
THRESHOLD = 0.8
ROUNDS = 12
#: Expected, and greatest, agreement inside long and short groups.
BONDS = (8.0, 0.5)
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4
_LABELS = 1 + len(KINDS)
_INPUTS = 1 << 13
_WIDTH = 16

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(rb"[0-9]+")
_QUAD = re.compile(rb"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(rb"[0-9@]|[(\[{](?:at|AT)[)\]}]")
_HIDDEN_AT = re.compile(rb"[A-Za-z0-9._%+-]+[(\[{](?:at|AT)[)\]}][A-Za-z0-9-]+(?:(?:\.|[(\[{](?:dot|DOT)[)\]}])[A-Za-z0-9-]+)+")
_BLANK = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_TRIM = b".,;:!?\"'()[]{}<>=*#$%&|"
# Words that announce a kind.
_CUES = {
    EMAIL: "email e-mail mail mailto contact correo courriel",
    IP: "ip ipv4 host server adresse-ip",
    CARD: "card visa mastercard amex karte kreditkarte tarjeta carte",
    PHONE: "phone tel telephone call mobile cell fax telefon handy mobil telefono móvil téléphone teléfono appelez llame whatsapp",
}
_CUE = {word.encode(): kind for kind, words in _CUES.items() for word in words.split()}


def _luhn(digits: bytes) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = (digit - 48) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def pattern_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches in bytes, in order; work is linear in the text."""
    found, done = [], 0
    at = text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at) if start < at else None
        if tail:
            done = tail.end()
            found.append((start, EMAIL, done))
        at = text.find(b"@", max(at + 1, done))
    done = 0
    for run in _RUN.finditer(text):
        if run.start() >= done and text[run.end() : run.end() + 1] == b"." and (quad := _QUAD.match(text, run.start())):
            done = quad.end()
            if all(map(_small, quad.group().split(b"."))):
                found.append((quad.start(), IP, done))
    for match in _CARD.finditer(text):
        digits = match.group().translate(None, b" -")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((match.start(), CARD, match.end()))
    for match in _PHONE.finditer(text):
        if 9 <= len(match.group().translate(None, b"+ ().-")) <= 15:
            found.append((match.start(), PHONE, match.end()))
    return sorted(found)


def _place(name: str | bytes) -> int:
    return 1 + crc32(name if isinstance(name, bytes) else name.encode()) % (_INPUTS - 1)


def _bucket(n: int) -> int:
    return n if n < 20 else 20


def _traits(core: bytes, before: bytes, digits: bytes) -> list[int]:
    """Places of a token's inputs; 0 fills up."""
    shape = re.sub(rb"[A-Za-z\x80-\xff]+", b"a", _RUN.sub(b"9", core))[:24]
    names = [
        "bias", b"shape " + shape, f"digits {_bucket(len(digits))}", f"at {min(core.count(b'@'), 2)}",
        f"dots {min(core.count(b'.'), 4)}", f"hyphens {min(core.count(b'-'), 3)}", f"plus {core[:1] == b'+'}",
        b"before " + _RUN.sub(b"9", before)[-12:] if _RUN.search(before) else "before word",
    ]
    cue = _CUE.get(before.strip(_TRIM).lower())
    if cue:
        names.append(f"cue {cue} {_fit(core, digits, cue)}")
    if 12 <= len(digits) <= 19:
        names.append(f"luhn {_luhn(digits)}")
    if core.count(b".") == 3 and core.replace(b".", b"").isdigit() and all(core.split(b".")):
        names.append(f"quad {all(map(_small, core.split(b'.')))}")
    if _HIDDEN_AT.fullmatch(core):
        names.append("hidden at")
    return [_place(n) for n in names]


def _fit(core: bytes, digits: bytes, kind: int) -> bool:
    """Whether one token alone has what the kind needs."""
    if kind == EMAIL:
        return bool(_HIDDEN_AT.fullmatch(core))
    if kind == IP:
        return False
    plain = not re.search(rb"[A-Za-z\x80-\xff@=_/]", core)
    return plain and (12 <= len(digits) <= 19 and _luhn(digits) if kind == CARD else 9 <= len(digits) <= 15)


_TELLING = {_place("hidden at"), *(_place(f"cue {kind} True") for kind in (EMAIL, CARD, PHONE))}


def _prior() -> np.ndarray:
    """Expected weights: no label unless shown otherwise, failed checks against a kind, cues for it."""
    weights = np.zeros((_INPUTS, _LABELS), np.float64)
    weights[_place("bias"), 0] = 2.0
    weights[_place("luhn False"), CARD] = -8.0
    weights[_place("quad False"), IP] = -8.0
    weights[_place("hidden at"), EMAIL] = 9.0
    for kind in (EMAIL, CARD, PHONE):
        weights[_place(f"cue {kind} True"), kind] = 8.0
    return weights


class Graph:
    """Nodes, chain edges and groups of one document."""

    def __init__(self, text: bytes, base: list[tuple[int, int, int]]):
        flat = text.translate(_BLANK)
        handles = {local for start, kind, end in base if kind == EMAIL and _told(local := text[start:end].split(b"@")[0].lower())}
        self.spans: list[tuple[int, int]] = []
        self.digits: list[bytes] = []
        self.traits: list[list[int]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        groups: dict[bytes, list[int]] = defaultdict(list)
        b, last_end, places = 0, -2, self._hits(text, flat, handles)
        for start, end in places:
            token = flat[start:end]
            left = len(token) - len(token.lstrip(_TRIM.replace(b"(", b"") if b")" in token else _TRIM))
            core = token.strip(_TRIM) or token
            begin = start + (left if token.strip(_TRIM) else 0)
            while b < len(base) and base[b][2] <= start:
                b += 1
            label = next((kind for s, kind, e in base[b : b + 4] if s < end and e > start), 0)
            word = flat[:start].rstrip(b" ")[-40:].rsplit(b" ", 1)[-1] if start < 64 else flat[start - 64 : start].rstrip(b" ").rsplit(b" ", 1)[-1]
            digits = bytes(c for c in core if 48 <= c <= 57)
            node = len(self.spans)
            self.spans.append((begin, max(begin + 1, start + len(token.rstrip(_TRIM)))))
            self.digits.append(digits)
            self.traits.append(_traits(core, word, digits))
            self.label.append(label)
            if start - last_end == 1:
                self.chain.append((node - 1, node))
            last_end = end
            low = core.lower()
            if len(low) >= 3:
                groups[low].append(node)
            if len(digits) >= 7:
                groups[b"#" + digits[-7:]].append(node)
            if (local := low.split(b"@")[0]) in handles and local != low:
                groups[local].append(node)
        self.groups = [(len(key) >= 6, nodes) for key, nodes in groups.items() if len(nodes) > 1]

    @staticmethod
    def _hits(text: bytes, flat: bytes, handles: set[bytes]) -> list[tuple[int, int]]:
        """Bounds of the tokens with a digit, an at sign or a known local part."""
        found, end = set(), 0
        while hit := _HIT.search(text, end):
            start = flat.rfind(b" ", end, hit.start()) + 1 or end
            end = flat.find(b" ", hit.start())
            end = len(text) if end < 0 else end
            found.add((start, end))
        low = flat.lower() if handles else b""
        for handle in handles:
            at = low.find(handle)
            while at >= 0:
                start, end = low.rfind(b" ", 0, at) + 1, low.find(b" ", at)
                end = len(low) if end < 0 else end
                found.add((start, end))
                at = low.find(handle, end)
        return sorted(found)

    def settled(self) -> np.ndarray:
        """Tokens whose label can teach: an unmatched one that a match or a cue speaks for may be missed data."""
        open_ = {i for long, nodes in self.groups if long and any(self.label[j] for j in nodes) for i in nodes}
        return np.array([bool(y) or (i not in open_ and not _TELLING & set(t)) for i, (y, t) in enumerate(zip(self.label, self.traits, strict=True))], bool)

    def mates(self) -> np.ndarray:
        """Per node the most common label of its other settled long and short group members; -1: none."""
        votes, settled = np.zeros((len(self.spans), 2, _LABELS)), self.settled()
        for long, nodes in self.groups:
            sure = [i for i in nodes if settled[i]]
            total = np.bincount([self.label[i] for i in sure], minlength=_LABELS)
            for i in sure:
                votes[i, 0 if long else 1] += total
                votes[i, 0 if long else 1, self.label[i]] -= 1
        return np.where(votes.sum(2) > 0, votes.argmax(2), -1)


def _told(local: bytes) -> bool:
    """A local part that is no ordinary word."""
    return len(local) >= 6 and bool(re.search(rb"[0-9._+-]", local.strip(b"._+-")))


class Field:
    """Weights of the field: inputs, neighbours, and agreement inside long and short groups."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, agree: np.ndarray):
        self.weights, self.chain, self.agree = weights, chain, agree

    def unary(self, traits: list[list[int]]) -> np.ndarray:
        return self.weights[_padded(traits)].sum(1)

    def beliefs(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Marginals of each node by loopy sum-product, all messages of a round at once, damped by half."""
        unary = self.unary(graph.traits)
        fixed = np.array(graph.label, np.int64)
        known = np.flatnonzero(fixed)
        unary[known] = -30.0
        unary[known, fixed[known]] = 0.0
        n = len(unary)
        chain = np.array(graph.chain, np.int64).reshape(-1, 2)
        member = np.array([i for _, nodes in graph.groups for i in nodes], np.int64)
        group = np.repeat(np.arange(len(graph.groups)), [len(nodes) for _, nodes in graph.groups])
        bond = np.expm1(np.repeat([self.agree[0 if long else 1] for long, _ in graph.groups], [len(nodes) for _, nodes in graph.groups]))
        ahead, back = np.zeros((len(chain), _LABELS)), np.zeros((len(chain), _LABELS))
        up, down = np.zeros((len(member), _LABELS)), np.zeros((len(member), _LABELS))
        for _ in range(rounds):
            node = _gathered(unary, (chain[:, 1], ahead), (chain[:, 0], back), (member, down))
            hub = _gathered(np.zeros((len(graph.groups), _LABELS)), (group, up))
            new_ahead = _passed(node[chain[:, 0]] - back, self.chain)
            new_back = _passed(node[chain[:, 1]] - ahead, self.chain.T)
            new_up = _agreed(node[member] - down, bond)
            new_down = _agreed(hub[group] - up, bond)
            ahead, back, up, down = (0.5 * (a + b) for a, b in ((ahead, new_ahead), (back, new_back), (up, new_up), (down, new_down)))
        out = _gathered(unary, (chain[:, 1], ahead), (chain[:, 0], back), (member, down)) if n else unary
        out = np.exp(out - out.max(1, keepdims=True)) if n else out
        return out / out.sum(1, keepdims=True) if n else out


def _gathered(start: np.ndarray, *messages: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    total = start.copy()
    for at, values in messages:
        for label in range(_LABELS):
            total[:, label] += np.bincount(at, values[:, label], len(start))[: len(start)]
    return total


def _scaled(message: np.ndarray) -> np.ndarray:
    return message - message.max(1, keepdims=True) if len(message) else message


def _passed(come: np.ndarray, potential: np.ndarray) -> np.ndarray:
    come = _scaled(come)
    return _scaled(np.log(np.exp(come[:, :, None] + potential[None]).sum(1))) if len(come) else come


def _agreed(come: np.ndarray, bond: np.ndarray) -> np.ndarray:
    """Message over an edge that adds log(1 + bond) where both ends agree."""
    come = np.exp(_scaled(come))
    return _scaled(np.log(come.sum(1, keepdims=True) + bond[:, None] * come)) if len(come) else come


def _padded(traits: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(traits), _WIDTH), np.int64)
    for i, row in enumerate(traits):
        out[i, : len(row)] = row
    return out


def trained(rows: list[tuple], passes: int = 150, rate: float = 0.3, pull: float = 1e-3) -> Field:
    """Pseudo-likelihood: each token's label given its inputs, its neighbours' labels and its mates' labels.

    Rows are (inputs, label, label before, label after, label of long mates, of short mates), -1 where
    there is none. Full batches, adaptive gradients, and a pull to the prior.
    """
    prior, bonds = _prior(), np.array(BONDS)
    field = Field(prior.copy(), np.zeros((_LABELS, _LABELS)), bonds.copy())
    if not rows:
        field.chain = np.eye(_LABELS)
        return field
    traits = _padded([list(r[0]) for r in rows])
    label, before, after, long, short = (np.array([r[k] for r in rows], np.int64) for k in range(1, 6))
    n, truth = len(rows), np.eye(_LABELS)[label]
    has_before, has_after = (before >= 0)[:, None], (after >= 0)[:, None]
    seen = [np.full_like(field.weights, 1e-6), np.full_like(field.chain, 1e-6), np.full_like(field.agree, 1e-6)]
    for _ in range(passes):
        score = field.weights[traits].sum(1)
        score += np.where(has_before, field.chain[before], 0) + np.where(has_after, field.chain[:, after].T, 0)
        for weight, mates in zip(field.agree, (long, short), strict=True):
            score[np.arange(n)[mates >= 0], mates[mates >= 0]] += weight
        score = np.exp(score - score.max(1, keepdims=True))
        slope = score / score.sum(1, keepdims=True) - truth
        flat = traits.ravel()
        grads = [
            np.stack([np.bincount(flat, np.repeat(slope[:, k], _WIDTH), _INPUTS) for k in range(_LABELS)], 1) / n,
            np.zeros_like(field.chain),
            np.zeros(2),
        ]
        grads[0][0] = 0
        np.add.at(grads[1], before[before >= 0], slope[before >= 0] / n)
        np.add.at(grads[1].T, after[after >= 0], slope[after >= 0] / n)
        for k, mates in enumerate((long, short)):
            some = mates >= 0
            grads[2][k] = slope[some, mates[some]].sum() / n
        for value, start, grad, total in zip((field.weights, field.chain, field.agree), (prior, 0.0, bonds), grads, seen, strict=True):
            grad = grad + pull * (value - start)
            total += grad**2
            value -= rate * grad / np.sqrt(total)
        field.agree = np.clip(field.agree, 0.0, bonds)
    return field


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes, list, Graph | None]]:
    """(batch, row, text, pattern spans, graph or None where no token is a node)."""
    for batch in batches:
        texts = batch.column(1)
        some = pc.match_substring_regex(texts, r"[0-9@]|[(\[{](?:at|AT)[)\]}]").to_pylist()
        for i, hit in enumerate(some):
            text = texts[i].as_py() if hit else b""
            base = pattern_spans(text) if hit else []
            yield batch, i, text, base, Graph(text, base) if hit else None


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = set()
    for _, _, text, _, graph in _graphs(batches):
        seed = crc32(text)
        if graph is None or seed in met:
            continue
        met.add(seed)
        n = len(graph.spans)
        before, after = np.full(n, -1), np.full(n, -1)
        for a, b in graph.chain:
            before[b], after[a] = graph.label[a], graph.label[b]
        mates = graph.mates()
        order = [crc32(b"%d %d" % (seed, i)) for i in range(n)]
        rows = pa.record_batch(
            {
                "at": pa.array(order, pa.int64()),
                "inputs": pa.array(graph.traits, pa.list_(pa.int32())),
                **{
                    name: pa.array(values, pa.int32())
                    for name, values in (("label", graph.label), ("b", before), ("a", after), ("long", mates[:, 0]), ("short", mates[:, 1]))
                },
            }
        )
        yield rows.filter(pa.array(graph.settled()))


def fitted(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on at most ``sample`` tokens.

    A hash of id and text chooses about ``4 * sample`` documents (all, if there are fewer); the tokens
    of least hash in them are taken. So what reaches the driver does not grow with the corpus.
    """
    share = F.lit(4 * sample) / F.lit(max(1, documents.count()))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)
    rows = documents.where(chosen).select(F.lit(0).alias("_"), text_bytes().alias("text"))
    found = in_tasks(rows, _examples, "at long, inputs array<int>, label int, b int, a int, long int, short int")
    return trained([tuple(r)[1:] for r in found.orderBy(*found.columns).limit(sample).collect()])


def added_spans(graph: Graph, beliefs: np.ndarray, base: list[tuple[int, int, int]], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end) of spans beyond the patterns: runs of neighbouring tokens of one kind."""
    label, sure = beliefs.argmax(1), beliefs.max(1)
    tied = np.zeros(len(label), bool)
    for long, nodes in graph.groups:
        kinds = {graph.label[i] for i in nodes}
        for i in nodes:
            tied[i] |= long and label[i] in kinds
    free = (label > 0) & (sure >= threshold) & (np.array(graph.label) == 0)
    linked = {b for _, b in graph.chain}
    runs: list[list[int]] = []
    for i in np.flatnonzero(free):
        if runs and runs[-1][-1] == i - 1 and i in linked and label[i] == label[i - 1]:
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for run in runs:
        kind, digits = int(label[run[0]]), b"".join(graph.digits[i] for i in run)
        start, end = graph.spans[run[0]][0], graph.spans[run[-1]][1]
        whole = (
            (kind == PHONE and 9 <= len(digits) <= 15)
            or (kind == CARD and 12 <= len(digits) <= 19 and _luhn(digits))
            or (kind == EMAIL and len(run) == 1 and _place("hidden at") in graph.traits[run[0]])
        )
        if (whole or tied[run].any()) and not any(s < end and e > start for s, _, e in base):
            out.append((start, kind, end))
    return out


_SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _finder(field, threshold: float, rounds: int):
    def rows_of(text: bytes, base: list, graph: Graph) -> list[dict]:
        beliefs = field.value.beliefs(graph, rounds)
        both = [(*s, True) for s in base] + [(*s, False) for s in added_spans(graph, beliefs, base, threshold)]
        if not both:
            return []
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        return [{"kind": KINDS[k - 1], "start": int(heads[s]), "end": int(heads[e]), "base": b} for s, k, e, b in sorted(both)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch, _, text, base, graph in _graphs(batches):
            if now is not None and batch is not now:
                yield pa.record_batch({"doc_id": now.column(0), "spans": pa.array(out, _KIND)})
                out = []
            now = batch
            out.append(rows_of(text, base, graph) if graph else [])
        if now is not None:
            yield pa.record_batch({"doc_id": now.column(0), "spans": pa.array(out, _KIND)})

    return run


def found_spans(documents: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base), in order of start and kind.

    Spans of the patterns have ``base`` true, those of the field false; the latter overlap none of the
    former. Null texts are empty and have no spans. Repeated rows, ids and null ids are rows of their
    own. An empty table gives no rows. Only doc_id and text are read.
    """
    field = documents.sparkSession.sparkContext.broadcast(fitted(documents, sample))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return in_tasks(rows, _finder(field, threshold, rounds), _SPANS)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of pattern matches, the digest of their list, and the list of all spans, per document."""

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)


def redacted(text: str, spans: str):
    """Column: the text with each span replaced by its kind in brackets, overlapping ones once each."""
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, span):
        keep = F.substring(whole, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(F.concat(state["out"], keep, mark).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    return F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(whole, (s["at"] + 1).cast("int"), F.length(whole)))
    )
