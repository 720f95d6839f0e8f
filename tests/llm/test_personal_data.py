"""Pattern spans against plain expressions; the field's own spans on mentions the patterns miss."""

import hashlib
import random
import re

import numpy as np
import pytest
from llm.small import documents, prose

from wakefold.llm import personal_data
from wakefold.llm.personal_data import CARD, EMAIL, PHONE, Graph, _luhn, pattern_spans
from wakefold.llm.queries import QUERIES

EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    found = []
    for order, (kind, expression) in enumerate(EXPRESSIONS.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits.encode())):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_patterns_against_plain_expressions():
    chance = random.Random(8)
    parts = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "255", "256", "4041894974608795", "a", "b.c", "é", "+1 (988) 555-2485", "x@y.zz", "\n", "%"]
    for _ in range(6000):
        text = "".join(chance.choices(parts, k=chance.randint(0, 14)))
        raw = text.encode()
        got = [f"{personal_data.KINDS[k - 1]}:{len(raw[:s].decode())}:{len(raw[:e].decode())}" for s, k, e in pattern_spans(raw)]
        assert got == _base(text), text


@pytest.mark.parametrize("unit", ["1", "1.", "a", "@", "a@", "+1", "1 ", "12-", "é", "a1@b.c ", "(at)"])
def test_very_long_texts_of_one_unit_end(unit):
    text = (unit * (300_000 // len(unit))).encode()
    graph = Graph(text, pattern_spans(text))
    beliefs = personal_data.trained([]).beliefs(graph, 2)
    assert len(beliefs) == len(graph.spans)


def test_query_counts_and_digests(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_skip_chain_privacy"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in EXPRESSIONS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, r.spans.split(",")))
        assert all(int(s.split(":")[1]) < int(s.split(":")[2]) for s in filter(None, r.spans.split(",")))


def _corpus():
    chance, rows = random.Random(2), []
    for i in range(120):
        phone = f"+1 ({chance.randint(200, 999)}) 555-{chance.randint(1000, 9999)}"
        middle = [phone, f"joan.{i}@mail{i % 9}.example.com", f"{chance.randint(1, 255)}.4.{i}.9", "Version 3.1 of 2019-2020, page 12"][i % 4]
        rows.append((i, f"{prose(i, 20).translate(str.maketrans('', '', '0123456789'))} {middle} thus ends"))
    return rows


def test_mentions_share_a_label(spark):
    rows = _corpus()
    spoken = [
        (1000, "Ask +1 (988) 555-2485 today. Later 988-555-2485 rang, and 9885552485 too."),
        (1001, "Write to joan.mir82@mail.example.com; joan.mir82 answers."),
        (1002, "reach me: jo.li[at]mail.example.com"),
        (1003, "tel: 0171 555 24851 or fax 988.555.2485"),
        (1004, "ordered 4041894974608796 on 2019-2020, build 300.1.2.3, room 555-2485, 17 of 2024"),
        (1005, "é ü +1 (988) 555-2485 ß 988.555.2485"),
    ]
    found = {r.doc_id: r.spans for r in personal_data.found_spans(documents(spark, rows + spoken)).collect()}
    text = dict(spoken)

    def own(i):
        return [(s["kind"], text[i][s["start"] : s["end"]]) for s in found[i] if not s["base"]]

    assert own(1000) == [("phone", "988-555-2485"), ("phone", "9885552485")]
    assert own(1001) == [("email", "joan.mir82")]
    assert own(1002) == [("email", "jo.li[at]mail.example.com")]
    assert ("phone", "988.555.2485") in own(1003) and own(1004) == [] and own(1005) == [("phone", "988.555.2485")]
    assert not any(not s["base"] for i, _ in rows for s in found[i])
    shown = documents(spark, spoken).join(spark.createDataFrame(list(found.items()), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"), "doc_id")
    red = {r.doc_id: r.t for r in shown.select("doc_id", personal_data.redacted("text", "spans").alias("t")).collect()}
    assert red[1001] == "Write to [EMAIL]; [EMAIL] answers." and red[1005] == "é ü [PHONE] ß [PHONE]"


def test_odd_rows(spark):
    rows = [(None, None), (1, None), (1, ""), (2, "+1 (988) 555-2485"), (2, "+1 (988) 555-2485"), (3, "x " * 700_000 + "a@b.cd")]
    got = sorted(((r.doc_id or -1, [tuple(s) for s in r.spans]) for r in personal_data.found_spans(documents(spark, rows)).collect()))
    assert got == [(-1, []), (1, []), (1, []), (2, [("phone", 0, 17, True)]), (2, [("phone", 0, 17, True)]), (3, [("email", 1_400_000, 1_400_006, True)])]
    assert personal_data.found_spans(documents(spark, [])).count() == 0


def test_messages_equal_enumeration_on_a_tree():
    text = b"call 5551234567 +19885552485 then 19885552485 9885552485"
    graph = Graph(text, pattern_spans(text))
    graph.chain = []
    field = personal_data.trained([])
    got = field.beliefs(graph, 60)
    unary = field.unary(graph.traits)
    for i, label in enumerate(graph.label):
        if label:
            unary[i] = -30
            unary[i, label] = 0
    graph.groups = graph.groups[:1] if len(graph.groups) > 1 else graph.groups
    got = field.beliefs(graph, 60)
    n, k = unary.shape
    weight = np.exp(unary[0])
    total = np.zeros((n, k))
    (long, nodes), = graph.groups
    agree = field.agree[0 if long else 1]
    for combination in np.ndindex(*[k] * n):
        base = sum(unary[i, y] for i, y in enumerate(combination))
        hub = sum(np.exp(agree * sum(combination[i] == h for i in nodes)) for h in range(k))
        for i, y in enumerate(combination):
            total[i, y] += np.exp(base) * hub
    assert weight.shape == (k,) and np.allclose(got, total / total.sum(1, keepdims=True), atol=1e-6)
    assert {EMAIL, CARD, PHONE} == {1, 3, 4}
