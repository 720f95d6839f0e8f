import math
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.small import documents, prose

from wakefold.llm.encoding import Encoder, vocabulary_path
from wakefold.llm.packing import packed, plan_patterns
from wakefold.llm.token_store import build_index, find_slots, lookup, read_documents, write_store
from wakefold.llm.textcore import U64, mix
from wakefold.sources import shared

BYTE = Encoder(vocabulary_path("byte_bpe_50k.json"), False)
WORD = Encoder(vocabulary_path("word_bpe_49k.json"), True)
ROWS = [(5, prose(1, 900)), (2, None), (9, ""), (2, "twice <|endoftext|>"), (None, "no id"), (7, prose(2, 5000)), (11, "日本 text")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'srtvemldZ019 ².,-\n\t\x1f\x85\xa0éÉßÿſμª<|endoftext|>İ你", max_size=30), max_size=5))
def test_pieces_give_the_library_ids(texts):
    for encoder in (BYTE, WORD):
        assert [e.tobytes() for e in encoder.encode_all(texts)] == encoder._library(texts)


def test_each_piece_is_merged_once_and_alone(monkeypatch):
    for name, lower in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        encoder, whole, merged = Encoder(vocabulary_path(name), lower), [], []
        texts = [prose(3, 400), "É\u00a0ß Ȿx", None, "", prose(3, 400), "It's 12\n  x\t", "aȺ Ⱦ!b", "b\u212a \u2003c"]
        want = encoder._library([t or "" for t in texts])
        merge, library = encoder.known.merge, encoder._library
        encoder.known.merge = lambda piece: merged.append(piece) or merge(piece)
        monkeypatch.setattr(encoder, "_library", lambda t: whole.extend(t) or library(t))
        assert [e.tobytes() for e in encoder.encode_all(texts)] == want
        assert len(merged) == len(set(merged)) > 30 and prose(3, 400) not in whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_patterns_use_every_length_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    used, sequences = np.zeros(65, int), 0
    for pattern, times in plan_patterns(counts, 64):
        assert sum(k * m for k, m in pattern.items()) <= 64
        sequences += times
        for k, m in pattern.items():
            used[k] += m * times
    assert (used == counts).all() and sequences >= math.ceil(sum(lengths) / 64)


def test_exact_complements_reach_the_bound():
    counts = np.zeros(65, int)
    counts[[40, 24, 10, 14, 8, 6, 10]] = 100
    assert sum(t for _, t in plan_patterns(counts, 64)) == math.ceil(sum(i * int(n) for i, n in enumerate(counts)) / 64)


def test_packed_pieces(spark):
    rows = packed(documents(spark, ROWS)).collect()
    want = []
    for i, t in ROWS:
        ids = np.append(WORD.encode(t), 1).astype("<u4")
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packed(documents(spark, [])).count() == 0


def test_perfect_index():
    for n in (1, 2, 3, 50, 3000):
        hashes = mix(np.arange(n, dtype=U64))
        displacements, slot = build_index(hashes)
        assert sorted(slot.tolist()) == list(range(n))
        assert (find_slots(hashes, displacements, n) == slot).all()


def test_store_round_trip(spark):
    path = shared.new_path(spark, "store")
    write_store(documents(spark, ROWS), path)
    got = read_documents(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(i for i, _ in ROWS if i is not None)
    want = sorted((i, zlib.crc32(np.append(BYTE.encode(t), 2).astype("<u4").tobytes())) for i, t in ROWS if i is not None)
    assert sorted((r.doc_id, r.ids_crc32) for r in got[1:]) == want
    wanted = spark.createDataFrame([(7,), (9,), (1000,)], "doc_id long")
    found = {r.doc_id: r.ids for r in lookup(spark, path, wanted).collect()}
    assert found == {7: [*BYTE.encode(ROWS[5][1]).tolist(), 2], 9: [2]}
    empty = shared.new_path(spark, "store")
    write_store(documents(spark, []), empty)
    assert read_documents(spark, empty).count() == 0


def test_lookup_of_ids_far_apart(spark, tmp_path):
    ids = [1, 2**60, -(2**62), 2**62, 5, 2**40 + 3]
    path = str(tmp_path / "far")
    write_store(documents(spark, [(i, f"text {i}") for i in ids] + [(5, "again")]), path)
    wanted = spark.createDataFrame([(i,) for i in [*ids, 7, 2**59, None]], "doc_id long")
    assert {r.doc_id for r in lookup(spark, path, wanted).collect()} == set(ids)


def test_payloads_are_not_shuffled(spark, tmp_path):
    write_store(documents(spark, ROWS), str(tmp_path / "store"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = read_documents(spark, str(tmp_path / "store"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
