import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.small import documents, prose

from wakefold.llm import near_dedup, suffix_dedup
from wakefold.llm.near_dedup import near_duplicates, without_near_copies
from wakefold.llm.suffix_dedup import (
    HOT, SEED, _contexts, common_prefix, deep_shallow_sort, removed_bytes, repeated_offsets, without_repeats,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=8).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=12), st.integers(0, 5))
def test_deep_shallow_sort(strings, shallow):
    order, common = deep_shallow_sort(strings, 0, shallow)
    assert [strings[i] for i in order] == sorted(strings)
    assert all(common[k] == common_prefix(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))


@pytest.mark.parametrize("n", [2, 3, 7, 40, 120])
def test_repeated_offsets_against_all_pairs(n):
    random.seed(n)
    core = bytes(random.choices(b"ab", k=160))
    members = {}
    for _ in range(n):
        left = (core[: random.randint(0, 150)] + bytes(random.choices(b"ab", k=160)))[: random.randint(0, 152)]
        right = b"s" * SEED + core[::-1][: random.randint(0, 150)] + bytes(random.choices(b"ab", k=260))
        members[left, right[: max(SEED, 200 + random.randint(0, 152) - len(left))]] = random.choice([1, 1, 1, 2])
    members = [(*sides, copies) for sides, copies in members.items()]
    for (left, right, copies), ranges in zip(members, repeated_offsets(members, 200), strict=True):
        others = [(l, r) for l, r, _ in members if (l, r) != (left, right)] + [(left, right)] * (copies > 1)
        wanted = {
            o
            for l, r in others
            for o in range(max(0, 200 - common_prefix(right, r)), common_prefix(left, l) + 1)
        }
        assert {o for low, high in ranges for o in range(low, high + 1)} == wanted


def _cut(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [HOT, 2, 0])
def test_removed_bytes_against_brute_force(spark, hot):
    a, b, c = prose(1, 120), prose(2, 150), prose(3, 90)
    rows = [(1, a), (2, a), (3, b + "é" + a[50:400] + c), (4, c[:260] + prose(4, 60) + b[100:420]), (5, None), (6, "")]
    rows += [(None, prose(5, 80)), (7, "ab" * 300), (8, "x" * 199), (9, prose(6, 30)), (9, a), (9, a), (None, "x" * 199)]
    rows += [(10 + k, prose(20 + k, 25) + b[:300] + prose(40 + k, 25)) for k in range(6)]
    docs = documents(spark, rows)
    got = sorted((tuple(r) for r in removed_bytes(docs, hot=hot).collect()), key=str)
    assert got == _cut(rows)
    cut = without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_passage_that_many_documents_share_is_split_alike(spark):
    common = prose(1, 60)
    rows = [(k, prose(100 + k, 12) + common[k % 3 :] + prose(300 + k, 12)) for k in range(60)]
    got = sorted((tuple(r) for r in removed_bytes(documents(spark, rows), hot=10).collect()), key=str)
    assert got == _cut(rows)


def test_removed_bytes_of_empty_table(spark):
    assert removed_bytes(documents(spark, [])).count() == 0


def _near(rows, words=4, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                up[root(x)] = root(y)
    least = defaultdict(lambda: 10**9)
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min(least[root(x)], i)
    return {i: (len(sets[x]), least[root(x)]) for x, (i, _) in enumerate(rows)}


def test_near_duplicates_against_brute_force(spark):
    chance = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one Two"), (5, "ONE two"), (6, "one two three"), (7, "a b c d"), (8, "a b c D")]
    n = 100
    for family in range(8):
        base = prose(100 + family, 80).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(chance.randint(0, 5)):
                copy[chance.randrange(len(copy))] = f"w{chance.randint(0, 9999)}"
            rows.append((n, " ".join(copy)))
            n += chance.randint(1, 3)
    chance.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows), words=4).collect()}
    assert got == _near(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f")]
    got = sorted((tuple(r) for r in near_duplicates(documents(spark, rows)).collect()), key=str)
    want = [(3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (None, 2, None, True), (None, 2, None, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [300])
def test_large_bucket_is_one_component(spark, n):
    base = prose(7, 120).split()
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(n)]
    assert {r.component_id for r in near_duplicates(documents(spark, rows)).collect()} == {0}


def test_large_group_of_copies_against_brute_force(spark, monkeypatch):
    """400 copies of one text, 0.8 to 0.9 alike with it, less with each other; the text itself is the last."""
    chance = random.Random(9)
    base = prose(11, 260).split()

    def copy(changes):
        words = list(base)
        for k in chance.sample(range(0, 260, 5), changes):
            words[k] = f"c{chance.randint(0, 10**6)}"
        return " ".join(words)

    rows = [(k, copy(chance.randint(3, 7))) for k in range(400)] + [(1000, " ".join(base))]
    rows += [(2000 + k, copy(12)) for k in range(60)] + [(3000 + k, prose(300 + k, 60)) for k in range(30)]
    want = _near(rows)
    sizes = Counter(c for _, c in want.values())
    assert max(sizes.values()) >= 400 and len(sizes) > 30
    for block in (1000, 50):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows), words=4).collect()}
        assert got == want


def test_cells_give_at_most_one_link_a_member():
    import numpy as np

    chance = np.random.default_rng(2)
    for n in (1, 2, 50):
        sets = [np.unique(chance.integers(0, 300, 200).astype(np.uint64)) for _ in range(n)]
        both = near_dedup._common(sets)
        assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)
        assert len(near_dedup._joined(np.ones((n, n), bool), np.arange(n))) == n - 1
        assert near_dedup._joined(np.ones((n, n), bool), np.zeros(n, int)) == []


def test_rows_that_share_an_id_are_not_copies(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(1, a), (1, b), (1, b), (2, b + " end"), (3, c), (4, c.upper()), (None, c), (None, c), (5, ""), (5, None), (6, a)]
    got = without_near_copies(documents(spark, rows))
    assert got.columns == documents(spark, []).columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter([(1, a), (1, b), (3, c), (None, c), (None, c), (5, ""), (5, None)])
    assert without_near_copies(documents(spark, [])).count() == 0


def test_places_of_a_context_are_joined_as_one_row(spark):
    shared = prose(3, 80)
    rows = [(k, f"{prose(50 + k, 30)} {shared} {prose(500 + k, 30)}") for k in range(40)]
    texts = pa.record_batch(
        [pa.array([i for i, _ in rows]), pa.array([0] * 40), pa.array([t.encode() for _, t in rows])], names=["k1", "k2", "text"]
    )
    begin = [t.index(shared) + 200 for _, t in rows]
    places = pa.array([[{"place": b << 16, "hash": 7, "hot": False}] for b in begin])
    found = list(_contexts(200, False)(iter([texts.append_column("places", places)])))
    assert sum(b.num_rows for b in found) == 1
    assert [(p["k1"], p["at"]) for p in found[0].column(2)[0].as_py()] == list(enumerate(begin))
    for hot in (HOT, 10):
        assert sorted((tuple(r) for r in removed_bytes(documents(spark, rows), hot=hot).collect()), key=str) == _cut(rows)


def test_places_that_a_text_has_of_a_context_stay_together(spark, monkeypatch):
    line = prose(3, 20) + "\n"
    rows = [(k, prose(50 + k, 30) + line * (100 + k) + prose(500 + k, 30)) for k in range(6)] + [(9, None), (None, line * 60)]
    text = rows[0][1].encode()
    begins = [text.index(line.encode()) + k * len(line) for k in range(50)]
    batch = pa.record_batch(
        [
            pa.array([0, 0]), pa.array([5, 6]), pa.array([text] * 2),
            pa.array([[{"place": b << 16, "hash": 7, "hot": False} for b in begins]] * 2),
        ],
        names=["k1", "k2", "text", "places"],
    )
    (found,) = _contexts(200, False)(iter([batch]))
    assert found.column(2).to_pylist() == [[{"k1": 0, "k2": k, "at": begins[0], "more": begins[1:]} for k in (5, 6)]]
    monkeypatch.setattr(suffix_dedup, "SAME", 30)
    (found,) = _contexts(200, False)(iter([batch]))
    cut = [[1 + len(t["more"]) for t in row] for row in found.column(2).to_pylist()]
    assert sum(map(sum, cut)) == 100 and all(sum(row) <= 30 for row in cut)
    monkeypatch.undo()
    wanted = _cut(rows)
    for hot in (HOT, 10):
        assert sorted((tuple(r) for r in removed_bytes(documents(spark, rows), hot=hot).collect()), key=str) == wanted
