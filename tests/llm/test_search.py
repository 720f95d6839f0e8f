"""Source audit and ranked search against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from compare import compare, oracle_connection

from wakefold.llm import lexical, source_audit
from wakefold.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, item_id long, rank int, score long"


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3, 4) for i, t, lang, s in rows], SCHEMA)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_both_match_sql(spark):
    for name in ("op11_source_skyband", "op13_shared_ranking"):
        assert compare(QUERIES[name](spark, FOLDER), oracle_connection(FOLDER), ORACLE_SQL[name]) == [], name


def _audit(rows, least, first):
    n, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))
        n[lang, source].update(words)
        held[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for w, k in held[lang].items() if k >= least), key=lambda w: w.encode())
        whole = {w: sum(n[lang, s][w] for s in sources) for w in kept}

        def shares(count, kept=kept):
            size = sum(count[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 5) // size for w in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(t, sum(abs(p[s][w] - p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if n[lang, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, first)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, w, v, i + 1) for i, (w, v) in enumerate(ordered)]
    return sorted(out)


def test_audit_against_brute_force(spark, monkeypatch):
    chance = random.Random(3)
    words = [a + b for a in "abçDé" for b in "xyz日"] + ["don't", "A1b", "z_z"]
    rows = []
    for i in range(240):
        own = chance.choices(words, [1 / (1 + k) for k in range(len(words))], k=chance.randint(0, 30))
        rows.append((i // 2, chance.choice(" ,\n").join(own), chance.choice(["en", "de", None]), chance.choice(["s1", "s2", "s3", None])))
    rows += [(7, None, "en", "lone"), (None, "", "xx", "a"), (None, "rare", "xx", "b"), rows[0], rows[0], (1, "long " * 300_000, "en", "s1")]
    documents = _documents(spark, rows)
    want = _audit(rows, 10, 4)
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", 5)
    monkeypatch.setattr(source_audit, "_CELLS", 8)
    monkeypatch.setattr(source_audit, "_HELD", 40)
    got = source_audit.audited(documents, 10, 4).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == want
    assert {r[0] for r in want} == {"en", "de", "", "xx"} and any(r[2] == "term" for r in want)
    assert source_audit.audited(_documents(spark, [])).count() == 0


def test_skyband_holds_every_first():
    chance = np.random.default_rng(5)
    for size in (0, 1, 40, 1500):
        terms = [b"%d" % x for x in chance.permutation(size)]
        n, whole = chance.integers(0, 12, size), chance.integers(0, 12, size)
        kept = set(source_audit.skyband(terms, n, whole, 3).tolist())
        for i in range(size if size < 100 else 100):
            dominators = sum(n[j] >= n[i] and whole[j] <= whole[i] and terms[j] < terms[i] for j in range(size))
            assert (i in kept) == (dominators < 3)


def _ranked(rows, items, first):
    cut = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    docs = [(i, Counter(re.findall(cut, _lower(t)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    terms = defaultdict(set)
    for item, text in items:
        terms[item].update(re.findall(cut, _lower(text)))
    n, total = len(docs), sum(c.total() for _, c in docs)
    held = Counter(w for _, c in docs for w in c)
    out = []
    for item, words in terms.items():
        scores = []
        for i, c in docs:
            m = 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:first])]
    return Counter(out)


def test_ranking_against_brute_force(spark):
    chance = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "日本", "A9"]

    def text(n):
        return chance.choice([" ", ",", "\x00"]).join(chance.choices(words, [1 / (1 + k) for k in range(len(words))], k=n))

    rows = [(i // 3 if i % 50 else None, text(chance.randint(0, 40)), "en", "s") for i in range(300)]
    rows += [(900 + i, rows[5][1], "en", "s") for i in range(40)] + [(1, None, None, None), (2, "", "", ""), (3, "w1 " * 400_000, "en", "s")]
    items = [(i // 2, text(12)) for i in range(40)] + [(50, "absent"), (51, None), (None, "w3 w4"), (52, ""), (53, items_text := text(20)), (54, items_text)]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id long, score long")
    want = _ranked([r[:2] for r in rows], items, 7)
    for block_terms in (1 << 18, 60):
        got = lexical.ranked_documents(_documents(spark, rows), bench, 7, block_terms).select("item_id", "rank", "doc_id", "score")
        assert Counter(map(tuple, got.collect())) == want
    assert lexical.ranked_documents(_documents(spark, []), bench).count() == 0
    assert lexical.ranked_documents(_documents(spark, rows), bench.limit(0)).count() == 0


def test_shared_sums_equal_plain_sums_and_share():
    chance = random.Random(6)
    items = [sorted(chance.sample(range(60), chance.randint(0, 25))) for _ in range(50)] + [list(range(30))] * 5 + [[]]
    shared = lexical.SharedSums(items, 60)
    values = np.random.default_rng(1).integers(0, 10**6, (60, 9))
    got = shared.sums(values)
    assert shared.filled == [i for i, x in enumerate(items) if x]
    assert all((got[k] == values[items[i]].sum(0)).all() for k, i in enumerate(shared.filled))
    assert shared.additions() < sum(len(x) - 1 for x in items if x)
