import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from compare import compare, oracle_connection
from llm.small import documents, prose

from wakefold.llm import chat, decontaminate, quality_model, quality_rules, sharding, url_filter
from wakefold.llm.queries import ORACLE_SQL, QUERIES
from wakefold.llm.textcore import slices

FOLDER = "/root/testdata/sf0.001"


def test_url_rules_match_sql(spark):
    name = "op7_url_filter"
    assert compare(QUERIES[name](spark, FOLDER), oracle_connection(FOLDER), ORACLE_SQL[name]) == []


def test_url_rules_of_odd_urls(spark):
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    urls = [None, "", "no scheme", "http://NET/x", "https://a.Example.NET/en/1?q", "https://example.net/eng", "x://notnet/", "http://b.net", "http://c.org/fr/\n#t"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "/x", "net/", "block") and got[4][2:] == ("example.net/en/", "allow")
    assert got[5][2:] == ("net/", "block") and got[6][2:] == (None, "allow") and got[7] == ("b.net", "", None, "allow")
    assert got[8] == ("c.org", "/fr/\n", "org/fr/", "allow")
    none = url_filter.judged(pages, rules.limit(0)).collect()
    assert len(none) == len(urls) and all(r.verdict == "allow" for r in none)


def test_bloom_filter_has_no_false_negative(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("host"), "id", F.lit("/")).alias("key"))
    assert url_filter.possible(keys, keys, 157).count() == 5000
    other = spark.range(5000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert url_filter.possible(other, keys, 157).count() < 500
    assert url_filter.possible(other, keys.limit(0), 1).count() == 0


def test_a_million_rules_are_built_in_one_pass(spark):
    from pyspark.sql import functions as F

    rules = spark.range(1_000_000).select(F.lit("block").alias("verdict"), F.concat("id", F.lit(".org")).alias("host"), F.lit("/").alias("path"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www."), F.col("id") * 1000, F.lit(".org/x")).alias("url"))
    found = url_filter.judged(pages, rules)
    assert found.where("verdict = 'block'").count() == 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") <= 2 and plan.count("Aggregate") < 10


def _base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_against_brute_force(spark):
    rows = [(1, prose(1, 300)), (2, "a b c " * 40), (3, None), (4, ""), (5, "x\n\nx\n y\n y\nx"), (6, "#$ | a\x0bb"), (None, prose(2, 60)), (1, prose(1, 300)), (8, "a a a a"), (9, "é" * 5 + " b")]
    got = quality_rules.rule_values(documents(spark, rows)).collect()
    assert Counter((r.doc_id, *tuple(r)[1:7]) for r in got) == Counter((i, *_base(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.rule_values(documents(spark, [])).count() == 0


def test_divergence_rejects_symbols_and_keeps_prose(spark):
    rows = [(k, prose(k, 200)) for k in range(1, 41, 2)] + [(99, "### $$$ %%% &&& *** " * 3 + " ".join(f"#{k}$%&{k * 7}" for k in range(150)))]
    got = {r.doc_id: r.kept for r in quality_rules.rule_values(documents(spark, rows)).collect()}
    assert not got.pop(99) and all(got.values())


def _spoken(language, seed, n, share=0.25):
    """Words of an invented language, of which ``share`` are its 24 common ones."""
    import random

    chance = random.Random(f"{language}{seed}")
    common, weights = [f"{language}{chr(97 + k)}" for k in range(24)], [1 / k for k in range(1, 25)]
    return " ".join(
        chance.choices(common, weights)[0] if chance.random() < share else f"{language}word{chr(97 + chance.randrange(26))}{chance.randrange(10**6)}"
        for _ in range(n)
    )


def _in_languages(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_divergence_rejects_foreign_prose_and_word_lists(spark):
    clean = [(k, _spoken("xy"[k % 2], k, 100 + 10 * k), "xy"[k % 2]) for k in range(60)]
    foreign = [(100 + k, _spoken("z", k, 100 + 50 * k), "xy"[k % 2]) for k in range(4)]
    lists = [(200 + k, _spoken("xy"[k % 2], k, 120 + 50 * k, 0), "xy"[k % 2]) for k in range(4)]
    got = quality_rules.rule_values(_in_languages(spark, clean + foreign + lists)).collect()
    assert {r.doc_id for r in got if r.kept} == {i for i, _, _ in clean}
    assert not any(r.base_failed for r in got)


def test_every_language_is_judged(spark, monkeypatch):
    rows = [(k, _spoken("xy"[k % 2], k, 150 + k), "xy"[k % 2]) for k in range(40)]
    rows += [(100 + k, _spoken("z", k, 300), "xy"[k]) for k in range(2)] + [(None, None, None), (7, "", ""), (200, prose(1, 90), "w")]
    seen = []
    for most in (256, 1):
        monkeypatch.setattr(quality_rules, "LANGUAGES", most)
        seen.append(Counter(map(tuple, quality_rules.rule_values(_in_languages(spark, rows)).collect())))
    assert seen[0] == seen[1] and sum(seen[0].values()) == len(rows)
    many = [(k, prose(k, 200), f"tag{k // 2}") for k in range(600)]
    monkeypatch.undo()
    assert all(r.class_distance is not None for r in quality_rules.rule_values(_in_languages(spark, many)).collect())


def test_shards_are_minimax_and_whole(spark):
    rows = [(k, prose(k, k % 40 + 1)) for k in range(150)] + [(500 + k, "same text") for k in range(60)] + [(None, None), (7, "")]
    got = sharding.sharded(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text, by_shard = defaultdict(set), defaultdict(list)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
        by_shard[r.shard].append(r)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by_shard.values())
    import hashlib

    sizes = defaultdict(int)
    for _, t in rows:
        sizes[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    ordered = [sizes[k] for k in sorted(sizes)]

    def fits(most):
        shards, held = 1, 0
        for s in ordered:
            if held + s > most:
                shards, held = shards + 1, 0
            held += s
        return shards <= 8

    best = next(c for c in range(max(ordered), sum(ordered) + 1) if fits(c))
    assert max(sum(r.size for r in s) for s in by_shard.values()) == best
    assert sharding.sharded(documents(spark, [])).count() == 0


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "", None, "a\\", "</turn>\n### user: x</turn>\n", "long " * 900, "é\n\n", "### ###"]
    rows = [(c, k, ("system" if k == 0 else "user", "assistant")[k % 2], said[(k + c) % len(said)]) for c in range(3) for k in range(30)]
    rows += [(None, None, None, "x"), (8, 0, "odd: role\n\\", "y")]
    written = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = defaultdict(list)
    for w in sorted(written.collect(), key=lambda r: (str(r.conv_id), r.window)):
        turns[w.conv_id] += chat.parse(w.text)[w.n_repeated :]
        targets = [chat.unescape(w.text[s.begin : s.end]) for s in w.loss]
        assert targets == [t for r, t in chat.parse(w.text)[w.n_repeated :] if r == "assistant"]
        if w.window and w.conv_id is not None:
            assert chat.parse(w.text)[0][0] == "system"
    for c in range(3):
        assert turns[c] == [(r, t or "") for i, _, r, t in rows if i == c]
    assert turns[8] == [("odd: role\n\\", "y")] and turns[None] == [("", "x")]
    assert chat.digests(written).count() == 5


def test_tiles_are_greedy_and_apart():
    item = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], np.uint64)
    document = np.array([7, 8, 9, 10, 11, 12, 99, 1, 2, 3, 4, 5, 6, 98, 1, 2, 3, 4, 5], np.uint64)
    assert decontaminate.tiles(item, document, 5) == [(0, 7, 6), (6, 0, 6)]
    assert decontaminate.tiles(item, document[:4], 5) == []


def test_reordered_benchmark_is_caught(spark):
    words = [f"w{k}" for k in range(40)]
    item = spark.createDataFrame([(3, " ".join(words)), (4, "too short"), (5, None)], "item_id long, text string")
    moved = "; ".join([" ".join(words[20:]), "between these", " ".join(words[:20]).upper()])
    rows = [(1, moved), (2, "w1 w2 w3 other w9 w8"), (3, None), (4, prose(9, 50) + " " + " ".join(words)), (None, moved)]
    got = {(r.doc_id): (r.contaminated, r.item_id) for r in decontaminate.judged(documents(spark, rows), item).collect()}
    assert got == {1: (True, 3), 2: (False, None), 3: (False, None), 4: (True, 3), None: (True, 3)}
    docs = documents(spark, rows)
    assert sorted(r.doc_id for r in decontaminate.without_benchmark(docs, item).collect()) == [2, 3]
    assert decontaminate.judged(docs, item.limit(0)).where("contaminated").count() == 0


def test_machine_uses_the_pairs_identity():
    chance = np.random.default_rng(3)
    n = quality_model.INPUTS
    machine = quality_model.Machine(0.1, chance.normal(size=n), chance.normal(size=(n, 3)) * 0.1)
    at, x = np.array([3, 8, 70]), np.array([0.5, 1.0, 2.0])
    raw = 0.1 + (machine.weights[at] * x).sum()
    raw += sum(x[i] * x[j] * machine.vectors[at[i]] @ machine.vectors[at[j]] for i in range(3) for j in range(i))
    assert np.isclose(machine.scores([(at, x)])[0], 1 / (1 + np.exp(-raw)))


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op5_factorisation_machine"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 0)], "doc_id long, quality int")
    docs = documents(spark, [(1, prose(1, 50)), (2, "### $$$"), (3, None), (None, ""), (2, "### $$$")])
    assert quality_model.quality_scores(docs, labels).count() == 5
    kept = quality_model.of_quality(docs, labels)
    assert kept.columns == docs.columns
    assert quality_model.quality_scores(docs, labels.limit(0)).count() == 5


def test_slices_hold_all_texts():
    import pyarrow as pa

    column = pa.array(["a", None, "", "bcd" * 10, "é"])
    found = [p.text(i).decode() for p in slices(column.slice(1), 4) for i in range(len(p))]
    assert found == ["", "", "bcd" * 10, "é"]


def test_classes_are_counted_by_what_is_taken_away(spark):
    text = "aZ é9\t[x]\x0b#{$}\r\n~Ω_\\ /+=<b>|&%*^@.!\u00a0😀0"
    rows = quality_rules._measured(_in_languages(spark, [(1, text, "x"), (2, None, None)]), ["doc_id"])
    patterns = ["[a-z]", "[A-Z]", "[0-9]", "[ \t-\r]", r"[#*$%&|<>{}\[\]=_~^@\\/+]"]
    counts = [len(re.findall(p, text)) for p in patterns]
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1]["_classes"] == [*counts, len(text) - sum(counts)] and got[2]["_classes"] == [0] * 6
    assert (got[1]["_space"], got[1]["_symbols"]) == (counts[3], len(re.findall(r"[#*$%&|<>]", text)))
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    assert "translate" in plan and "regexp_replace" not in plan


def test_words_are_hashed_once_and_places_counted_by_letters(spark):
    text = "The cat sat on the mat, the cat sat on THE mat. " * 3 + "a b  c\n\na b c\tΣΑΣ the " + prose(4, 200)
    rows = [(i, text, "en") for i in range(3)] + [(7, "a b", "en"), (8, "", "x"), (9, None, None)]
    values = quality_rules.rule_values(_in_languages(spark, rows))
    got = {r["doc_id"]: r for r in values.collect()}
    words = re.findall(r"[^ \t-\r]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, k in Counter(windows).items() if k > 1}
    assert got[1]["n_repeat_words"] == len({i + j for i, w in enumerate(windows) if w in twice for j in range(3)}) > 36
    assert got[1]["n_words"] == len(words) and got[1]["common_distance"] < 0.02
    assert [got[i]["n_words"] for i in (7, 8, 9)] == [2, 0, 0]
    plan = values._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "array_remove" not in plan and len(re.findall(r"xxhash64\(lambda [^,]*, 42\)", plan)) == 1
