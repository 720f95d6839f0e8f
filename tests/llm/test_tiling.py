"""Greedy tiling against a plain one, long repeats, short items and scripts without blanks."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from llm.small import documents, prose

from wakefold.llm import decontaminate
from wakefold.llm.textcore import slices


def plain_tiles(item, document, least):
    free_item, free_doc, found = [True] * len(item), [True] * len(document), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(document)):
                n = 0
                while (
                    i + n < len(item) and j + n < len(document) and item[i + n] == document[j + n]
                    and free_item[i + n] and free_doc[j + n]
                ):
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return found
        i, j, n = best
        free_item[i : i + n] = [False] * n
        free_doc[j : j + n] = [False] * n
        found.append(best)


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_a_plain_greedy_tiling(seed):
    chance = random.Random(seed)
    letters, least = chance.choice([1, 2, 3, 20]), chance.randint(1, 5)
    item = [chance.randrange(letters) for _ in range(chance.randint(0, 30))]
    document = [chance.randrange(letters) for _ in range(chance.randint(0, 60))]
    if seed % 3 == 0:
        document = document[:20] + item[5:25] + document[20:] + item[:12]
    got = decontaminate.tiles(np.array(item, np.uint64), np.array(document, np.uint64), least)
    assert got == plain_tiles(item, document, least)


@pytest.mark.parametrize("sizes", [(200, 80_000), (5_000, 80_000), (80_000, 300)])
def test_one_token_repeated_ends_soon(sizes):
    item, document = (np.full(n, 7, np.uint64) for n in sizes)
    begin = time.monotonic()
    assert decontaminate.tiles(item, document, 5) == [(0, 0, min(sizes))]
    assert time.monotonic() - begin < 10


def test_repeating_pattern_ends_soon():
    item = np.array([1, 2, 3, 1, 2] * 200, np.uint64)
    document = np.array(([1, 2, 3, 1, 2] * 30 + [9]) * 600, np.uint64)
    begin = time.monotonic()
    found = decontaminate.tiles(item, document, 5)
    assert sum(t[2] for t in found) == len(item)
    assert time.monotonic() - begin < 20


def tokens_of(*texts):
    out = []
    for piece in slices(pa.array(texts, pa.string())):
        words = decontaminate.Tokens(piece)
        out += [words.hash[words.bounds[i] : words.bounds[i + 1]].tolist() for i in range(len(piece))]
    return out


def test_tokens_of_many_scripts():
    a, b, c, d, e, f = tokens_of("Ein Käse, «grün» — Ab9", "ein käse grün ab9", "これは 本。", "これは本", "", "😀 … ")
    assert a == [*b[:1], *b[1:]] and len(b) == 4
    assert c == d and len(d) == 4
    assert e == f == []
    mixed, apart = tokens_of("abc漢字def", "abc 漢 字 def")
    assert mixed == apart and len(mixed) == 4
    # ASCII texts give the plain runs of letters and digits.
    text = "a-b_c d9;;E  f\n\tg!" + prose(3, 40)
    assert len(tokens_of(text)[0]) == len(re.findall("[A-Za-z0-9]+", text))


def test_tokens_of_broken_bytes_do_not_fail():
    broken = pa.array([b"\xe4", b"abc \xf0\x9f", b"\x80 x", b"\xff\xff\xff\xff"], pa.binary())
    for piece in slices(broken):
        assert len(decontaminate.Tokens(piece).bounds) == 5


ROWS = [
    (1, "她说：今天天气很好，我们去公园散步吧。然后回家。"),
    (2, "今天没有下雨。"),
    (3, "The answer (so they say) is: forty-two! Always."),
    (4, "Is the answer forty two or not"),
    (5, None),
    (6, ""),
    (7, "ja " * 50_000),
]
ITEMS = [(1, "今天天气很好,我们去公园散步吧"), (2, "is forty two"), (3, None), (4, " ... "), (5, "ja " * 300)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_short_items_and_scripts_without_blanks(spark, block_bytes):
    docs = documents(spark, ROWS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.tiled_items(docs, items, block_bytes=block_bytes)
    got = {(r.item_id, r.tiled, r.item_tokens) for r in found.collect()}
    assert got == {(1, 14, 14), (2, 3, 3), (5, 300, 300)}
    ids = {r.doc_id for r in decontaminate.judged(docs, items).where("contaminated").collect()}
    assert ids == {1, 3, 7}
