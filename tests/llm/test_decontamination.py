import random
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sectorlake.llm import decontamination
from tests.llm.fixtures import SCHEMA, odd_texts, row, words


def greedy(item, doc, least):
    free_i, free_d, found = [True] * len(item), [True] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_i[i + n] and free_d[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return sorted(found)
        i, j, n = best
        free_i[i : i + n], free_d[j : j + n] = [False] * n, [False] * n
        found.append(best)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=18), st.lists(st.integers(0, 3), max_size=24), st.integers(1, 4))
def test_tiles_are_greedy(item, doc, least):
    code = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert decontamination.tiles(code(item), code(doc), least) == greedy(item, doc, least)


def bare(text):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(words(400 + i, rng.randint(8, 40)))) for i in range(12)] + [(50, "Two words."), (51, None), (52, "..."), (53, "one two three four five")]
    rows = [r for r in odd_texts() if r[0] is not None and len(r[1] or "") < 3000]
    for i in range(60):
        w = items[rng.randrange(12)][1].split()
        cut = rng.randrange(len(w))
        passage = rng.choice([w, w[cut:] + w[:cut], w[: cut + 1], w[::-1]])
        rows.append(row(100 + i, " ".join(words(i, 10)) + " " + rng.choice([" ", ", "]).join(passage).capitalize() + "! " + " ".join(words(i + 1, rng.randint(0, 9)))))
    rows += [row(300, "There were two WORDS, here"), row(301, "one two three four five six")]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id bigint, text string, hash string")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"], r["longest_tile"]) for r in decontamination.contaminated_pairs(docs, bench).collect()}
    want = {}
    for r in rows:
        for i, t in items:
            a, b = bare(t), bare(r[1])
            tiles = greedy(a, b, min(5, len(a))) if a else []
            if a and sum(x[2] for x in tiles) >= 0.8 * len(a):
                want[r[0], i] = (sum(x[2] for x in tiles) / len(a), len(tiles), max(x[2] for x in tiles))
    assert got == want and any(v[1] > 1 for v in want.values())
    small = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated_pairs(docs, bench, block_bytes=300).collect()}
    assert small == set(want)
    for size in (1 << 22, 300):
        clean = decontamination.decontaminate(docs, bench, block_bytes=size)
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in rows if r[0] not in {d for d, _ in want})


def test_repeated_words_take_no_pair_list():
    began = time.time()
    same = lambda n: np.full(n, 12345, np.uint64)
    assert decontamination.tiles(same(1000), same(100_000), 5) == [(0, 0, 1000)]
    assert decontamination.tiles(same(100_000), same(1000), 5) == [(0, 0, 1000)]
    two = np.resize(np.array([7, 7, 9], np.uint64), 1000)
    made = decontamination.tiles(two, np.resize(np.array([9, 7], np.uint64), 100_000), 2)
    assert sum(t[2] for t in made) > 600
    assert time.time() - began < 20


def test_null_ids_long_texts_and_repeated_items(spark):
    item = " ".join(words(31, 40))
    spam = "buy " * 60_000
    rows = [row(None, "intro " + item), row(None, item), row(7, " ".join(words(5, 30_000)) + " " + item), row(7, "x"), row(8, spam), row(9, None)]
    items = [(1, item), (1, item), (None, item), (2, "buy " * 300), (3, spam), (4, None)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1 << 22, 200):
        got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.contaminated_pairs(docs, bench, block_bytes=size).collect())
        assert got == Counter({(None, 1): 4, (None, None): 2, (7, 1): 2, (7, None): 1, (8, 2): 1, (8, 3): 1})
        assert sorted(str(r["text"])[:9] for r in decontamination.decontaminate(docs, bench, block_bytes=size).collect()) == ["None", "x"]


def test_empty(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contaminated_pairs(docs, bench).count() == 0
    some = spark.createDataFrame(odd_texts(), SCHEMA)
    assert decontamination.contaminated_pairs(some, bench).count() == 0
    assert decontamination.decontaminate(some, bench).count() == len(odd_texts())
