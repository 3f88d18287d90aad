import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from sectorlake.llm import blocks, near_dedup
from sectorlake.llm.components import connected_components
from tests.llm.fixtures import SCHEMA, odd_texts, row, split, words


def shingle_set(text, k):
    w = split(text, lower=True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, k, threshold):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t, k))
    flat = [(i, s) for i, own in sets.items() for s in own]
    edges = []
    for x, (a, s) in enumerate(flat):
        for b, t in flat[:x]:
            if s and t and a != b and len(s & t) * threshold.denominator >= threshold.numerator * len(s | t):
                edges.append((a, b))
    return components(sets, edges)


@pytest.mark.parametrize(("k", "threshold"), [(3, Fraction(85, 100)), (5, Fraction(8, 10))])
def test_against_brute_force(spark, monkeypatch, k, threshold):
    for name in ("SMALL", "LARGE", "FEW"):
        monkeypatch.setattr(near_dedup.blocks, name, 8)
    rng = random.Random(k)
    rows = [r for r in odd_texts() if r[0] is not None]
    for g in range(6):  # groups of copies with ever more edits, on either side of the threshold
        base = words(50 + g, 60 + 40 * g)
        for c in range(14):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(len(text))] = rng.choice(words(c, 9))
            rows.append(row(1000 + 100 * g + c, " ".join(text)))
    rows += [row(5000 + i, " ".join(words(7000 + i, rng.randint(1, 9)))) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), k, threshold).collect()
    want = brute([(r[0], r[1]) for r in rows], k, threshold)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = sorted(r["n_shingles"] for r in got)
    assert sizes == sorted(len(shingle_set(r[1], k)) for r in rows)


def test_null_ids_and_empty(spark):
    rows = [row(None, "a b c d e f g"), row(9, "a b c d e f g"), row(None, "x y z x y z"), row(None, None)]
    got = {(r["n_shingles"], r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(3, None, 9, False), (3, 9, 9, True), (2, None, None, True), (0, None, None, True)}
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = near_dedup.deduplicate(spark.createDataFrame([*rows, row(9, "a b c d e f g"), row(10, "")], SCHEMA))
    assert kept.columns == spark.createDataFrame([], SCHEMA).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [9, 10]


def test_null_and_shared_ids_are_no_bridges(spark):
    a, b, c = (words(800 + i, 60) for i in range(3))
    changed = lambda w: " ".join([*w[:-1], "changed"])
    rows = [
        row(5, " ".join(a)), row(9, " ".join(b)), row(7, changed(a)), row(7, changed(b)), row(None, changed(a) + " x"), row(None, changed(b) + " x"),
        row(None, " ".join(c)), row(None, changed(c)), row(None, " ".join(c)), row(None, "no other is like this"), row(11, ""), row(None, ""), row(None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    want = [
        ("5", "5", True), ("9", "7", False), ("7", "5", False), ("7", "7", True), ("None", "5", False), ("None", "7", False),
        ("None", "None", True), ("None", "None", False), ("None", "None", False), ("None", "None", True), ("11", "11", True), ("None", "None", True), ("None", "None", True),
    ]
    assert got == sorted(want)
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicate(docs).collect()]
    assert sorted((str(i), str(t)) for i, t in kept if t not in (" ".join(c), changed(c))) == sorted(
        [("5", " ".join(a)), ("7", changed(b)), ("None", "no other is like this"), ("11", ""), ("None", ""), ("None", "None")]
    )
    assert sum(t in (" ".join(c), changed(c)) for _, t in kept) == 1


def test_large_block_by_matrix_products():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 4000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    left, right = np.arange(15), np.arange(15, 40)
    got = near_dedup._intersections(sets, left, right)
    assert all(got[i, j] == len(np.intersect1d(sets[a], sets[b])) for i, a in enumerate(left) for j, b in enumerate(right))


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 60_000).astype(np.uint64) << np.uint64(1)
    error = []
    for shared in (200, 600, 900):
        for t in range(30):
            own = pool[t * 2000 : t * 2000 + 2000]
            a, b = np.sort(own[:1000]), np.sort(own[1000 - shared : 2000 - shared])
            r = near_dedup.registers(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2)
            error.append(near_dedup.estimate(np.mean(r[0] == r[1]), 1000, 1000) - shared / (2000 - shared))
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.05


def test_short_sets_fill_all_registers():
    r = near_dedup.registers(np.array([5, 1 << 60], np.uint64), np.array([0, 0]), 2)
    assert set(r[0]) == {near_dedup.compress(np.array([5 << 7], np.uint64))[0], near_dedup.compress(np.array([(1 << 67) & ((1 << 64) - 1)], np.uint64))[0]}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)] + [(600, i) for i in range(601, 700)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    want = components({n for e in edges for n in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


@pytest.mark.parametrize("few", [2, 48])
def test_every_pair_of_a_group_meets_once(spark, monkeypatch, few):
    monkeypatch.setattr(blocks, "FEW", few)
    rows = spark.createDataFrame([(g, n, n % 4 == 0) for g, size in ((1, 23), (2, 1), (3, 9), (4, 130)) for n in range(size)], "g bigint, node bigint, open boolean")
    for rest in (None, "open"):
        dealt = blocks.deal_blocks(rows, "g", rest, small=5, large=5).collect()
        assert max(Counter((r["g"], r["lo"], r["hi"]) for r in dealt).values()) < 40
        by_block = defaultdict(list)
        for r in dealt:
            by_block[r["g"], r["lo"], r["hi"]].append((r["chunk"], r["node"]))
        met = []
        keys = sorted(by_block)
        flat = [(k, c, n) for k in keys for c, n in by_block[k]]
        table = pa.table({"chunk": [c for _, c, _ in flat], "lo": [k[1] for k, _, _ in flat], "hi": [k[2] for k, _, _ in flat]})
        begins = np.array([x for x in range(len(flat)) if x == 0 or flat[x][0] != flat[x - 1][0]])
        for i, j in blocks.meeting(table, begins):
            met += [(flat[a][0][0], *sorted((flat[a][2], flat[b][2]))) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        want = [(g, a, b) for g, size in ((1, 23), (3, 9), (4, 130)) for b in range(size) for a in range(b) if rest is None or a % 4 == 0 or b % 4 == 0]
        assert sorted(met) == sorted(want)


def test_a_large_group_of_near_copies_and_texts_between_the_leaders(spark):
    base = words(77, 200)
    rows = [row(i, " ".join([*base[: i % 180], f"edit{i}", *base[i % 180 :]])) for i in range(600)]  # all alike
    chain = words(78, 100)
    for i in range(40):  # each like the next, ends unlike
        chain = [*chain[3:], *words(900 + i, 3)]
        rows.append(row(5000 + i, " ".join(chain)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(600)} == {0} and got == brute([(r[0], r[1]) for r in rows if r[0] >= 5000] + [(0, rows[0][1])], 5, Fraction(8, 10)) | {i: 0 for i in range(600)}
