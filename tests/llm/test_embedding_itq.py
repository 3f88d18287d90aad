import numpy as np

from sectorlake.llm import embedding_itq
from tests.llm.test_near_dedup import components

COLUMNS = "vec_id bigint, embedding array<float>, label int, node bigint, copies string, bucket int"


def brute(rows, threshold):
    sound = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            sound[k] = x / np.linalg.norm(x)
    links = {k: [j for j in sound if j != k and len(sound[j]) == len(sound[k]) and sound[j] @ sound[k] >= threshold] if k in sound else [] for k in range(len(rows))}
    up = components(range(len(rows)), [(a, b) for a, own in links.items() for b in own])
    low = {}
    for k, root in up.items():
        low[root] = min(low.get(root, 1 << 62), rows[k][0])
    return {rows[k][0]: (len(links[k]), low[up[k]]) for k in range(len(rows))}


def test_recall_and_exactness(spark):
    rng = np.random.default_rng(0)
    vectors = list(rng.normal(size=(700, 64)))
    for g in range(25):
        base = rng.normal(size=64)
        vectors += [base + rng.normal(size=64) * s for s in rng.uniform(0.05, 0.33, 12)]
    hot = rng.normal(size=64)
    vectors += [hot] * 150 + [hot + rng.normal(size=64) * 0.1 for _ in range(80)] + [2.5 * hot]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [1.0] * 3, [1.0, 1.0, 1.01], [2.0], [-2.0], [None] + [1.0] * 63]
    rows += [(10_000 + i, v) for i, v in enumerate(odd)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_itq.embedding_duplicates(spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], COLUMNS)).collect()}
    want = brute(rows, 0.95)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(got[10_000 + i] == want[10_000 + i] for i in range(len(odd)))


def test_null_and_shared_ids_are_no_bridges(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 64))
    rows = [(5, a), (9, b), (7, a + 0.01), (7, b + 0.01), (None, a + 0.02), (None, b + 0.02), (None, -a)]
    docs = spark.createDataFrame([(i, [float(x) for x in v], 1, 2, "c", 3) for i, v in rows], COLUMNS)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in embedding_itq.embedding_duplicates(docs).collect())
    assert got == [("5", 2, "5"), ("7", 2, "5"), ("7", 2, "7"), ("9", 2, "7"), ("None", 0, "None"), ("None", 2, "5"), ("None", 2, "7")]


def test_rotation_balances_and_keeps_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)) @ rng.normal(size=(32, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_itq.build_index(x, len(x))
    codes = index.encode(x)
    ones = [(codes[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).mean() for b in range(128)]
    assert 0.3 < min(ones) and max(ones) < 0.7
    near = index.encode(x + rng.normal(size=x.shape) * 0.02)
    assert np.bitwise_count(codes ^ near).mean() < 0.3 * np.bitwise_count(codes ^ codes[::-1]).mean()


def test_recall_of_isolated_pairs_by_length_mean_and_number():
    """Pairs at cosine 0.95 to 0.96 that no neighbour helps to find, with keys for ever more vectors."""
    rng = np.random.default_rng(4)
    for d, mean, number in [(3, 0, 1000), (16, 0, 10**5), (64, 0, 10**7), (64, 1.3, 10**6), (96, 5.0, 10**6), (64, 0, 10**9), (64, 0, 10**11), (256, 0, 10**11)]:
        x = rng.normal(size=(3000, d)) / np.sqrt(d)
        x[:, 0] += mean
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = embedding_itq.build_index(x[:2000], number)
        away = rng.normal(size=(1000, d))
        away -= (away * x[2000:]).sum(1, keepdims=True) * x[2000:]
        away /= np.linalg.norm(away, axis=1, keepdims=True)
        cos = rng.uniform(0.95, 0.96, (1000, 1))
        differ = index.encode(x[2000:]) ^ index.encode(cos * x[2000:] + np.sqrt(1 - cos**2) * away)
        met = ((differ[:, None, :] & index.tables[None]) == 0).all(2).any(1) & (np.bitwise_count(differ).sum(1) <= index.radius)
        assert met.mean() >= 0.95, (d, mean, number, met.mean())
        assert len(index.tables) < (200 if number <= 10**7 else embedding_itq.MOST_TABLES + 1)


def test_exactly_at_the_threshold_and_repeated_ids(spark):
    rows = [(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [1.0, 0.0]), (3, [2.0, 0.0]), (None, [1.0, 0.0]), (4, [24.0, 7.0])]
    docs = spark.createDataFrame([(i, v, 1, 2, "c", 3) for i, v in rows], COLUMNS)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in embedding_itq.embedding_duplicates(docs, threshold=0.96).collect())
    # 0.96 between 1 and 2, and between 3 and 4; 4 and 2: 117 / 125
    assert got == [("1", 1, "1"), ("2", 1, "1"), ("3", 3, "3"), ("3", 3, "3"), ("4", 3, "3"), ("None", 3, "3")]


def test_empty(spark):
    assert embedding_itq.embedding_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0
