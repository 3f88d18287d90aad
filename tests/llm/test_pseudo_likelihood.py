import numpy as np

from sectorlake.llm import pseudo_likelihood as P
from tests.llm.fixtures import SCHEMA, odd_texts, row


def language(seed, n):
    """Words that the neighbours on both sides tell: a b a b ... or c d c d ..., with noise."""
    rng = np.random.default_rng(seed)
    pair = [("aa", "bb"), ("cc", "dd")][seed % 2]
    return " ".join(pair[i % 2] if rng.random() > 0.05 else "zz" for i in range(n))


def test_scores_equal_the_definition(spark):
    rows = odd_texts()[:12] + [row(100 + i, language(i, 60)) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = P.train(docs)
    got = {(r["doc_id"], r["n_words"], round(r["log_likelihood"], 3)) for r in P.score_documents(docs, net).collect()}
    view, n = net.views(net.weights.astype(float)), net.clusters * net.clusters
    from sectorlake.llm import words as W
    import pyarrow as pa

    want = set()
    for r in rows:
        (seg,) = W.segments(pa.array([r[1]], pa.string()), lower=True)
        ids, total = net.encode(seg.hashes), 0.0
        for t, word in enumerate(ids):
            around = [ids[t + k] if 0 <= t + k < len(ids) else n for k in (-2, -1, 1, 2)]
            h = np.tanh(view["hidden"] + sum(view["embedding"][p][w] for p, w in enumerate(around)))
            a = view["cluster"] @ h + view["cluster_bias"]
            c = word // net.clusters
            b = view["word"][c] @ h + view["word_bias"][c]
            total += a[c] - np.log(np.exp(a).sum()) + b[word % net.clusters] - np.log(np.exp(b).sum())
        want.add((r[0], len(ids), total))
    assert len(got) == len(want) and all(any(g[:2] == w[:2] and abs(g[2] - w[2]) < 0.02 + 1e-4 * abs(w[2]) for w in want) for g in got)


def test_probabilities_sum_to_one():
    net = P.new_network([(5, 10), (-7, 4)], 20)
    around = np.array([[0, 1, 1024, 3]])
    total = sum(np.exp(P.log_probabilities(net, np.array([i]), around))[0] for i in range(P.CLUSTERS**2))
    assert abs(total - 1) < 1e-4


def test_words_that_share_a_bucket_have_their_own_shares(spark, monkeypatch):
    import pyarrow as pa
    from sectorlake.llm import words as W

    monkeypatch.setattr(P, "WHOLE", P.CLUSTERS)
    text = " ".join(f"w{i}" for i in range(2000) for _ in range(1 + i % 4))
    docs = spark.createDataFrame([row(1, text)], SCHEMA)
    net = P.train(docs)
    counts = {w: 1 + i % 4 for i, w in enumerate(dict.fromkeys(text.split()))}
    (seg,) = W.segments(pa.array([" ".join(counts)], pa.string()), lower=True)
    hashes, own = dict(zip(counts, seg.hashes, strict=True)), net.clusters**2 - net.buckets
    bucket = {w: int(net.encode(np.array([h]))[0]) for w, h in hashes.items()}
    sums = {b: sum(counts[w] for w in counts if bucket[w] == b) for b in set(bucket.values()) if b >= own}
    rare = [w for w in counts if bucket[w] >= own]
    assert len(rare) > 900 and {counts[w] for w in rare} >= {1, 2}
    around = np.full((1, 4), net.clusters**2)
    asked = spark.createDataFrame([*(row(i, w) for i, w in enumerate(rare[:60] + rare[-60:])), row(999, "unseen"), row(1000, rare[0].upper())], SCHEMA)
    bare = lambda i: P.log_probabilities(net, np.array([i]), around)[0]
    for known in (1 << 18, -len(net.vocabulary)):  # looked up in place, and all joined by hash
        monkeypatch.setattr(P, "KNOWN", known)
        got = {r["doc_id"]: r["log_likelihood"] for r in P.score_documents(asked, net).collect()}
        for i, w in enumerate(rare[:60] + rare[-60:]):
            assert abs(got[i] - bare(bucket[w]) - np.log(counts[w] / (sums[bucket[w]] + 1))) < 1e-4
        assert got[1000] == got[0]
        (seg,) = W.segments(pa.array(["unseen"], pa.string()), lower=True)
        b = int(net.encode(seg.hashes)[0])
        assert abs(got[999] - bare(b) + np.log(sums[b] + 1)) < 1e-4


def test_the_network_grows_with_the_vocabulary():
    assert [P.clusters_for(v) for v in (0, 900, 3500, 400_000, 16_000_000)] == [32, 32, 61, 64, 127]


def test_gradient():
    net = P.new_network([(i, 9 - i) for i in range(8)], 60)
    rng = np.random.default_rng(0)
    net.weights = rng.normal(0, 0.3, len(net.weights)).astype(np.float64)
    ids, around = rng.integers(0, 1024, 20), rng.integers(0, 1025, (20, 4))
    before, memory = net.weights.copy(), np.ones(len(net.weights))
    P.train_step(net, memory, ids, around, rate=1.0)
    gradient = np.sqrt(memory - 1) * np.sign(before - net.weights)
    for k in np.argsort(-np.abs(gradient))[:12]:
        ends = []
        for step in (1e-4, -1e-4):
            net.weights = before.copy()
            net.weights[k] += step
            ends.append(-P.log_probabilities(net, ids, around).mean())
        assert abs((ends[0] - ends[1]) / 2e-4 - gradient[k]) < 1e-3 * max(1, abs(gradient[k]))


def test_training_beats_frequencies(spark):
    docs = spark.createDataFrame([row(i, language(i, 3000)) for i in range(24)], SCHEMA).repartition(3)
    trained = P.train(docs)
    counts = docs.selectExpr("explode(split(text, ' ')) w").groupBy("w").count().toPandas()["count"].to_numpy()
    unigram = (counts / counts.sum() * np.log(counts / counts.sum())).sum()
    held = spark.createDataFrame([row(1000 + i, language(1000 + i, 500)) for i in range(4)], SCHEMA)
    mean = np.mean([r["mean_log_likelihood"] for r in P.score_documents(held, trained).collect()])
    assert mean > unigram + 0.5
    odd = P.score_documents(spark.createDataFrame([row(1, "qq xx yy ww " * 50), row(2, None)], SCHEMA), trained).collect()
    assert odd[0]["mean_log_likelihood"] < mean - 1 and odd[1]["mean_log_likelihood"] is None and odd[1]["log_likelihood"] == 0


def test_empty(spark):
    assert P.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_remembered_contexts_tell_documents_that_occur_twice(spark, monkeypatch):
    monkeypatch.setattr(P, "WHOLE", P.CLUSTERS)
    rng = np.random.default_rng(8)
    make = lambda: " ".join(f"w{x}" for x in rng.integers(0, 30_000, 120))
    rows = [row(i, make()) for i in range(300)] + [row(1000 + i, make()) for i in range(15)]
    rows += [row(2000 + r[0], r[1]) for r in rows if r[0] >= 1000]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in P.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    once, twice = [v for i, v in got.items() if i < 1000], [v for i, v in got.items() if i >= 1000]
    assert min(twice) > max(once) + 0.5


def test_remembered_contexts_equal_counts_by_hand(spark, monkeypatch):
    monkeypatch.setattr(P, "WHOLE", P.CLUSTERS)
    filler = " ".join(f"w{i} " * 9 for i in range(1500))  # takes the ids
    rows = [row(1, filler), row(2, "aa bb cc"), row(3, "aa bb cc dd"), row(4, "aa xx cc"), row(5, "aa bb cc"), row(6, "dd bb aa")]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = P.train(docs)
    from dataclasses import replace

    plain = {r["doc_id"]: r["log_likelihood"] for r in P.score_documents(docs, replace(net, remembered=None)).collect()}
    other = {r["doc_id"]: r["log_likelihood"] for r in P.score_documents(docs, net).collect()}
    monkeypatch.setattr(P, "train", lambda docs: net)
    mixed = {r["doc_id"]: r["log_likelihood"] for r in P.score_documents(docs).collect()}
    assert other[2] > mixed[2]  # as of another corpus, its own occurrence counts
    ids = {w: int(net.encode(h[None])[0]) for w, h in zip(["aa", "bb", "cc", "dd", "xx"], next(P.W.segments(P.pa.array(["aa bb cc dd xx"]), lower=True)).hashes, strict=True)}
    assert all(i >= net.clusters**2 - net.buckets for i in ids.values())
    for i, m in ((2, 2), (5, 2), (4, 0)):  # less the occurrence itself
        around = np.array([[net.clusters**2, ids["aa"], ids["cc"], net.clusters**2]])
        word = "xx" if i == 4 else "bb"
        bucket = ids[word] - (net.clusters**2 - net.buckets)
        n_word = {"xx": 1, "bb": 4}[word]  # of which three between aa and cc
        p = np.exp(P.log_probabilities(net, np.array([ids[word]]), around)[0]) * n_word / (net.totals[bucket] + 1)
        assert abs(mixed[i] - plain[i] - (np.log((m + P.PRIOR * p) / (3 + P.PRIOR)) - np.log(p))) < 1e-3
    assert mixed[6] == plain[6] and mixed[2] > plain[2]


def test_odd_rows_are_scored_row_by_row(spark):
    rows = odd_texts()
    got = P.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["n_words"], r["log_likelihood"], r["mean_log_likelihood"]))
    assert by_id[1][0] == by_id[1][1] == by_id[2][0] and len(by_id[None]) == 2 and (0, 0.0, None) in by_id[None]
    assert by_id[13][0][0] == 20_000 and all(np.isfinite(r["log_likelihood"]) and r["log_likelihood"] <= 0 for r in got)


def test_contexts_met_once_tell_about_another_corpus(spark, monkeypatch):
    monkeypatch.setattr(P, "clusters_for", lambda words: 4)
    corpus = [row(i, " ".join(f"w{(i * k) % 30}" for k in range(80))) for i in range(20)] + [row(99, "xaa xbb xcc")]
    net = P.train(spark.createDataFrame(corpus, SCHEMA), for_others=True)
    asked = spark.createDataFrame([row(1, "xaa xbb xcc"), row(2, "xaa xdd xcc")], SCHEMA)
    with_contexts = {r["doc_id"]: r["log_likelihood"] for r in P.score_documents(asked, net).collect()}
    net.remembered = None
    without = {r["doc_id"]: r["log_likelihood"] for r in P.score_documents(asked, net).collect()}
    assert with_contexts[1] > without[1] + 1 and with_contexts[2] < without[2]


def test_every_word_has_a_gradient(spark, monkeypatch):
    met, step = [], P.train_step
    monkeypatch.setattr(P, "train_step", lambda net, memory, ids, around, *rest: (met.append(len(ids)), step(net, memory, ids, around, *rest))[1])
    monkeypatch.setattr(P, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
    texts = P.pa.array([language(1, 500), None, "one", language(2, 9000)])
    list(P._learn(P.new_network([(1, 1)], 1))(iter([P.pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert sum(met) == 500 + 1 + 9000


def test_probabilities_do_not_depend_on_the_other_words():
    rng = np.random.default_rng(3)
    net = P.new_network([(i, 9) for i in range(50)], 1000)
    net.weights = rng.normal(0, 0.5, len(net.weights)).astype(np.float32)
    ids, around = rng.integers(0, 1024, 50), rng.integers(0, 1025, (50, 4))
    alone = P.log_probabilities(net, ids, around)
    for n in (1, 7, 500, 3001):
        turn = rng.permutation(50 + n)
        got = np.empty(50 + n)
        got[turn] = P.log_probabilities(net, np.r_[ids, rng.integers(0, 1024, n)][turn], np.r_[around, rng.integers(0, 1025, (n, 4))][turn])
        assert (got[:50] == alone).all()


def test_equal_rows_have_equal_probabilities_wherever_they_stand():
    for clusters in (32, 37, 64):
        rng = np.random.default_rng(clusters)
        net = P.new_network([(i, 9) for i in range(50)], 1000, clusters=clusters)
        net.weights = rng.normal(0, 0.5, len(net.weights)).astype(np.float32)
        n = clusters * clusters
        for few in (1, 5, 12, 700):
            ids, around = np.full(few, n // 3), np.tile(rng.integers(0, n + 1, 4), (few, 1))
            more = rng.integers(0, n, 37), rng.integers(0, n + 1, (37, 4))
            got = P.log_probabilities(net, np.r_[ids, more[0]], np.r_[around, more[1]])
            assert (got[:few] == P.log_probabilities(net, ids[:1], around[:1])).all()


def test_a_hash_is_found_among_others_with_its_leading_bits():
    hashes = np.sort(np.r_[np.arange(9, dtype=np.uint64), np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)])
    places = P.Places(hashes)
    assert (places.find(hashes) == np.arange(len(hashes))).all()
    assert (places.find(np.array([9, 1 << 40, (1 << 64) - 1], np.uint64)) == -1).all() and (P.Places(hashes[:0]).find(hashes) == -1).all()


def test_rows_are_summed_by_key():
    rng = np.random.default_rng(2)
    rows, keys = rng.normal(0, 1, (600, 6)).astype(np.float32), rng.integers(0, 90_000, 2400) // 600 * 600
    found, sums = P._sums(rows, keys)
    assert (found == np.unique(keys)).all()
    for k in found[:40]:
        assert np.allclose(sums[found == k], rows[np.flatnonzero(keys == k) % 600].sum(0), atol=1e-4)


def test_contexts_are_read_from_the_scored_rows_and_not_learnt(spark, monkeypatch):
    monkeypatch.setattr(P.Contexts, "tables", lambda *a: 1 / 0)
    docs = spark.createDataFrame([row(i, language(i, 40)) for i in range(4)], SCHEMA)
    assert P.score_documents(docs).count() == 4 and P._LEARNT == "slice int, part int, seen bigint, total binary"


def test_contexts_are_counted_in_whole_groups():
    t = P.pa.table({"around": [1, 1, 1, 2, 5, 5], "whole": [7, 8, 7, 9, 6, 6], "row": [0, 1, 2, 3, 4, 4], "each": P.pa.array([0.0, 1, 2, 3, 4, 5], P.pa.float32()), "rest": [0, 0, 0, 0, 3, 0]})
    got = P._met_often(t, np.array([0, 3, 4])).to_pydict()
    assert got == {"row": [0, 1, 2, 4, 4], "n": [3, 3, 3, 2, 2], "m": [2, 1, 2, 2, 2], "each": [0, 1, 2, 4, 5], "rest": [0, 0, 0, 3, 0]}
