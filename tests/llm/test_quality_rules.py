import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sectorlake.llm import quality_rules
from tests.llm.fixtures import SCHEMA, odd_texts, row, split, words


def labelled(n):
    rows, labels = [], []
    for i in range(n):
        w = words(i, 40 + i % 50)
        bad = i % 3 == 0
        rows.append(row(i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_compiled_rules(spark):
    rows, labels = labelled(600)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.score_quality(docs, known).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 < r["score"] < 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(r["predicted"], labels[i][1]) for i, r in got.items() if r["held_out"]]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.97
    statistics = quality_rules.text_statistics(docs)
    model = quality_rules.fit(statistics, quality_rules.training_labels(known))
    assert 0 < len(model.rules) < 120
    both = statistics.withColumn("score", model.column()).toPandas()
    assert np.allclose(both["score"], model.predict(both[quality_rules.STATISTICS].to_numpy()), atol=1e-9)
    kept = quality_rules.accepted(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows, labels = labelled(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = ({r["doc_id"]: r["score"] for r in quality_rules.score_quality(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect()} for x in (labels, turned))
    assert a == b


def test_odd_texts_statistics_and_no_labels(spark):
    docs = spark.createDataFrame(odd_texts(), SCHEMA)
    none = spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_rules.score_quality(docs, none).collect()
    assert len(got) == len(odd_texts()) and len({r["score"] for r in got}) == 1
    known = {r["doc_id"]: r for r in quality_rules.text_statistics(docs).where(F.col("doc_id").isNotNull()).collect()}
    assert known[4]["log_bytes"] == known[5]["log_words"] == 0 and known[7]["distinct_words"] == 1 and known[12]["commonest_word"] == 1
    assert abs(known[16]["upper_share"] + known[16]["space_share"] - 1) < 1e-9
    assert quality_rules.score_quality(spark.createDataFrame([], SCHEMA), none).count() == 0


def plain_statistics(text):
    raw = (text or "").encode()
    w = [x for x in split(text)]
    n, size = max(len(w), 1), max(len(raw), 1)
    share = lambda inside: sum(inside(b) for b in raw) / size
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(w)), "word_bytes": sum(len(x.encode()) for x in w) / n,
        "longest_word": math.log1p(max((len(x.encode()) for x in w), default=0)), "distinct_words": len(set(w)) / n,
        "commonest_word": max(Counter(w).values(), default=0) / n, "words_per_line": math.log1p(len(w) / (raw.count(b"\n") + 1)),
        "upper_share": share(lambda b: 65 <= b <= 90), "lower_share": share(lambda b: 97 <= b <= 122), "digit_share": share(lambda b: 48 <= b <= 57),
        "stress_share": share(lambda b: b in b"!?"), "symbol_share": share(lambda b: b in b"#$%&*+<=>@^_`|~/\\{}[]"), "mark_share": share(lambda b: b in b".,;:'\"()-"),
        "space_share": share(lambda b: b in b" \t\n\r\x0b\x0c"), "line_share": share(lambda b: b == 10), "wide_share": share(lambda b: b > 127),
    }


def test_statistics_equal_plain_python(spark):
    rows = [row(i, t[1]) for i, t in enumerate(odd_texts())] + [row(100, "a.b, (c)! x_y #1 \\ é?\n\nB b B")]
    got = {r["doc_id"]: r for r in quality_rules.text_statistics(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        want = plain_statistics(text)
        assert set(want) == set(quality_rules.STATISTICS)
        assert all(abs(got[i][s] - v) < 1e-9 for s, v in want.items())


def test_scores_equal_a_plain_sum_of_rules(spark):
    rows, labels = labelled(200)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality_rules.fit(quality_rules.text_statistics(docs), quality_rules.training_labels(known))
    got = {r["doc_id"]: r["score"] for r in quality_rules.score_quality(docs, known).collect()}
    for i, text, *_ in rows:
        s = plain_statistics(text)
        total = model.bias + sum(r.weight for r in model.rules if all((s[n] > cut) == above for n, above, cut in r.tests))
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9


def test_the_lasso_is_at_its_optimum():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 12)) < 0.4).astype(float)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 400) > 0).astype(float)
    bias, w = quality_rules._lasso(x, y, 0.01, steps=3000)
    slope = x.T @ (1 / (1 + np.exp(-(bias + x @ w))) - y) / 400
    assert abs(np.mean(1 / (1 + np.exp(-(bias + x @ w))) - y)) < 1e-4
    assert all(abs(g + 0.01 * np.sign(v)) < 1e-4 if v else abs(g) < 0.01 + 1e-4 for g, v in zip(slope, w, strict=True))


def test_repeated_ids_are_bounded_and_names_may_clash(spark):
    rows, labels = labelled(120)
    rows += [row(1, "same id " + " ".join(words(i, 20))) for i in range(300)] + [row(2, rows[2][1])] * 50
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("log_bytes", F.lit("mine")).withColumn("_log_words", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    statistics = quality_rules.text_statistics(docs)
    picked = quality_rules.training_labels(known)
    seen = []
    real = quality_rules.fit_rules
    quality_rules.fit_rules = lambda values, own, seed=0: seen.append(len(own)) or real(values, own, seed)
    try:
        quality_rules.fit(statistics, picked, rows=100)
        kept = quality_rules.accepted(docs, known)
    finally:
        quality_rules.fit_rules = real
    assert 50 < seen[0] < 160
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 51
