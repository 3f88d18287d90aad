import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sectorlake.llm import importance
from tests.llm.fixtures import SCHEMA, odd_texts, row, words


def features(text, n=2):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + k]) for k in range(1, n + 1) for i in range(len(found) - k + 1)]


def plain(rows, aims, n=2, buckets=10_000, percent=25, least=20, seed=7):
    """(doc_id, n_features, weight, score, rank) by the definition, ranks by sorting all rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    counted = [Counter(map(bucket, features(t, n)[1])) for _, t in rows]
    s, t = sum(counted, Counter()), sum((Counter(map(bucket, features(a, n)[1])) for a in aims), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for (i, text), c in zip(rows, counted, strict=True):
        size = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // size if size else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(text)[0])])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(r):
    return tuple((v is None, v or 0) for v in r)


AIMS = [" ".join(words(900 + i, 60)) for i in range(5)] + [None, "", "  ", "é 日本 1 2"]


@pytest.mark.parametrize("options", [{}, {"percent": 60, "least_words": 1, "seed": 3}, {"n": 3, "buckets": 97}])
def test_scores_and_ranks_equal_the_definition(spark, monkeypatch, options):
    monkeypatch.setattr(importance, "SLICE_BYTES", 3000)
    rows = odd_texts() + [row(100 + i, " ".join(words(i, 15 + i) + words(900 + i % 5, 20))) for i in range(60)] + [row(None, "the an er on " * 9)] * 8
    rows += [row(200, "nul \0 inside the_words A1b2-C3 " * 12), row(201, "ÄÖ Straße ÉTÉ " * 10)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    target = spark.createDataFrame([(i, a) for i, a in enumerate(AIMS)], "item_id int, text string")
    want = plain([r[:2] for r in rows], AIMS, **{{"least_words": "least"}.get(k, k): v for k, v in options.items()})
    got = [tuple(r) for r in importance.score_documents(docs, target, **options).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    ranks = [r[4] for r in got if r[4]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_drawn_rows_keep_their_columns(spark):
    rows = [row(i, " ".join(words(i, 30) + (words(900, 40) if i % 4 == 0 else words(i + 50, 40)))) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = spark.createDataFrame([(i, " ".join(words(900, 60))) for i in range(500)], "item_id int, text string")
    kept = importance.resample(docs, target)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == 50 and set(got) <= set(rows)
    near = sum(r[0] % 4 == 0 for r in got)
    assert near > 25  # a quarter of the rows shares the target's words; noise alone would give 12


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id int, text string")
    assert importance.score_documents(none, target).count() == 0
    got = importance.score_documents(spark.createDataFrame([row(1, None), row(2, "a b"), row(3, "c " * 50)], SCHEMA), target, percent=100).collect()
    assert {r["doc_id"]: r["rank"] for r in got} == {1: None, 2: None, 3: 1}


def test_ranks_of_tied_rows_are_dealt(spark):
    rows = spark.range(3000, numPartitions=6).selectExpr("id", "cast(1 as bigint) as score")
    from pyspark.sql import functions as F

    got = importance.ranked(rows, [F.desc("score"), F.asc("id")]).collect()
    assert all(r["rank"] == r["id"] + 1 for r in got)
