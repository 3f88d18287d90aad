import zlib
from collections import Counter, defaultdict

from sectorlake.llm import sharding
from tests.llm.fixtures import SCHEMA, odd_texts


def test_every_row_has_a_slot_and_growth_moves_only_to_the_new_shard(spark):
    rows = odd_texts() + [r for r in odd_texts() for _ in range(3)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), [1.0] * 5).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 5 and r["grown_shard"] in (r["shard"], 5) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})


def test_weights_and_stability(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "'x' as text")
    three = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, [1.0, 1.0, 2.0]).collect()}
    share = Counter(three.values())
    assert abs(share[2] / 8000 - 0.5) < 0.03 and abs(share[0] / 8000 - 0.25) < 0.03
    four = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign_shards(docs, [1.0, 1.0, 2.0], 1.0).collect()}
    again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, [1.0, 1.0, 2.0, 1.0]).collect()}
    assert all(four[d][1] == again[d] for d in again) and 0.17 < sum(g == 3 for _, g in four.values()) / 8000 < 0.23


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), [1.0] * 3).count() == 0
