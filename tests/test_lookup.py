"""Lookups and running values on sparse keys, against plain Python."""

import bisect
import random

from pyspark.sql import functions as F

from sectorlake.functions import prefix
from sectorlake.functions.prefix import exclusive_sums, running
from sectorlake.operators import lookup, placement


def _ids(kind: str, n: int) -> list[int]:
    rng = random.Random(5)
    if kind == "dense":
        return list(range(n))
    if kind == "gaps":
        return sorted(i + 20_000 * (i // 2) for i in range(n))
    return sorted(rng.randrange(-(1 << 62), 1 << 62) for _ in range(n))  # as hashes lie


def test_sums_over_dense_gapped_and_hashed_keys(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SMALL_BYTES", 0)
    for kind in ("dense", "gaps", "hashed"):
        ids = _ids(kind, 300)
        df = spark.createDataFrame([(i, n % 7) for n, i in enumerate(ids)], "id long, v int")
        got = {r["id"]: r["s"] for r in running(df, ["id"], {"s": ("sum", F.col("v"))}).collect()}
        before = 0
        for n, i in enumerate(ids):
            assert got[i] == before
            before += n % 7


def test_running_values_by_stream(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SMALL_BYTES", 0)
    rng = random.Random(2)
    rows = [(s, i, rng.choice([None, *range(9)])) for s in "ab" for i in rng.sample(range(10**6), 200)]
    df = spark.createDataFrame(rows, "s string, i long, v int")
    for width in (None, 1000):
        got = running(df, ["i"], {"last": ("last", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}, ("s",), inclusive=True, width=width)
        found = {(r["s"], r["i"]): (r["last"], r["low"], r["high"]) for r in got.collect()}
        for s in "ab":
            seen = []
            for _, i, v in sorted(r for r in rows if r[0] == s):
                seen += [] if v is None else [v]
                assert found[s, i] == ((seen[-1], min(seen), max(seen)) if seen else (None, None, None))


def test_sector_to_frame_on_sparse_frames(spark):
    for kind in ("dense", "gaps", "hashed"):
        ids = _ids(kind, 60)
        frames, at = [], 0
        for n, i in enumerate(ids):
            at += n % 3
            frames.append((i, at, at + 2))
            at += 2
        df = spark.createDataFrame(frames, "frame long, start_sector long, end_sector long")
        probes = spark.createDataFrame([(s,) for s in range(at + 20)], "sector long")
        got = sorted((r["sector"], r["frame"]) for r in lookup.sector_to_frame(probes, "sector", df).collect())
        want = [(s, next((f for f, _, e in frames if e > s), frames[-1][0])) for s in range(at + 20)]
        assert got == want


def test_last_mark_at_or_before_over_wide_gaps(spark):
    values = [1, 2, 20_000, 20_001, -(1 << 61)]
    marks = [(10, values[0]), (20, values[1]), (10**12, values[2]), (10**12 + 5, values[3]), (3 * 10**17, values[4])]
    df = spark.createDataFrame([*marks, (None, 9)], "at long, page long")
    asked = [0, 9, 10, 25, 10**11, 10**12, 10**12 + 4, 10**15, 4 * 10**17, None, 25]
    probes = spark.createDataFrame([(n, b) for n, b in enumerate(asked)], "n int, byte long")
    got = {r["n"]: (r["page"], r["at"]) for r in lookup.last_at_or_before(probes, "byte", df, "at", "page").collect()}
    assert len(got) == len(asked)
    for n, b in enumerate(asked):
        k = bisect.bisect_right([m for m, _ in marks], b) - 1 if b is not None else -1
        assert got[n] == ((marks[k][1], marks[k][0]) if k >= 0 else (None, None))
    none = lookup.last_at_or_before(probes, "byte", df.limit(0), "at", "page").collect()
    assert len(none) == len(asked) and all(r["page"] is None for r in none)


def test_slots_of_hashed_keys(spark):
    ids = _ids("hashed", 200)
    df = spark.createDataFrame([(i, 1000 * (n % 5)) for n, i in enumerate(ids)], "id long, n long")
    got = {r["id"]: r["start_sector"] for r in placement.variable_slots(df, "id", F.col("n"), 7).collect()}
    at = 7
    for n, i in enumerate(ids):
        assert got[i] == at
        at += -(-1000 * (n % 5) // 2048)
    assert exclusive_sums(df.limit(0), "id", {"s": F.col("n")}).count() == 0
