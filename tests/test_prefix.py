"""Running values by a plain window, by dense chunks and by written ranges."""

import random

import pytest
from pyspark.sql import functions as F

from sectorlake.functions import prefix


def rows(seed):
    rng = random.Random(seed)
    hot = [("hot", k * k, rng.choice([None, rng.randint(-50, 50)])) for k in range(400)]
    return hot + [(g, k * 7 + i, rng.choice([None, rng.randint(-50, 50)])) for i, g in enumerate(["a", "b", None]) for k in range(30)] + [("one", 5, 1)]


def plain(data, by, inclusive):
    out, groups = {}, {}
    for g, k, v in sorted(data, key=lambda r: (r[1], r[0] or "")):
        seen = groups.setdefault(g if by else 0, [])
        held = [*seen, v] if inclusive else seen
        some = [x for x in held if x is not None]
        out[g, k] = (sum(some), min(some, default=None), max(some, default=None), some[-1] if some else None)
        seen.append(v)
    return out


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize(("small", "width"), [(1 << 40, None), (0, 64), (0, None)])
def test_running_values(spark, monkeypatch, small, width, by, inclusive):
    monkeypatch.setattr(prefix, "SMALL_BYTES", small)
    data = rows(1)
    df = spark.createDataFrame(data, "g string, k bigint, v bigint").repartition(5)
    values = {"total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "latest": ("last", F.col("v"))}
    got = prefix.running(df, ["k", "g"], values, by, inclusive, width)
    assert got.columns == ["g", "k", "v", "total", "least", "most", "latest"]
    assert {(r["g"], r["k"]): tuple(r)[3:] for r in got.collect()} == plain(data, by, inclusive)


def test_numbers_and_empty_tables(spark, monkeypatch):
    for small in (0, 1 << 40):
        monkeypatch.setattr(prefix, "SMALL_BYTES", small)
        df = spark.range(0, 900, 3).withColumnRenamed("id", "k")
        assert all(r["n"] == r["k"] // 3 for r in prefix.numbered(df, "k", "n").collect())
        assert prefix.numbered(df.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_only_long_streams_are_cut(spark, monkeypatch, inclusive):
    data = rows(2)
    df = spark.createDataFrame(data, "g string, k bigint, v bigint").repartition(5)
    values = {"total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "latest": ("last", F.col("v"))}
    monkeypatch.setattr(prefix, "SMALL_BYTES", 0)
    made, write = [], prefix.written
    monkeypatch.setattr(prefix, "written", lambda d, name: (made.append((name, out := write(d, name))), out)[1])
    for long, cut in ((1000, 0), (100, 400), (10, 490)):  # none, one stream, all but one row's
        monkeypatch.setattr(prefix, "LONG", long)
        made.clear()
        got = prefix.running(df, ["k"], values, ("g",), inclusive)
        assert got.columns == ["g", "k", "v", "total", "least", "most", "latest"]
        assert {(r["g"], r["k"]): tuple(r)[3:] for r in got.collect()} == plain(data, True, inclusive)
        assert sum(t.count() for name, t in made if name == "ranges") == cut
