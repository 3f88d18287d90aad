"""Batches of adjacent positions against a walk, in one order of the rows."""

import random

from sectorlake.operators import placement


def walk(rows, cap):
    out = []
    for g in {r[0] for r in rows}:
        run = []
        for p in sorted({r[1] for r in rows if r[0] == g}):
            if run and (p != run[-1] + 1 or len(run) == cap):
                out.append((g, run[0], len(run)))
                run = []
            run.append(p)
        out.append((g, run[0], len(run)))
    return sorted(out)


def test_batches_equal_the_walk_and_repeats_count_once(spark):
    rng = random.Random(4)
    rows = [(g, rng.randrange(120)) for g in range(4) for _ in range(150)] + [(9, p) for p in range(50, 66)] + [(10, 7)] * 3
    df = spark.createDataFrame(rows, "g int, p bigint").repartition(5)
    for cap in (1, 3, 8):
        got = placement.contiguous_batches(df, ["g"], "p", cap)
        assert sorted((r["g"], r["first"], r["n"]) for r in got.collect()) == walk(rows, cap)


def test_batches_take_one_shuffle_and_one_order(spark):
    df = spark.createDataFrame([(1, 2)], "g int, p bigint")
    plan = placement.contiguous_batches(df, ["g"], "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Aggregate" not in plan
