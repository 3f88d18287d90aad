"""Blockwise correlation, anchors and the comparison report against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorlake.operators import correlate, recordings


def rows(signals):
    return [(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]


def frame(spark, signals):
    return spark.createDataFrame(rows(signals), "pair string, pos bigint, x double").repartition(5)


def place(hay, needle, energy=True):
    nd = needle - needle.mean()
    c = np.array([nd @ hay[k : k + len(nd)] for k in range(len(hay) - len(nd) + 1)])
    e = np.array([hay[k : k + len(nd)] @ hay[k : k + len(nd)] for k in range(len(c))])
    score = np.round(c / np.sqrt(np.maximum(e, 1e-9) * (nd @ nd) + 1e-9) if energy else c / len(nd), 6)
    return int(np.argmax(score)), float(score.max())


@pytest.mark.parametrize("size", [16, 64, 1024])
def test_places_equal_direct_sums(spark, size):
    rng = np.random.default_rng(1)
    hays, needles = {}, {}
    for k, (n, m) in {"a": (500, 120), "b": (64, 64), "c": (65, 16), "d": (300, 1), "e": (33, 32), "long": (20, 30), "tie": (40, 4)}.items():
        hays[k] = rng.normal(size=n)
        needles[k] = hays[k][7 : 7 + m] * 2 + 1 if k == "a" else rng.normal(size=m)
    hays["tie"], needles["tie"] = np.tile([0.0, 1, 0, 0], 10), np.array([0.0, 1, 0, 0])
    for energy in (True, False):
        got = {r["pair"]: (r["lag"], r["score"]) for r in correlate.correlate(frame(spark, hays), frame(spark, needles), ["pair"], size=size, by_energy=energy).collect()}
        want = {k: place(hays[k], needles[k], energy) for k in hays if len(needles[k]) <= len(hays[k])}
        assert set(got) == set(want)
        for k in want:
            assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6, k


def test_small_batches_leave_sums_open(spark):
    rng = np.random.default_rng(2)
    hays, needles = {k: rng.normal(size=200) for k in "ab"}, {k: rng.normal(size=90) for k in "ab"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r["pair"]: r["lag"] for r in correlate.correlate(frame(spark, hays), frame(spark, needles), ["pair"], size=16).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: place(hays[k], needles[k])[0] for k in hays}


@pytest.mark.parametrize("size", [8, 128])
def test_lags_over_block_edges_and_ends(spark, size):
    rng = np.random.default_rng(3)
    signals = {1: rng.normal(size=40), 2: rng.normal(size=37), 3: np.r_[np.zeros(11), rng.normal(size=30)], 4: np.ones(20)}
    signals[2][5:30] += 3 * signals[1][:25]
    samples = spark.createDataFrame(rows(signals), "s int, pos bigint, x double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4)], "left int, right int")
    got = {(r["left"], r["right"]): (r["lag"], r["corr"]) for r in correlate.lag_correlation(pairs, samples, "s", "x", 12, size).collect()}

    def best(a, b):
        a, b, found = a - a.mean(), b - b.mean(), []
        for lag in range(-12, 13):
            i = np.arange(max(0, -lag), min(len(a), len(b) - lag))
            u, v = a[i], b[i + lag]
            if u @ u > 0 and v @ v > 0:
                found.append((-round(u @ v / np.sqrt((u @ u) * (v @ v)), 6), lag))
        return (min(found)[1], -min(found)[0]) if found else None

    want = {(a, b): best(signals[a], signals[b]) for a, b in ((1, 2), (2, 1), (1, 3), (1, 4))}
    assert want[1, 2][0] == 5 and {k: v for k, v in want.items() if v} == got


def noise(rng, n):
    return rng.normal(size=n) * np.repeat(rng.uniform(0.2, 1.0, n // 50 + 1), 50)[:n]


def stretch(own, heard, hop, start):
    """The best scale of the log-envelope by trying all lengths and places."""
    z = []
    for x in (own, heard):
        e = np.log(np.sqrt((x[: len(x) // hop * hop].reshape(-1, hop) ** 2).mean(axis=1) + 1e-12) + 1e-5)
        z.append((e - e.mean()) / (e.std() + 1e-9))
    found = []
    for k in range(161):
        scale = 0.9 + 0.2 * k / 160
        n = max(8, round(len(z[0]) * scale))
        r = np.interp(np.arange(n) * (len(z[0]) - 1) / (n - 1), np.arange(len(z[0])), z[0])
        r = (r - r.mean()) / (r.std() + 1e-9)
        for at in range(start, len(z[1]) - n + 1):
            found.append((-round(r @ z[1][at : at + n] / n, 6), scale, at))
    corr, scale, at = min(found)
    return scale, at, -corr


def test_anchors_and_report(spark):
    rng = np.random.default_rng(4)
    quiet = lambda n: np.full(n, 1e-4)
    own = {k: noise(rng, 6000) for k in ("same", "slow", "other", "short", "still")}
    own["short"], own["still"] = own["short"][:300], np.zeros(6000)
    slow = np.interp(np.arange(0, 5999, 0.999), np.arange(6000), own["slow"])
    heard = {"same": np.r_[quiet(400), own["same"], quiet(50)], "slow": np.r_[quiet(500), slow, quiet(50)], "other": np.r_[quiet(400), noise(rng, 6300)], "short": np.r_[quiet(400), own["short"]]}
    heard["still"] = np.r_[quiet(400), np.zeros(6000)]
    options = {"hop": 10, "start": 20, "win": 60, "stride": 5, "slack": 150, "least": 100, "size": 512}
    references, captures = frame(spark, own), frame(spark, heard)
    got = {r["pair"]: r for r in recordings.anchor_scales(references, captures, **options).collect()}
    assert got["same"]["time_scale"] == 1 and got["same"]["offset"] == 40 and got["same"]["corr_1"] > 0.9 and got["same"]["capture_2"] == got["same"]["reference_2"] + 400
    assert abs(got["slow"]["time_scale"] - 1 / 0.999) < 3e-4 and got["short"]["time_scale"] is None
    report = {r["pair"]: r for r in recordings.comparison(references, captures, rate=1000, long_hop=50, gap=3, least_segment=5, **options).collect()}
    assert {k: r["method"] for k, r in report.items()} == {"same": "anchors", "slow": "anchors", "other": "active_span", "short": "active_span", "still": "none"}
    assert report["same"]["duration_error_pct"] == 0 and report["same"]["effective_rate"] == 1000
    for k in ("same", "slow", "other"):
        scale, at, corr = stretch(own[k], heard[k], 50, 4)
        assert abs(report[k]["envelope_scale"] - scale) < 1e-9 and report[k]["envelope_offset"] == at and abs(report[k]["envelope_corr"] - corr) < 2e-6
    assert abs(report["other"]["captured_span"] - 6.3) < 0.1 and abs(report["other"]["duration_error_pct"] - 5) < 1.5 and report["still"]["time_scale"] is None


def test_most_dynamic_windows(spark):
    rng = np.random.default_rng(5)
    env = {k: np.abs(rng.normal(size=n)) for k, n in (("a", 200), ("b", 61), ("c", 20))}
    table = spark.createDataFrame([(k, i, float(v)) for k, x in env.items() for i, v in enumerate(x)], "pair string, hop bigint, rms double")
    sizes = table.groupBy("pair").agg(F.count("*").alias("n"))
    got = {(r["pair"], r["part"]): r["at"] for r in recordings.dynamic_windows(table, sizes, 16, 5).collect()}
    want = {}
    for k, x in env.items():
        for part, (lo, hi) in enumerate(recordings.PARTS):
            spots = range(int(len(x) * lo), int(len(x) * hi) - 16, 5)
            if len(spots):
                want[k, part] = max(spots, key=lambda i: (round(x[i : i + 16].std() / (x[i : i + 16].mean() + 1e-9), 9), -i))
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pair string, pos bigint, x double")
    assert recordings.comparison(none, none).count() == 0


@pytest.mark.parametrize("most", [64, 1 << 17])
def test_stretches_in_blocks_equal_direct_sums(monkeypatch, most):
    monkeypatch.setattr(correlate, "LONGEST", most)
    rng = np.random.default_rng(6)
    own, hay, lengths = rng.normal(size=400), rng.normal(size=530), [360, 361, 400, 440]
    own[[5, 200]], hay[17] = np.nan, np.nan
    state = correlate._Stretches(400, 530, lengths, 32)
    for lo in range(0, 530, 32):  # the tapes hold less than the signals
        for tape, x in ((state.own, own), (state.hay, hay)):
            tape.add(x[lo : lo + 32])
            state.advance()
        assert most > 64 or len(state.hay.held) <= 300
    for length, (lag, score) in zip(lengths, state.best(), strict=True):
        at = np.arange(length) * 399
        left = at // (length - 1)
        after = own[np.minimum(left + 1, 399)]
        r = own[left] + (at / (length - 1) - left) * (np.where(np.isnan(after), own[left], after) - own[left])
        q = np.nan_to_num((r - np.nanmean(r)) / (np.nanstd(r) + 1e-9))
        c = np.round([q @ np.nan_to_num(hay[k : k + length]) / length for k in range(530 - length + 1)], 6)
        assert lag == int(np.argmax(c)) and abs(score - c.max()) < 2e-6


def test_no_stretched_copy_is_written_or_shuffled(spark, monkeypatch):
    """What is written follows the envelopes, not the envelopes times the scales."""
    rows, write = [], correlate.written
    monkeypatch.setattr(correlate, "written", lambda df, name: (out := write(df, name), rows.append(out.count()))[0])
    rng = np.random.default_rng(7)
    table = spark.createDataFrame([(k, i, float(v)) for k in "ab" for i, v in enumerate(np.abs(rng.normal(size=900)))], "s string, hop bigint, rms double")
    found = correlate.envelope_scales(spark.createDataFrame([("a", "b")], "left string, right string"), table, "s", "rms", size=64).collect()
    assert len(found) == 1 and found[0]["corr"] is not None and sum(rows) <= 2 * 900 + correlate.PARTS
