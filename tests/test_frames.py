"""MP2 frames of streams with junk, against a walk byte by byte."""

import random

import pytest
from pyspark.sql import functions as F

from sectorlake.operators import frames


def size_at(data, at):
    if len(data) - at < 4 or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF4:
        return 0
    index, rate, version = (data[at + 2] >> 4) - 1, data[at + 2] >> 2 & 3, "full" if data[at + 1] & 8 else "lsf"
    if not 0 <= index < 14 or rate == 3:
        return 0
    return 144_000 * frames.MP2_KBPS[version][index] // frames.MP2_RATES[version][rate] + (data[at + 2] >> 1 & 1)


def walk(data):
    out, at, synced = [], 0, False
    while len(data) - at >= 4:
        n = size_at(data, at)
        if not synced:
            if not 0 < n <= frames.LONGEST or not (len(data) - at < n + 4 or size_at(data, at + n)):
                at += 1
                continue
        elif not 0 < n <= frames.LONGEST:
            synced = False
            continue
        if at + n > len(data):
            break
        nominal = n - (data[at + 2] >> 1 & 1)
        out.append((len(out), at, n, not synced, None if synced else (at + nominal // 2) // nominal))
        at, synced = at + n, True
    return out


def frame(rng):
    """A frame of any legal header, now and then one that is too long to be taken."""
    second, third = rng.choice([0xF4, 0xF5, 0xFC, 0xFD]), (rng.randrange(1, 15) << 4) | (rng.randrange(3) << 2) | (rng.randrange(2) << 1)
    head = bytes([0xFF, second, third, rng.randrange(256)])
    body = bytearray(rng.randbytes(size_at(head + b"", 0) - 4))
    for _ in range(rng.randrange(3)):  # what looks like a header within a frame
        at = rng.randrange(len(body) + 1)
        body[at : at + 3] = bytes([0xFF, 0xF5, 0x94])[: max(0, len(body) - at)]
    return head + bytes(body)


def stream(seed):
    rng = random.Random(seed)
    parts = [rng.randbytes(rng.choice([0, 3, 700, 9000]))]
    for _ in range(rng.randrange(5, 60)):
        parts.append(frame(rng))
        if rng.random() < 0.2:
            junk = bytearray(rng.randbytes(rng.choice([1, 50, 2500, 12_000])))
            junk[: rng.choice([0, 4])] = bytes([0xFF, 0xFD, 0x94, 0][: rng.choice([0, 4])])
            parts.append(bytes(junk))
    whole = b"".join(parts)
    return whole[: len(whole) - rng.choice([0, 0, 1, 100, 1000])]


STREAMS = {f"s{k}": stream(k) for k in range(24)} | {
    "empty": b"", "tiny": b"\xff\xfd", "junk": bytes(20_000), "sync": b"\xff\xfd\x94\x00" * 3000, "one": frame(random.Random(99)), "ff": b"\xff" * 9000,
    "edge": b"\0" * 4094 + frame(random.Random(5)) * 30,
}


@pytest.mark.parametrize("size", [2048, 4096, 1 << 16])
def test_frames_equal_the_walk(spark, size):
    rows = [(k, c, v[c * size : (c + 1) * size]) for k, v in STREAMS.items() for c in range(-(-len(v) // size))]
    random.Random(1).shuffle(rows)
    chunks = spark.createDataFrame(rows, "stream string, chunk int, data binary").repartition(5)
    got = {}
    for r in frames.split_frames(chunks, "stream", size).collect():
        got.setdefault(r["stream"], []).append((r["frame"], r["at"], r["size"], r["hunted"], r["guess"]))
    for k, data in STREAMS.items():
        assert sorted(got.get(k, [])) == walk(data), k


def test_pieces_become_chunks(spark):
    rng = random.Random(2)
    rows, whole = [], {}
    for k in ("a", "b"):
        at, whole[k] = 0, b""
        for _ in range(40):
            data = rng.randbytes(rng.choice([0, 1, 30, 500]))
            rows.append((k, at, data))
            at, whole[k] = at + len(data), whole[k] + data
    got = frames.byte_chunks(spark.createDataFrame(rows, "stream string, at bigint, data binary"), "stream", 64).orderBy("stream", "chunk").collect()
    for k, data in whole.items():
        assert [bytes(r["data"]) for r in got if r["stream"] == k] == [data[i : i + 64] for i in range(0, len(data), 64)]


def test_small_chunks_are_refused(spark):
    with pytest.raises(ValueError, match="or more"):
        frames.split_frames(spark.range(0).select(F.lit("x").alias("stream"), F.col("id").alias("chunk"), F.lit(b"").alias("data")), "stream", 100)


def test_only_groups_of_chunks_are_put_in_order(spark, monkeypatch):
    """Three chunks a group: the same frames, and a row a group where chains are followed over a stream."""
    rows = [(k, c, v[c * 2048 : (c + 1) * 2048]) for k, v in STREAMS.items() for c in range(-(-len(v) // 2048))]
    chunks = spark.createDataFrame(rows, "stream string, chunk int, data binary").repartition(5)
    monkeypatch.setattr(frames, "GROUP", 3)
    made, write = {}, frames.written
    monkeypatch.setattr(frames, "written", lambda df, name: made.setdefault(name, write(df, name)))
    got = {}
    for r in frames.split_frames(chunks, "stream", 2048).collect():
        got.setdefault(r["stream"], []).append((r["frame"], r["at"], r["size"], r["hunted"], r["guess"]))
    for k, data in STREAMS.items():
        assert sorted(got.get(k, [])) == walk(data), k
    assert made["entries"].where(F.size(F.array_distinct("m.chunk")) > 3).count() == 0


def test_pieces_become_chunks_that_see_the_next_one(spark):
    rng = random.Random(3)
    rows, whole, at = [], b"", 0
    for _ in range(60):
        data = rng.randbytes(rng.choice([0, 1, 30, 500]))
        rows.append(("a", at, data))
        at, whole = at + len(data), whole + data
    got = frames.byte_chunks(spark.createDataFrame(rows, "stream string, at bigint, data binary"), "stream", 64, 20).orderBy("chunk").collect()
    assert [(bytes(r["data"]), bytes(r["ahead"])) for r in got] == [(whole[i : i + 64], whole[i + 64 : i + 84]) for i in range(0, len(whole), 64)]
