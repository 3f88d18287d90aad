"""Codes as bytes against one string of bits."""

import random

import pytest

from sectorlake.functions import prefix
from sectorlake.operators import bitstream


def plain(tokens):
    text = "".join(format(v, f"0{n}b") for v, n in tokens)
    padded = text + "0" * (-len(text) % 8)
    raw = bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8))
    return len(text), len(raw), raw.replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("small", [1 << 40, 0])
def test_packing_equals_a_string_of_bits(spark, monkeypatch, small):
    monkeypatch.setattr(prefix, "SMALL_BYTES", small)
    rng = random.Random(3)
    streams = {"one": [(1, 1)], "ones": [((1 << 12) - 1, 12)] * 50, "long": [((1 << 48) - 1, 48), (0, 7), ((1 << 63) - 1, 63), (5, 3)], "words": [(0xFF00FF01, 32)] * 3}
    for k in range(6):
        streams[f"r{k}"] = [(rng.getrandbits(n), n) for n in (rng.choice([1, 2, 9, 21, 33, 48, 60]) for _ in range(rng.randint(1, 300)))]
    rows = [(k, i, v, n) for k, t in streams.items() for i, (v, n) in enumerate(t)] + [("one", 7, 0, 0), ("none", 0, 0, 0)]
    rng.shuffle(rows)
    got = {r["stream"]: (r["n_bits"], r["n_bytes"], bytes(r["data"])) for r in bitstream.pack(spark.createDataFrame(rows, "stream string, i int, value bigint, bits int").repartition(4), "stream", ["i"]).collect()}
    assert got == {k: plain(t) for k, t in streams.items()}


def test_canonical_codes():
    assert bitstream.canonical({0: 2, 1: 1, 2: 3, 3: 3}) == [(1, 0, 1), (0, 2, 2), (2, 6, 3), (3, 7, 3)]
    codes = bitstream.canonical({0: 2, 1: 1, 16: 3, 20: 3}, end=0, last=16)
    assert codes == [(1, 0, 1), (20, 4, 3), (16, 5, 3), (0, 3, 2)]
    words = [format(c, f"0{n}b") for _, c, n in codes]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
