"""Decoders as scans against a step-by-step fold, and encoders that step many signals at once."""

import random

import pytest

from sectorlake.operators import adpcm

TWELVE = ("oki12", "wrapping12")


def delta(variant, index, code):
    s, m = adpcm.STEPS[index], code & 7
    if variant in TWELVE:
        d = ((s >> 3) + (s if m & 4 else 0) + (s >> 1 if m & 2 else 0) + (s >> 2 if m & 1 else 0)) << 4
    else:
        d = s * (m + 1)
    return -d if code & 8 else d


def fold(codes, variant, rate_code=0):
    """(samples, least and largest predictor), one code after the other, with C3's parts clamped one by one."""
    v = adpcm.VARIANTS[variant]
    pred, index, heard = v.start, 0, []
    for c in codes:
        d = delta(variant, index, c)
        if v.wraps:
            heard.append(min(v.high, max(v.low, pred + d)))
            pred = (pred + d) & 0xFFF0
        else:
            part = abs(d) >> rate_code
            for _ in range(1 << rate_code):
                pred = min(v.high, max(v.low, pred + (part if d > 0 else -part)))
            heard.append(pred)
        index = min(48, max(0, index + adpcm.INDEX_MOVES[c & 7]))
    out = [x - 32768 if variant in TWELVE else min(32767, max(-32768, 2 * x - (32768 if variant == "unsigned15" else 0))) for x in heard]
    return out, (min(heard), max(heard)) if heard else (None, None)


def streams(seed):
    rng = random.Random(seed)
    out = {"one": [3], "none": [], "loud": [7] * 300 + [15] * 300, "quiet": [0, 8] * 200}
    for k in range(4):
        out[f"r{k}"] = [rng.choice([rng.randrange(16), 7, 15]) for _ in range(rng.randint(300, 900))]
    return out


def packed(codes, low_first):
    even = codes + [0] * (len(codes) % 2)
    return bytes((a | b << 4) if low_first else (a << 4 | b) for a, b in zip(even[::2], even[1::2], strict=True))


@pytest.mark.parametrize(("variant", "rate_code", "low_first"), [*((v, 0, False) for v in adpcm.VARIANTS), ("signed15", 1, True), ("signed15", 2, True), ("unsigned15", 3, False)])
def test_blocks_equal_the_fold(spark, variant, rate_code, low_first):
    rng = random.Random(7)
    rows, known = [], streams(11)
    for name, codes in known.items():
        at, block = 0, 0
        while at < len(codes) or block == 0:
            n = rng.choice([1, 2, 17, 64, 200])
            own = codes[at : at + n]
            rows.append((name, block, len(own), packed(own, low_first) if own else None))
            at, block = at + n, block + rng.choice([1, 1, 3])
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, "signal string, block int, n int, data binary").repartition(4)
    got = {}
    for r in sorted(adpcm.decode_blocks(blocks, "signal", variant, rate_code, low_first).collect(), key=lambda r: (r["signal"], r["block"])):
        got.setdefault(r["signal"], []).append(r)
    for name, codes in known.items():
        want, (low, high) = fold(codes, variant, rate_code)
        assert [x for r in got[name] for x in r["pcm"]] == want
        assert (min((r["low"] for r in got[name] if r["low"] is not None), default=None), max((r["high"] for r in got[name] if r["high"] is not None), default=None)) == (low, high)
    encoded = spark.createDataFrame([(k, "".join("%X" % c for c in v)) for k, v in known.items()] + [("null", None)], "signal string, codes string")
    whole = {r["signal"]: r["decoded"] for r in adpcm.decode_signals(encoded, "signal", "codes", rate_code, variant).collect()}
    assert whole.pop("null") == [] and whole == {k: fold(v, variant, rate_code)[0] for k, v in known.items()}


def tones(seed):
    rng = random.Random(seed)
    walk, out = 0, []
    for _ in range(rng.randint(50, 400)):
        walk = max(-32768, min(32767, walk + rng.randint(-3000, 3000)))
        out.append(walk)
    return out


def code_by_code(pcm, variant):
    """The code of least error among all sixteen that neither clamp nor wrap more than they must (12-bit forms)."""
    pred, index, out = 2048, 0, []
    for x in pcm:
        target = (x + 32768) >> 4
        diff = target - pred
        size = [abs(delta(variant, index, m)) >> 4 for m in range(8)]
        m = min(range(8), key=lambda k: (abs(abs(diff) - size[k]), k))
        sign = diff < 0
        if variant == "wrapping12":
            while m >= 0 and not 0 <= pred + (-size[m] if sign else size[m]) <= 4095:
                m -= 1
            if m < 0:
                m, sign = 0, not sign
        pred = pred + (-size[m] if sign else size[m])
        pred = pred & 4095 if variant == "wrapping12" else min(4095, max(0, pred))
        index = min(48, max(0, index + adpcm.INDEX_MOVES[m]))
        out.append(m | 8 * sign)
    return out


def test_encoders(spark):
    known = {k: tones(k) for k in range(12)} | {100: [], 101: [32767] * 90 + [-32768] * 90}
    signals = spark.createDataFrame([*known.items(), (102, None)], "signal int, pcm array<int>").repartition(2)
    for variant in adpcm.VARIANTS:
        rows = {r["signal"]: r for r in adpcm.encode_signals(signals, "signal", "pcm", search=False, variant=variant).collect()}
        assert rows[102]["codes"] == "" and {k: r["n"] for k, r in rows.items() if k < 102} == {k: len(v) for k, v in known.items()}
        for k, pcm in known.items():
            codes = [int(c, 16) for c in rows[k]["codes"]]
            assert rows[k]["code_sum"] == sum(codes)
            if variant in TWELVE:
                assert codes == code_by_code(pcm, variant)
            back, _ = fold(codes, variant)
            if k < 100:
                assert sum(abs(a - b) for a, b in zip(pcm, back, strict=True)) / len(pcm) < 3000
