import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sectorlake.llm import words as W
from tests.llm.fixtures import split

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("abAB é日\n\t\x0b\x1c.!")), max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.booleans(), st.integers(1, 60))
def test_words_equal_the_pattern(values, lower, limit):
    got, hashes = [], {}
    for seg in W.segments(pa.array(values, pa.string()), lower=lower, limit=limit):
        for d in range(len(seg.counts)):
            own = [seg.data[s:e].tobytes().decode() for s, e in zip(seg.starts[seg.first[d] : seg.first[d + 1]], seg.ends[seg.first[d] : seg.first[d + 1]], strict=True)]
            got.append(own)
            for w, h in zip(own, seg.sequence(d).tolist(), strict=True):
                assert hashes.setdefault(w, h) == h
    assert got == [split(v, lower) for v in values]
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 4))
def test_windows(values, k):
    seen = {}
    for seg in W.segments(pa.array(values, pa.string())):
        h, at, doc = seg.windows(k)
        want = [(d, i) for d in range(len(seg.counts)) for i in range(max(0, seg.counts[d] - k + 1))]
        assert [(d, a - seg.first[d]) for a, d in zip(at, doc, strict=True)] == want
        for (d, i), x in zip(want, h.tolist(), strict=True):
            key = tuple(split(values[seg.lo + d])[i : i + k])
            assert seen.setdefault(key, x) == x
    assert len(set(seen.values())) == len(seen)


def test_sliding_minimum():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for width in range(1, 8):
        assert W.sliding_minimum(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


def test_hashes_are_polynomials_modulo_a_prime():
    rng = np.random.default_rng(3)
    for point in (0, 1):
        values = rng.integers(0, 1 << 64, 300, np.uint64)
        at = np.sort(rng.integers(0, 301, (200, 2)), axis=1)
        base, p = W.POINTS[point], W.PRIME
        want = [(sum(int(values[a + k]) * pow(base, k, p) for k in range(b - a)) % p + b - a) % (1 << 64) for a, b in at.tolist()]
        assert W._spans(values, at[:, 0], at[:, 1], point).tolist() == W.mix(np.array(want, np.uint64)).tolist()


def test_byte_spans_are_polynomials_too():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = np.r_[rng.integers(0, 2400, 300), 5, 0, 3000]
    ends = np.r_[starts[:300] + rng.integers(0, 40, 300), 5 + W.LONG_WORD, W.LONG_WORD, 3000]
    for point in (0, 1):
        want = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            raw, value = data[a:b].tobytes(), b - a
            for k in range(0, len(raw), 7):
                value = (value * W.POINTS[point] + int.from_bytes(raw[k : k + 7], "little")) % W.PRIME
            want.append(value)
        assert W.byte_spans(data, starts, ends, point).tolist() == W.mix(np.array(want, np.uint64)).tolist()


def test_words_that_collide_modulo_powers_of_two_are_told_apart():
    for n in (512, 1024, 2048, 4096, 1 << 16):
        word = thue_morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        seg = next(W.segments(pa.array([f"x {word} {other} {word}"])))
        assert seg.hashes[1] == seg.hashes[3] != seg.hashes[2] and seg.others[1] == seg.others[3] != seg.others[2]
