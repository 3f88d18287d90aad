"""Vectorised words and word-sequence hashes over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  All work is done on the bytes of
many texts at once; no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (or one longer text).
SEGMENT_BYTES = 1 << 19

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words without punctuation: all ASCII bytes but letters and digits separate.
_BREAK = np.zeros(256, bool)
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True
#: For terms: all ASCII bytes but letters separate.
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[[b for b in range(128) if not chr(b).isalpha()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, exclusive or)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Hashes are values of polynomials modulo this prime at a fixed random point: two different words agree
#: with a probability of about their length over 2**61.  A second point gives pairs of 122 bits.
PRIME = (1 << 61) - 1
# The two points, drawn once.
POINTS = (0x0D93E4A1B7C26F35, 0x15F2C08B6A4D7E99)
_P, _M29, _M30, _M31, _M32 = (_U((1 << k) - 1) for k in (61, 29, 30, 31, 32))
#: Bytes of a coefficient of a word's polynomial, and masks of the lowest so many bytes.
_PACK = 7
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(_PACK + 1)], np.uint64)
#: Longer words are summed one by one.
LONG_WORD = 64 * _PACK
_POWERS: dict[int, list[np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """The same modulo PRIME, at most 7 over it."""
    return (x & _P) + (x >> _U(61))


def _exact(x: np.ndarray) -> np.ndarray:
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products, reduced, of reduced numbers, from halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _U(31), a & _M31, b >> _U(31), b & _M31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _M30) << _U(31)) + a0 * b0)


def _powers(n: int, point: int) -> list[np.ndarray]:
    """Powers 0..n of a point and of its inverse; kept for the next call."""
    have = _POWERS.get(point)
    if have is None or len(have[0]) <= n:
        size = n + 1 + (n >> 3)
        have = []
        for base in (POINTS[point], pow(POINTS[point], -1, PRIME)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = _times(out[:more], np.full(more, pow(base, done, PRIME), np.uint64))
                done += more
            have.append(out)
        _POWERS[point] = have
    return have


class Prefixes:
    """Prefix sums over 64-bit ``values``, from which any span's hash follows, equal for equal content wherever it stands."""

    def __init__(self, values: np.ndarray, point: int = 0):
        power, self.inverse = _powers(len(values), point)
        terms = _times(_reduced(values), power[: len(values)])
        self.low, self.high = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
        np.cumsum(terms & _M32, out=self.low[1:])
        np.cumsum(terms >> _U(32), out=self.high[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]."""
        low, high = _reduced(self.low[ends] - self.low[starts]), _reduced(self.high[ends] - self.high[starts])
        total = _reduced(low + (high >> _U(29)) + ((high & _M29) << _U(32)))
        return mix(_exact(_times(total, self.inverse[starts])) + (ends - starts).astype(np.uint64))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, point: int = 0) -> np.ndarray:
    return Prefixes(values, point).spans(starts, ends)


def byte_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, point: int = 0) -> np.ndarray:
    """Hashes of spans of bytes: polynomials with the length first and then seven bytes a coefficient."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
    size = ends - starts
    base = np.full(1, POINTS[point], np.uint64)
    short = np.minimum(size, LONG_WORD)
    # The first bytes follow the length, of which there are few.
    out = _reduced(_times(np.arange(LONG_WORD + 1, dtype=np.uint64), base).take(short) + (at[starts] & _LOWEST.take(np.minimum(size, _PACK))))
    other = np.flatnonzero((size == 0) | (size > LONG_WORD))
    out[other] = size[other].astype(np.uint64)
    open_, done = np.flatnonzero((size > _PACK) & (size <= LONG_WORD)), _PACK
    while len(open_):
        left = size.take(open_) - done
        own = at[starts.take(open_) + done] & _LOWEST.take(np.minimum(left, _PACK))
        out[open_] = _reduced(_times(out.take(open_), base) + own)
        open_, done = open_[left > _PACK], done + _PACK
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        places = np.arange(starts[k], ends[k], _PACK)
        own = at[places] & _LOWEST[np.minimum(ends[k] - places, _PACK)]
        out[k] = _reduced(Prefixes(own, point).spans(np.array([0]), np.array([len(own)]))[0] + out[k])
    return mix(_exact(out))


@dataclass
class Words:
    """Words of a segment of documents: byte spans, hashes, and the first word of each document."""

    data: np.ndarray  #: bytes of all texts of the segment
    offsets: np.ndarray  #: byte offset of each document, and the end
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  #: index of each document's first word, and the end
    lo: int  #: index of the segment's first document in the batch

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def others(self) -> np.ndarray:
        """The words' hashes at the second point."""
        return byte_spans(self.data, self.starts, self.ends, 1)

    def documents(self) -> np.ndarray:
        """Document (within the segment) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int, point: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, document) of every run of k words within one document; ``point`` 1 gives the second hash."""
        n = len(self.hashes)
        if n < k:
            empty = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), empty, empty
        doc = self.documents()
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        return _spans(self.others if point else self.hashes, at, at + k, point), at, doc[at]

    def sequence(self, doc: int) -> np.ndarray:
        return self.hashes[self.first[doc] : self.first[doc + 1]]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(texts: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = SEGMENT_BYTES, bare: bool = False, hashed: bool = True, letters: bool = False) -> Iterator[Words]:
    """Words of ``texts`` (null: empty) in segments of about ``limit`` bytes, in order.

    ``lower`` lower-cases A-Z; ``bare`` also separates words at ASCII punctuation, which drops it;
    ``letters`` at digits too; ``hashed`` False leaves the words' hashes out.
    """
    whole = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    separators = _NO_LETTER if letters else _BREAK if bare else _SPACE
    base = 0
    for chunk in whole.chunks if isinstance(whole, pa.ChunkedArray) else [whole]:
        data, offsets = _bytes(chunk)
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower, base + lo, separators, hashed)
            lo = hi
        base += len(chunk)


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool, lo: int, separators: np.ndarray, hashed: bool) -> Words:
    if lower:
        data = _LOWER[data]
    inner = ~separators[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inner[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inner[1:]
    starts = np.flatnonzero(inner & (~before | border[:-1]))
    ends = np.flatnonzero(inner & (~after | border[1:])) + 1
    hashes = byte_spans(data, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets), lo)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
