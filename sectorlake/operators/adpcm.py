"""4-bit ADPCM: four decoders as associative scans, encoders that step many signals at once.

A step of a decoder adds to a value and clamps it (or lets it wrap).  Such maps close under composition:
x -> min(high, max(low, x + shift)).  So a stream is decoded in blocks side by side: every block's composed map
gives the state that the next one begins with, first for the step index, then for the predictor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the codec: step sizes and index moves by magnitude.
STEPS = [
    16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
]
INDEX_MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]
TOP = len(STEPS) - 1

_STEPS, _MOVES = np.array(STEPS), np.array(INDEX_MOVES)
_LINEAR = _STEPS[:, None] * np.arange(1, 9)
_M = np.arange(8)
_BITS = (_STEPS >> 3)[:, None] + (_M >> 2 & 1) * _STEPS[:, None] + (_M >> 1 & 1) * (_STEPS >> 1)[:, None] + (_M & 1) * (_STEPS >> 2)[:, None]


@dataclass(frozen=True)
class Variant:
    """A decoder: what a code adds, the predictor's range, its first value, and how it becomes a 16-bit sample."""

    deltas: np.ndarray
    low: int
    high: int
    start: int
    scale: int
    offset: int
    wraps: bool = False

    def samples(self, pred: np.ndarray) -> np.ndarray:
        return np.clip(pred * self.scale + self.offset, -32768, 32767)


VARIANTS = {
    "signed15": Variant(_LINEAR, -16384, 16383, 0, 2, 0),
    "unsigned15": Variant(_LINEAR, 0, 32767, 16384, 2, -32768),
    "oki12": Variant(_BITS << 4, 0, 65535, 32768, 1, -32768),
    "wrapping12": Variant(_BITS << 4, 0, 0xFFF0, 32768, 1, -32768, wraps=True),
}

Map = tuple[np.ndarray, np.ndarray, np.ndarray]


def _then(first: Map, second: Map) -> Map:
    """The map of one clamped addition after another."""
    (s, low, high), (t, floor, ceiling) = first, second
    return s + t, np.clip(low + t, floor, ceiling), np.clip(high + t, floor, ceiling)


def _prefixes(shift: np.ndarray, low: int, high: int) -> Map:
    """The composed maps of the first 1, 2, 3, ... additions, by doubling."""
    held: Map = (shift.astype(np.int64), np.full(len(shift), low, np.int64), np.full(len(shift), high, np.int64))
    reach = 1
    while reach < len(shift):
        after = _then(tuple(x[:-reach] for x in held), tuple(x[reach:] for x in held))
        held = tuple(np.concatenate([x[:reach], y]) for x, y in zip(held, after, strict=True))
        reach *= 2
    return held


def _before(maps: Map, start: int) -> np.ndarray:
    """The value before each addition."""
    shift, low, high = (m[:-1] for m in maps)
    return np.concatenate([[start], np.clip(start + shift, low, high)])


def _codes(data: bytes, n: int, low_first: bool) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8)
    halves = (packed & 15, packed >> 4) if low_first else (packed >> 4, packed & 15)
    return np.stack(halves, axis=1).reshape(-1)[:n].astype(np.int64)


def _added(codes: np.ndarray, start_index: int, variant: Variant, rate_code: int) -> np.ndarray:
    """What each code adds to the predictor: C3, in 2**rate_code equal parts, which clamp like their sum."""
    index = _before(_prefixes(_MOVES[codes & 7], 0, TOP), start_index)
    delta = variant.deltas[index, codes & 7] >> rate_code << rate_code
    return np.where(codes >= 8, -delta, delta)


def _predicted(added: np.ndarray, start: int, variant: Variant) -> tuple[np.ndarray, int]:
    """(values that are heard, state behind the last one)."""
    if not len(added):
        return added, start
    if variant.wraps:
        state = (start + np.cumsum(added)) % 65536
        return np.clip(np.concatenate([[start], state[:-1]]) + added, variant.low, variant.high), int(state[-1])
    shift, low, high = _prefixes(added, variant.low, variant.high)
    out = np.clip(start + shift, low, high)
    return out, int(out[-1])


def bias_ramp(at: Column, n: Column, bias: int) -> Column:
    """The DC bias, in steps of two up from a stream's begin and down to its end; none in streams under 200 samples."""
    even = (bias + 1) // 2 * 2
    flat = n - even // 2
    top = F.least(F.lit(even), 2 * flat)
    down = F.greatest(F.lit(0), top - 2 * (at - flat + 1))
    return F.when(n < 200, 0).when(at >= flat, down).otherwise(F.least(F.lit(even), 2 * (at + 1))).cast("long")


def _starts(maps: DataFrame, signal: str, start: int, wraps: bool) -> DataFrame:
    """(signal, block, start): what each block begins with, from the blocks' maps, of which a signal's are put in order."""
    kind = maps.schema[signal]
    listed = maps.groupBy(signal).agg(F.array_sort(F.collect_list(F.struct("block", "shift", "low", "high"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column(1)[k].values
                block, shift, low, high = (held.field(i).to_numpy() for i in range(4))
                out, state = np.zeros(len(block), np.int64), start
                for i, (s, lo, hi) in enumerate(zip(shift.tolist(), low.tolist(), high.tolist(), strict=True)):
                    out[i] = state
                    state = (state + s) % 65536 if wraps else min(hi, max(lo, state + s))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(block), k))), pa.array(block), pa.array(out)], [kind.name, "block", "start"])

    return listed.mapInArrow(run, StructType([kind, *StructType.fromDDL("block bigint, start bigint")]))


def _mapped(blocks: DataFrame, signal: str, schema: str, each) -> DataFrame:
    """``each`` (n, data, further values) of every row, as new columns behind (signal, block)."""
    names = [signal, "block", *StructType.fromDDL(schema).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [each(*values) for values in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in zip(*rows, strict=True))], names)

    return blocks.mapInArrow(run, StructType([blocks.schema[signal], *StructType.fromDDL(f"block bigint, {schema}")]))


def decode_blocks(blocks: DataFrame, signal: str, variant: str = "signed15", rate_code: int = 0, low_first: bool = True) -> DataFrame:
    """(signal, block, pcm, low, high) of (signal, block, n, data): streams of any length, decoded block by block.

    ``data`` has ``n`` 4-bit codes, in the given nibble order; a signal's blocks follow each other by ``block``.
    ``low`` and ``high`` are the predictor's extremes.  Three passes: index maps, predictor maps, samples;
    between them only a map a block is put in order.  Null data counts as empty.
    """
    v = VARIANTS[variant]
    rows = blocks.select(signal, F.col("block").cast("long").alias("block"), F.col("n").cast("long").alias("n"), F.coalesce("data", F.lit(b"")).alias("data"))
    last = lambda maps: tuple(int(m[-1]) for m in maps)

    def index_map(n: int, data: bytes):
        codes = _codes(data, n, low_first)
        return last(_prefixes(_MOVES[codes & 7], 0, TOP)) if len(codes) else (0, 0, TOP)

    def value_map(n: int, data: bytes, index: int):
        added = _added(_codes(data, n, low_first), index, v, rate_code)
        if v.wraps or not len(added):
            return int(added.sum()), v.low, v.high
        return last(_prefixes(added, v.low, v.high))

    def decoded(n: int, data: bytes, index: int, start: int):
        heard, _ = _predicted(_added(_codes(data, n, low_first), index, v, rate_code), start, v)
        return v.samples(heard).tolist(), int(heard.min()) if len(heard) else None, int(heard.max()) if len(heard) else None

    maps = "shift bigint, low bigint, high bigint"
    index = _starts(_mapped(rows, signal, maps, index_map), signal, 0, False).withColumnRenamed("start", "_index")
    known = rows.join(index, [signal, "block"]).select(signal, "block", "n", "data", "_index")
    value = _starts(_mapped(known, signal, maps, value_map), signal, v.start, v.wraps).withColumnRenamed("start", "_value")
    whole = known.join(value, [signal, "block"]).select(signal, "block", "n", "data", "_index", "_value")
    return _mapped(whole, signal, "pcm array<bigint>, low bigint, high bigint", decoded)


def decode_signals(encoded: DataFrame, signal: str, codes: str, rate_code: int = 0, variant: str = "signed15") -> DataFrame:
    """(signal, decoded): C2, 16-bit samples of a row's hexadecimal codes."""
    v = VARIANTS[variant]
    kind = encoded.schema[signal]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digits in batch.column(1).to_pylist():
                own = np.frombuffer(bytes.fromhex("0" + "0".join(digits)) if digits else b"", np.uint8).astype(np.int64)
                out.append(v.samples(_predicted(_added(own, 0, v, rate_code), v.start, v)[0]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], [kind.name, "decoded"])

    return encoded.select(signal, codes).mapInArrow(run, StructType([kind, *StructType.fromDDL("decoded array<int>")]))


def _nearest(target: np.ndarray, pred: np.ndarray, index: np.ndarray, form: str, rate_code: int, search: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign, magnitude, predictor) of the code that each form of encoder takes, for many signals at once."""
    diff = target - pred
    sign, away = diff < 0, np.abs(diff)
    if form.endswith("15"):
        v, step = VARIANTS[form], _STEPS[index]
        near = np.clip((2 * away // step + 1) // 2 - 1, 0, 7)
        tried = []
        for d in (0, -1, 1) if search else (0,):
            m = near + d
            added = _LINEAR[index, np.clip(m, 0, 7)] >> rate_code << rate_code
            moved = np.clip(pred + np.where(sign, -added, added), v.low, v.high)
            tried.append((np.where((m < 0) | (m > 7), 1 << 30, np.abs(target - moved)), m, moved))
        best = np.argmin([t[0] for t in tried], axis=0)
        pick = lambda k: np.choose(best, [t[k] for t in tried])
        return sign, pick(1), pick(2)
    deltas = _BITS[index]
    mag = np.argmin(np.abs(away[:, None] - deltas), axis=1)
    if form == "wrapping12":
        room = np.where(sign, pred, 4095 - pred)
        fits = (deltas <= room[:, None]) & (np.arange(8) <= mag[:, None])
        none = ~fits.any(axis=1)
        mag, sign = np.where(none, 0, 7 - np.argmax(fits[:, ::-1], axis=1)), sign ^ none
    added = _BITS[index, mag]
    moved = pred + np.where(sign, -added, added)
    return sign, mag, moved & 4095 if form == "wrapping12" else np.clip(moved, 0, 4095)


def encode_signals(signals: DataFrame, signal: str, samples: str, rate_code: int = 0, search: bool = True, variant: str = "signed15") -> DataFrame:
    """(signal, codes, n, last_pred, last_index, code_sum) of each row's array of 16-bit samples.

    Codes are hexadecimal digits.  Encoding is closed-loop, a step needs the one before; the signals of a
    batch go through it side by side.  ``search`` tries the neighbouring magnitudes (15-bit forms).  A
    row is one signal, such as a container's chunk of at most 65,536 bytes of codes.
    """
    form = VARIANTS[variant]
    kind = signals.schema[signal]
    first = form.start >> 4 if variant.endswith("12") else form.start
    prepared = {"signed15": lambda x: x >> 1, "unsigned15": lambda x: (x + 32768) >> 1}.get(variant, lambda x: (x + 32768) >> 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pcm = batch.column(1)
            sizes = np.array([len(v) if v.is_valid else 0 for v in pcm], np.int64)
            order = np.argsort(-sizes, kind="stable")
            longest = int(sizes.max(initial=0))
            pred, index = np.full(len(sizes), first, np.int64), np.zeros(len(sizes), np.int64)
            parts = [pcm[int(k)].values.to_numpy(zero_copy_only=False).astype(np.int64) if sizes[k] else np.zeros(0, np.int64) for k in order]
            codes = [np.zeros(int(n), np.uint8) for n in sizes[order]]
            ends = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # signals that are longer than a step
            for t in range(longest):
                live = slice(0, int(ends[t]))
                target = prepared(np.array([p[t] for p in parts[live]]))
                sign, mag, pred[live] = _nearest(target, pred[live], index[live], variant, rate_code, search)
                for row, code in zip(codes[live], (sign * 8 + mag).tolist(), strict=True):
                    row[t] = code
                index[live] = np.clip(index[live] + _MOVES[mag], 0, TOP)
            back = np.argsort(order)
            digits = [codes[k].tobytes().hex()[1::2].upper() for k in back]
            totals = [int(codes[k].sum(dtype=np.int64)) for k in back]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(digits, pa.string()), pa.array(pred[back].astype(np.int32)), pa.array(index[back].astype(np.int32)), pa.array(totals, pa.int64())],
                [kind.name, "n", "codes", "last_pred", "last_index", "code_sum"],
            )

    return signals.select(signal, samples).mapInArrow(run, StructType([kind, *StructType.fromDDL("n bigint, codes string, last_pred int, last_index int, code_sum bigint")]))


def codes_to_bytes(codes: Column, low_first: bool = True, pad: str = "8") -> Column:
    """M8: codes (hexadecimal digits) as bytes, in either nibble order; an odd tail is padded."""
    even = F.when(F.length(codes) % 2 == 1, F.concat(codes, F.lit(pad))).otherwise(codes)
    return F.unhex(F.regexp_replace(even, "(.)(.)", "$2$1") if low_first else even)


def bytes_to_codes(content: Column, low_first: bool = True) -> Column:
    digits = F.hex(content)
    return F.regexp_replace(digits, "(.)(.)", "$2$1") if low_first else digits
