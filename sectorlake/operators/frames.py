"""MP2 frames of a byte stream: hunting headers in junk and following the chain, chunk by chunk."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sectorlake.functions.units import div
from sectorlake.sources.shared import written

# kbit/s by index and sample rates by code, for low (lsf) and full sample rates.
MP2_KBPS = {"lsf": [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160], "full": [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]}
MP2_RATES = {"lsf": [22050, 24000, 16000], "full": [44100, 48000, 32000]}
# Fixed value: the longest frame that is taken.
LONGEST = 1440
#: Bytes of a chunk that streams are cut into.
CHUNK = 1 << 16
#: What a chunk must see of the next one: a frame that begins on its last byte, and the header behind it.
OVERLAP = LONGEST + 4
#: Consecutive chunks whose rows are composed into those of one group.
GROUP = 256


def _sizes() -> np.ndarray:
    """Frame bytes by (version bit, third byte); 0 where that is no header."""
    out = np.zeros((2, 256), np.int64)
    for k, version in enumerate(("lsf", "full")):
        for byte in range(256):
            index, rate = (byte >> 4) - 1, byte >> 2 & 3
            if 0 <= index < 14 and rate < 3:
                out[k, byte] = 144_000 * MP2_KBPS[version][index] // MP2_RATES[version][rate] + (byte >> 1 & 1)
    return out


_SIZES = _sizes()


def header_sizes(data: np.ndarray) -> np.ndarray:
    """The size of the frame whose header begins at each byte that three others follow; 0 where none does."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    out = np.zeros(len(data) - 3, np.int64)
    at = np.flatnonzero(data[:-3] == 0xFF)
    at = at[data[at + 1] & 0xF6 == 0xF4]
    out[at] = _SIZES[data[at + 1] >> 3 & 1, data[at + 2]]
    return out


@dataclass
class _Chunk:
    """What one chunk knows: sizes of frames that may be taken, and those that another header or the end confirms."""

    size: np.ndarray
    confirmed: np.ndarray
    length: int
    ends: bool  #: whether the stream ends in what is seen
    seen: int

    @classmethod
    def of(cls, data: bytes, ahead: bytes | None) -> _Chunk:
        whole = np.frombuffer(data + (ahead or b""), np.uint8)
        headers, n = header_sizes(whole), len(data)
        size = np.where(headers <= LONGEST, headers, 0)
        # With fewer bytes ahead than are asked for, the stream ends there.
        ends = len(ahead or b"") < OVERLAP
        at = np.flatnonzero(size)
        follow = at + size[at]
        known = np.zeros(len(at), bool)
        inside = follow < len(size)
        known[inside] = headers[follow[inside]] > 0
        known[~inside] = ends
        return cls(size, at[known & (at < n)], n, ends, len(whole))

    def follow(self, at: int, synced: bool) -> Iterator[tuple[int, int, bool]]:
        """(place, size, hunted) of whole frames from a place on; what was passed on is in ``exit`` and ``open`` then."""
        self.exit, self.synced, self.open = None, False, True
        while True:
            if not synced:
                k = int(np.searchsorted(self.confirmed, at))
                if k == len(self.confirmed):
                    # Nothing here; the next chunk hunts on from its begin, or from a place within it.
                    self.exit, self.open = max(at - self.length, 0), not self.ends or self.seen > self.length
                    return
                at, hunted = int(self.confirmed[k]), True
            else:
                hunted = False
            size = int(self.size[at])
            if self.ends and at + size > self.seen:
                self.open = False  # cut off by the stream's end
                return
            yield at, size, hunted
            at += size
            synced = at < len(self.size) and self.size[at] > 0
            if at >= self.length:
                self.exit, self.synced = at - self.length, synced
                return


def _ways(chunk: _Chunk) -> dict[int, tuple[int, int | None, bool, bool]]:
    """(frames, exit, exit synced, goes on) of ``follow`` from each header of a chunk, the last one first: each is one frame and then another's way."""
    size, sizes, confirmed = chunk.size, {}, chunk.confirmed.tolist()
    for place in np.flatnonzero(size).tolist():
        sizes[place] = int(size[place])
    out: dict[int, tuple[int, int | None, bool, bool]] = {}
    for place in reversed([p for p in sizes if p < chunk.length]):
        at = place + sizes[place]
        if chunk.ends and at > chunk.seen:
            out[place] = 0, None, False, False
        elif at >= chunk.length:
            out[place] = 1, at - chunk.length, at in sizes, True
        else:
            if at not in sizes:
                k = bisect_left(confirmed, at)
                if k == len(confirmed):
                    out[place] = 1, 0, False, not chunk.ends or chunk.seen > chunk.length
                    continue
                at = confirmed[k]
            frames, *rest = out[at]
            out[place] = frames + 1, *rest
    return out


def _entries(chunk: _Chunk) -> list[tuple[int, int, bool, int, int | None, bool, bool]]:
    """(from, to, synced, frames, exit, exit synced, goes on) for all places where a chunk may be entered.

    A chunk is entered on one of its headers by a frame before it, or hunting, at any of its first bytes,
    in which case the next confirmed header decides; so few rows say all.
    """
    reach = min(LONGEST, chunk.length)
    out: list[tuple] = []
    ways = _ways(chunk)
    for synced, places in ((True, np.flatnonzero(chunk.size[: reach + 1])), (False, chunk.confirmed)):
        before = 0
        for place in places.tolist():
            if place not in ways:  # on the border to the next chunk
                ways[place] = sum(1 for _ in chunk.follow(place, True)), chunk.exit, chunk.synced, chunk.open
            lo = place if synced else before
            out.append((lo, place, synced, *ways[place]))
            before = place + 1
            if not synced and place >= reach:
                break
        if not synced and before <= reach:
            list(chunk.follow(before, False))
            out.append((before, reach, False, 0, chunk.exit, False, chunk.open))
    return out


_MAPS = "lo bigint, hi bigint, synced boolean, frames bigint, exit bigint, exit_synced boolean, goes_on boolean"
_MAP_NAMES = [m.split(" ")[0] for m in _MAPS.split(", ")]


class _Entered:
    """The rows of one chunk, found by the place where it is entered."""

    def __init__(self, rows: list[tuple]):
        self.synced = {r[0]: r for r in rows if r[2]}
        self.hunting = [r for r in rows if not r[2]]
        self.ends = [r[1] for r in self.hunting]

    def at(self, place: int, synced: bool) -> tuple | None:
        if synced:
            return self.synced.get(place)
        k = bisect_left(self.ends, place)
        return self.hunting[k] if k < len(self.ends) and self.hunting[k][0] <= place else None


def _by_chunk(held: pa.StructArray) -> list[tuple[int, list[tuple]]]:
    """(chunk, rows) in order of sorted structs of a chunk's number and rows."""
    out: list[tuple[int, list[tuple]]] = []
    for c, *row in zip(*(held.field(i).to_pylist() for i in range(8)), strict=True):
        if not out or out[-1][0] != c:
            out.append((c, []))
        out[-1][1].append(tuple(row))
    return out


def _composed(chunks: list[tuple[int, list[tuple]]]) -> list[tuple]:
    """What consecutive chunks say together, for all places where the first one may be entered."""
    rows: list[tuple] = []
    after = None
    for _, own in reversed(chunks):
        rows = []
        for lo, hi, synced, frames, leave, leave_synced, goes_on in own:
            met = after.at(leave, leave_synced) if goes_on and after else None
            rows.append((lo, hi, synced, frames + met[3], *met[4:]) if met else (lo, hi, synced, frames, leave, leave_synced, goes_on))
        after = _Entered(rows)
    return rows


def _chain(chunks: list[tuple[int, list[tuple]]], at: int, synced: bool, number: int) -> list[tuple[int, int, bool, int]]:
    """(chunk, place, synced, number of its first frame) where a chain enters each chunk."""
    out = []
    for c, rows in chunks:
        met = _Entered(rows).at(at, synced)
        if met is None:
            continue
        out.append((c, at, synced, number))
        number += met[3]
        if not met[6]:
            break
        at, synced = met[4], met[5]
    return out


def split_frames(chunks: DataFrame, stream: str, size: int = CHUNK) -> DataFrame:
    """(stream, frame, at, size, hunted, guess) of the whole MP2 frames of streams (stream, chunk, data).

    ``data`` are a stream's bytes from ``chunk * size`` on, ``size`` of them but in its last chunk.  A first header, and the next one wherever a frame is not followed by a header, is
    hunted: the first that another header confirms where its frame ends, or the stream's end.  A frame that
    the stream's end cuts off ends the chain.  ``guess`` is a hunted frame's number by its place, as for constant
    bit rates.  Chunks say in few rows where a chain leaves them for each place where it may come in; the rows of
    GROUP chunks are composed, only those of groups are put in order over a stream, and each group then tells its
    chunks where they are entered.  A column ``ahead`` with the next chunk's first OVERLAP bytes saves a join.
    """
    if size < OVERLAP:
        raise ValueError(f"chunks of {OVERLAP} bytes or more")
    rows = chunks.select(stream, F.col("chunk").cast("long").alias("chunk"), F.coalesce("data", F.lit(b"")).alias("data"), *[c for c in chunks.columns if c == "ahead"])
    heads = rows.select(stream, (F.col("chunk") - 1).alias("chunk"), F.substring("data", 1, OVERLAP).alias("ahead"))
    # Both walks read the same bytes, which are put together once.
    seen = written(rows if "ahead" in rows.columns else rows.join(heads, [stream, "chunk"], "left"), "chunks").select(stream, "chunk", "data", "ahead")
    kind = rows.schema[stream]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *e) for k, (data, ahead) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) for e in _entries(_Chunk.of(data, ahead))]
            index = pa.array([f[0] for f in found], pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array([f[i + 1] for f in found], t) for i, t in enumerate(kinds))], [kind.name, "chunk", *_MAP_NAMES])

    mapped = seen.mapInArrow(maps, StructType([kind, *StructType.fromDDL("chunk bigint, " + _MAPS)]))
    listed = mapped.groupBy(stream, div(F.col("chunk"), GROUP).alias("group")).agg(F.array_sort(F.collect_list(F.struct("chunk", *_MAP_NAMES))).alias("m"))
    listed = written(listed, "entries")

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            found = [(k, *e) for k in range(batch.num_rows) for e in _composed(_by_chunk(batch.column(2)[k].values))]
            index = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array([f[i + 1] for f in found], t) for i, t in enumerate(kinds))], [kind.name, "chunk", *_MAP_NAMES])

    def chained(name: str, start: bool):
        """Chains from a stream's begin (``start``), or from where a group is entered."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    begin = (0, False, 0) if start else tuple(batch.column(c)[k].as_py() for c in (2, 3, 4))
                    out = _chain(_by_chunk(batch.column(1)[k].values), *begin)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(len(out), k))), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64())))],
                        [kind.name, name, "enter", "synced", "number"],
                    )

        return run

    made = lambda name: StructType([kind, *StructType.fromDDL(f"{name} bigint, enter bigint, synced boolean, number bigint")])
    groups = listed.mapInArrow(composed, StructType([kind, *StructType.fromDDL("chunk bigint, " + _MAPS)]))
    order = groups.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct("chunk", *_MAP_NAMES))).alias("m"))
    begun = order.mapInArrow(chained("group", True), made("group"))
    entered = listed.join(begun, [stream, "group"]).select(stream, "m", "enter", "synced", "number").mapInArrow(chained("chunk", False), made("chunk"))
    whole = seen.join(entered, [stream, "chunk"]).select(stream, "chunk", "data", "ahead", "enter", "synced", "number")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (chunk, data, ahead, enter, synced, number) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for i, (at, n, hunted) in enumerate(_Chunk.of(data, ahead).follow(enter, synced)):
                    nominal = n - (data + (ahead or b""))[at + 2] // 2 % 2
                    place = chunk * size + at
                    out.append((k, number + i, place, n, hunted, (place + nominal // 2) // nominal if hunted else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), *(pa.array([o[i + 1] for o in out], t) for i, t in enumerate(kinds))], [kind.name, "frame", "at", "size", "hunted", "guess"])

    return whole.mapInArrow(walked, StructType([kind, *StructType.fromDDL("frame bigint, at bigint, size bigint, hunted boolean, guess bigint")]))


def byte_chunks(pieces: DataFrame, stream: str, size: int = CHUNK, ahead: int = 0) -> DataFrame:
    """(stream, chunk, data) of pieces (stream, at, data) that lie one behind the other: cut at the chunks' borders and put together.

    ``ahead`` adds a column of that name: so many bytes of the next chunk, or fewer at the end; then pieces there go to both.
    """
    last = F.col("at") + F.octet_length("data") - 1
    first = F.greatest(div(F.col("at") - ahead, size), F.lit(0).cast("long")) if ahead else div(F.col("at"), size)
    cut = pieces.where(F.octet_length("data") > 0).select(stream, "at", "data", F.explode(F.sequence(first, div(last, size))).alias("chunk"))
    lo = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0).cast("long"))
    part = F.substring("data", (lo + 1).cast("int"), ((F.col("chunk") + 1) * size + ahead - F.col("at") - lo).cast("int"))
    own = cut.select(stream, "chunk", (F.col("at") + lo).alias("at"), part.alias("data")).where(F.octet_length("data") > 0)
    # As many tasks as the session's shuffles have, however well the bytes are packed on their way.
    dealt = own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), stream, "chunk")
    whole = dealt.groupBy(stream, "chunk").agg(F.expr("listagg(data) within group (order by at)").alias("data"))
    return whole.select(stream, "chunk", F.substring("data", 1, size).alias("data"), F.substring("data", size + 1, ahead).alias("ahead")) if ahead else whole
