"""Spark data sources over media files: ranged reads of containers and images, and sinks that commit.

``register(spark)`` makes them known:

* ``sector_container`` reads containers as tables.  Option ``part``: ``streams`` (headers: 64 bytes a file), ``frames`` (the
  index, 32 bytes a frame; with option ``payloads`` also the payloads), or ``chunks`` (audio).  A large file is
  read by many tasks, each a range of its frames.  Filters on ``stream_id`` leave files out and filters on
  ``frame`` entries, before anything is read.
* ``byte_ranges`` reads any file as (path, at, data), a task a range.
* ``whole_files`` writes rows (stream_id, content) as files, ``disc_image`` rows (at, content) as one file, each task
  its own ranges.  What a task writes is staged; the files appear when all tasks have ended, and a job that
  fails leaves nothing.

Addresses are what Arrow's file systems open; ``disc_image`` needs a file system with ranged writes (``file:``).
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from sectorlake.functions.units import FLAG_ADPCM, FLAG_MP2, SECTOR_BYTES
from sectorlake.sources.container import ENTRY, ENTRY_BYTES, HEADER, HEADER_BYTES, MAGIC

#: Bytes of a file that one task reads at most, and rows of a batch.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 256
PARTS = ("streams", "frames", "chunks")

_FIELDS = struct.Struct("<8s6H11I")
_ENTRY = struct.Struct("<8I")


def open_folder(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there."""
    address = re.sub(r"^file:/+", "file:///", address)
    return fs.FileSystem.from_uri(address if "://" in address else "file://" + os.path.abspath(address))


def _listed(address: str) -> list[fs.FileInfo]:
    system, root = open_folder(address)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(address)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


@dataclass
class Slice(InputPartition):
    """The ``index``-th of ``of`` parts of each of some files (path, bytes)."""

    files: list[tuple[str, int]]
    index: int = 0
    of: int = 1


def _slices(files: list[fs.FileInfo], split: int, cut: bool) -> list[Slice]:
    """Large files cut, small ones together, so that a task has about ``split`` bytes."""
    out, held, size = [], [], 0
    for f in files:
        parts = -(-f.size // split) if cut else 1
        if parts > 1:
            out += [Slice([(f.path, f.size)], k, parts) for k in range(parts)]
            continue
        if held and size + f.size > split:
            out.append(Slice(held))
            held, size = [], 0
        held, size = [*held, (f.path, f.size)], size + f.size
    return [*out, Slice(held)] if held or not out else out


class _Counted:
    """A file opened for ranged reads, which counts the bytes that it gave."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file, self.bytes = system.open_input_file(path), 0

    def range(self, at: int, size: int) -> bytes:
        got = self.file.read_at(max(size, 0), at)
        self.bytes += len(got)
        return got


def _header(file: _Counted) -> dict | None:
    raw = file.range(0, HEADER_BYTES)
    if len(raw) < HEADER_BYTES:
        return None
    values = _FIELDS.unpack(raw)
    return {"magic": values[0].decode("latin-1"), **dict(zip(HEADER, values[1:], strict=True))}


def _codec(head: dict) -> str:
    if head["audio_bytes"] == 0:
        return "none"
    return "mp2" if head["flags"] & FLAG_MP2 else "adpcm" if head["flags"] & FLAG_ADPCM else "unknown"


_LONG = ", ".join
_SCHEMAS = {
    "streams": "stream_id string, file_bytes bigint, magic string, " + _LONG(f"{c} bigint" for c in HEADER) + ", codec string, read_bytes bigint",
    "frames": "stream_id string, frame bigint, " + _LONG(f"{c} bigint" for c in ENTRY),
    "payloads": "stream_id string, frame bigint, " + _LONG(f"{c} bigint" for c in ENTRY) + ", payload_crc32 bigint, payload binary",
    "chunks": "stream_id string, byte_offset bigint, data binary",
}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


class _ContainerReader(DataSourceReader):
    def __init__(self, address: str, kind: str, split: int):
        self.address, self.kind, self.split = address, kind, split
        self.names: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[Slice]:
        files = [f for f in _listed(self.address) if self.names is None or f.base_name in self.names]
        return _slices(files, self.split, cut=self.kind != "streams")

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.address)
        columns = [c.split(" ") for c in _SCHEMAS[self.kind].split(", ")]
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in columns])
        rows: list[tuple] = []
        for path, size in partition.files:
            for row in self._rows(_Counted(system, path), path.rsplit("/", 1)[-1], size, partition.index, partition.of):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def _rows(self, file: _Counted, name: str, size: int, index: int, of: int) -> Iterator[tuple]:
        head = _header(file)
        if head is None:
            return
        if self.kind == "streams":
            yield (name, size, head["magic"], *(head[c] for c in HEADER), _codec(head), file.bytes)
            return
        if head["magic"].encode("latin-1") != MAGIC:
            return
        if self.kind == "chunks" and index == 0 and head["preroll_sectors"]:
            n = min(head["audio_bytes"], head["preroll_sectors"] * SECTOR_BYTES)
            yield name, 0, file.range(head["data_start_sector"] * SECTOR_BYTES, n)
        count = head["frame_count"]
        lo, hi = max(self.low, count * index // of), min(self.high, count * (index + 1) // of)
        for begin in range(lo, hi, BATCH_ROWS):
            end = min(begin + BATCH_ROWS, hi)
            entries = file.range(HEADER_BYTES + begin * ENTRY_BYTES, (end - begin) * ENTRY_BYTES)
            for k, entry in enumerate(_ENTRY.iter_unpack(entries[: len(entries) // ENTRY_BYTES * ENTRY_BYTES])):
                yield from self._entry(file, name, head, begin + k, dict(zip(ENTRY, entry, strict=True)))

    def _entry(self, file: _Counted, name: str, head: dict, frame: int, e: dict) -> Iterator[tuple]:
        if self.kind == "chunks":
            if e["a_sectors"]:
                n = min(head["audio_bytes"] - e["audio_byte_offset"], e["a_sectors"] * SECTOR_BYTES)
                yield name, e["audio_byte_offset"], file.range(e["audio_sector"] * SECTOR_BYTES, n)
        elif self.kind == "payloads":
            payload = file.range(e["video_sector"] * SECTOR_BYTES, e["video_size"])
            yield name, frame, *e.values(), zlib.crc32(payload), payload
        else:
            yield name, frame, *e.values()


class _FilteredReader(_ContainerReader):
    """Narrows files and frames by filters, which Spark still applies itself."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column == "stream_id" and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif column == "frame" and self.kind in ("frames", "payloads"):
                if isinstance(f, EqualTo | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, EqualTo | LessThanOrEqual):
                    self.high = min(self.high, f.value + 1)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
            yield f


class SectorContainer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sector_container"

    def _kind(self) -> str:
        part = self.options.get("part", "streams")
        if part not in PARTS:
            raise ValueError(f"part must be one of {', '.join(PARTS)}")
        return "payloads" if part == "frames" and self.options.get("payloads", "false").lower() == "true" else part

    def schema(self) -> str:
        return _SCHEMAS[self._kind()]

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("push", "true").lower() == "true" else _ContainerReader
        return kind(self.options["path"], self._kind(), int(self.options.get("split", SPLIT_BYTES)))


class _RangeReader(DataSourceReader):
    def __init__(self, address: str, size: int, split: int):
        self.address, self.size, self.split = address, size, max(split // size, 1) * size

    def partitions(self) -> list[Slice]:
        return _slices(_listed(self.address), self.split, cut=True)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.address)
        for path, size in partition.files:
            file = system.open_input_file(path)
            lo = partition.index * self.split
            for at in range(lo, min(size, lo + self.split) if partition.of > 1 else size, self.size):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at]), pa.array([file.read_at(self.size, at)], pa.binary())], ["path", "at", "data"])


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, at bigint, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RangeReader(self.options["path"], int(self.options.get("bytes", 1 << 20)), int(self.options.get("split", SPLIT_BYTES)))


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: (staged name, final name), or (first byte, end)."""

    parts: list[tuple]


class _FilesWriter(DataSourceArrowWriter):
    def __init__(self, address: str, overwrite: bool):
        self.address, self.overwrite, self.staging = address, overwrite, f"_staging-{uuid.uuid4().hex}"
        # Made here and not by the tasks: one that outlives its job's end finds no place to write to.
        system, root = open_folder(address)
        system.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = open_folder(self.address)
        folder, done = f"{root}/{self.staging}", []
        for batch in iterator:
            for name, content in zip(batch.column("stream_id").to_pylist(), batch.column("content"), strict=True):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"not a file's name: {name!r}")
                staged = uuid.uuid4().hex
                with system.open_output_stream(f"{folder}/{staged}") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                done.append((staged, name))
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = open_folder(self.address)
        parts = [p for m in messages if m for p in m.parts]
        names = {name for _, name in parts}
        if len(names) < len(parts):
            self.abort(messages)
            raise ValueError("two rows have one stream_id")
        system.create_dir(root, recursive=True)
        before = [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
        for staged, name in parts:
            system.move(f"{root}/{self.staging}/{staged}", f"{root}/{name}")
        if self.overwrite:
            for f in before:
                if f.base_name not in names:
                    system.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = open_folder(self.address)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "stream_id string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _FilesWriter(self.options["path"], overwrite)


class _ImageWriter(DataSourceArrowWriter):
    """Each task writes its rows at their places of one staged file; gaps stay zero, and the end is padded to whole sectors."""

    def __init__(self, address: str, sectors: int):
        self.address, self.sectors, self.staging = address, sectors, f".image-{uuid.uuid4().hex}"
        _, staged = self._paths()
        os.makedirs(os.path.dirname(staged), exist_ok=True)
        with open(staged, "xb"):  # made here, so that a task that outlives its job's end finds no file
            pass

    def _paths(self) -> tuple[str, str]:
        system, path = open_folder(self.address)
        if system.type_name != "local":
            raise ValueError("a disc image needs a file system with ranged writes")
        return path, os.path.join(os.path.dirname(path), self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        _, staged = self._paths()
        file, done = os.open(staged, os.O_WRONLY), []
        try:
            for batch in iterator:
                for at, content in zip(batch.column("at").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    view, place = memoryview(content or b""), at
                    while len(view):
                        n = os.pwrite(file, view, place)
                        view, place = view[n:], place + n
                    done.append((at, place))
            os.fsync(file)
        finally:
            os.close(file)
        return Staged(_joined(done))

    def commit(self, messages: list[Staged | None]) -> None:
        path, staged = self._paths()
        extents = sorted(p for m in messages if m for p in m.parts)
        if any(a[1] > b[0] for a, b in zip(extents, extents[1:], strict=False)):
            self.abort(messages)
            raise ValueError("extents of the image overlap")
        end = max((e for _, e in extents), default=0)
        os.truncate(staged, max(-(-end // SECTOR_BYTES), self.sectors) * SECTOR_BYTES)
        os.replace(staged, path)

    def abort(self, messages: list[Staged | None]) -> None:
        _, staged = self._paths()
        if os.path.exists(staged):
            os.remove(staged)


def _joined(extents: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Extents with neighbours put together, so that a task reports few; overlapping ones stay apart."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(extents):
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


class DiscImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "disc_image"

    def schema(self) -> str:
        return "at bigint, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ImageWriter(self.options["path"], int(self.options.get("sectors", "0")))


def register(spark: SparkSession) -> None:
    """Make the data sources known to a session, and let them see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SectorContainer, ByteRanges, WholeFiles, DiscImage):
        spark.dataSource.register(source)
