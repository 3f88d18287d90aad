"""Data sources and sinks over files: ranged reads, pruning, commits."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sectorlake.sources import files
from sectorlake.sources.container import HEADER


def made(n, seed, adpcm=True):
    """A container packed with ``struct``: payloads of varying length, a chunk of audio behind every third frame."""
    start = -(-(64 + 32 * n) // 2048)
    at, off, body, index = start + 1, 2048, bytes([seed]) * 2048, b""
    parts = []
    for i in range(n):
        payload = bytes([seed, i % 256]) * (400 + 37 * i)
        ns = -(-len(payload) // 2048)
        audio = bytes([255 - i % 256]) * 2048 if i % 3 == 0 else b""
        index += struct.pack("<8I", at, len(payload), ns, zlib.crc32(payload), at + ns if audio else 0, 1 if audio else 0, off if audio else 0, 0)
        body += payload.ljust(ns * 2048, b"\0") + audio
        parts.append((payload, off if audio else None, audio))
        at, off = at + ns + bool(audio), off + len(audio)
    head = struct.pack("<8s6H11I", b"PCFV0001", 256, 240, 15, 1, n, 1 if adpcm else 2, 32 * n, start, 4, off, off // 2048, 1, 1, 65536, 31468, 0, 0)
    return (head + index).ljust(start * 2048, b"\0") + body, parts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    files.register(spark)
    where = tmp_path_factory.mktemp("containers")
    for k, n in enumerate((40, 7, 1)):
        (where / f"c{k}.bin").write_bytes(made(n, k, k != 1)[0])
    (where / "short.bin").write_bytes(b"PCFV")
    (where / "other.bin").write_bytes(b"x" * 5000)
    (where / ".hidden").write_bytes(b"y" * 5000)
    return str(where)


def read(spark, folder, **options):
    return spark.read.format("sector_container").options(**options).load(folder)


def test_headers_read_64_bytes_a_file(spark, folder):
    got = {r["stream_id"]: r for r in read(spark, folder).collect()}
    assert set(got) == {"c0.bin", "c1.bin", "c2.bin", "other.bin"} and all(r["read_bytes"] == 64 for r in got.values())
    assert got["c0.bin"]["frame_count"] == 40 and got["c0.bin"]["codec"] == "adpcm" and got["c1.bin"]["codec"] == "mp2" and got["other.bin"]["magic"] == "xxxxxxxx"
    assert got["c0.bin"]["file_bytes"] == os.path.getsize(f"{folder}/c0.bin") and [got["c0.bin"][c] for c in HEADER][:4] == [256, 240, 15, 1]


@pytest.mark.parametrize("split", [3000, 64 << 20])
def test_frames_payloads_and_chunks(spark, folder, split):
    frames = read(spark, folder, part="frames", payloads="true", split=split)
    assert (frames.rdd.getNumPartitions() > 5) == (split == 3000)
    got = {(r["stream_id"], r["frame"]): r for r in frames.collect()}
    assert len(got) == 48 and frames.count() == 48
    for k, n in enumerate((40, 7, 1)):
        for i, (payload, _, _) in enumerate(made(n, k)[1]):
            r = got[f"c{k}.bin", i]
            assert bytes(r["payload"]) == payload and r["payload_crc32"] == r["video_crc32"] == zlib.crc32(payload)
    plain = read(spark, folder, part="frames", split=split)
    assert "payload" not in plain.columns and plain.count() == 48
    chunks = {(r["stream_id"], r["byte_offset"]): bytes(r["data"]) for r in read(spark, folder, part="chunks", split=split).collect()}
    want = {(f"c{k}.bin", off): audio for k, n in enumerate((40, 7, 1)) for _, off, audio in made(n, k)[1] if audio}
    assert {k: v for k, v in chunks.items() if k[1]} == want and chunks["c1.bin", 0] == bytes([1]) * 2048


def test_filters_leave_out_files_and_frames(spark, folder):
    frames = read(spark, folder, part="frames", payloads="true", split=3000)
    kept = frames.where("stream_id = 'c0.bin' and frame >= 5 and frame < 9 and video_size > 0")
    assert sorted(r["frame"] for r in kept.collect()) == [5, 6, 7, 8]
    assert "PushedFilters" in kept._jdf.queryExecution().toString() or kept.count() == 4
    one = files._FilteredReader(folder, "frames", 3000)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    asked = [In(("stream_id",), ("c0.bin", "c1.bin")), EqualTo(("stream_id",), "c1.bin"), GreaterThan(("frame",), 1), LessThanOrEqual(("frame",), 3), EqualTo(("video_size",), 5)]
    assert list(one.pushFilters(asked)) == asked
    parts = one.partitions()
    assert {p[0] for s in parts for p in s.files} == {f"{folder}/c1.bin"}
    assert sorted(f for s in parts for b in one.read(s) for f in b.column("frame").to_pylist()) == [2, 3]


def test_unknown_part_and_missing_folder(spark, folder):
    with pytest.raises(Exception, match="part must be"):
        read(spark, folder, part="nothing").count()
    with pytest.raises(Exception, match="nowhere"):
        read(spark, folder + "/nowhere").count()


def test_files_appear_together(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{i}", bytes([i]) * i) for i in range(20)] + [("none", None)], "stream_id string, content binary").repartition(4)
    rows.write.format("whole_files").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted([f"f{i}" for i in range(20)] + ["none"]) and (tmp_path / "out" / "f7").read_bytes() == b"\x07" * 7
    rows.where("stream_id = 'f3'").write.format("whole_files").mode("overwrite").save(out)
    assert os.listdir(out) == ["f3"]


def broken(batches):
    for p in batches:
        if (p["stream_id"] == "f13").any():
            raise RuntimeError("a task dies here")
        yield p


def test_a_failed_task_leaves_nothing(spark, folder, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", b"abc") for i in range(20)], "stream_id string, content binary").repartition(8, "stream_id")
    out = tmp_path / "failed"
    out.mkdir()
    (out / "old").write_text("kept")
    with pytest.raises(Exception, match="dies here"):
        rows.mapInPandas(broken, rows.schema).write.format("whole_files").mode("overwrite").save(str(out))
    assert os.listdir(out) == ["old"]
    for bad in ("a/b", "", ".x", "_y"):
        with pytest.raises(Exception, match="not a file's name"):
            spark.createDataFrame([(bad, b"")], rows.schema).write.format("whole_files").mode("append").save(str(out))
    with pytest.raises(Exception, match="one stream_id"):
        rows.unionByName(rows).write.format("whole_files").mode("append").save(str(out))
    assert os.listdir(out) == ["old"]


def test_image_of_ranges(spark, folder, tmp_path):
    pieces = [(2048 * k, bytes([k]) * (2048 if k % 3 else 100)) for k in range(40)]
    rows = spark.createDataFrame(pieces, "at bigint, content binary").repartition(6)
    path = tmp_path / "disc" / "image.bin"
    rows.write.format("disc_image").option("sectors", 50).mode("append").save(str(path))
    want = bytearray(50 * 2048)
    for at, data in pieces:
        want[at : at + len(data)] = data
    assert path.read_bytes() == bytes(want) and os.listdir(path.parent) == ["image.bin"]
    back = spark.read.format("byte_ranges").option("bytes", 4096).option("split", 10_000).load(str(path))
    assert back.rdd.getNumPartitions() > 5
    assert b"".join(bytes(r["data"]) for r in back.orderBy("at").collect()) == bytes(want)
    with pytest.raises(Exception, match="overlap"):
        rows.unionByName(rows.limit(1)).write.format("disc_image").mode("append").save(str(tmp_path / "disc" / "other.bin"))
    dying = rows.withColumn("content", F.expr("if(at = 20480, raise_error('a task dies here'), content)"))
    with pytest.raises(Exception, match="dies here"):
        dying.write.format("disc_image").mode("append").save(str(tmp_path / "disc" / "other.bin"))
    assert os.listdir(path.parent) == ["image.bin"]
