import json
import struct

from pyspark.sql import functions as F

from sectorlake.functions import units as U
from sectorlake.operators import lookup, placement
from sectorlake.plans import images
from sectorlake.sources import riff, text
from sectorlake.streaming import ring


def wav(samples, channels=1, rate=8000, smpl=None):
    data = struct.pack(f"<{len(samples)}h", *samples)
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    body += b"LIST" + struct.pack("<I", 16) + b"INFOICMT" + struct.pack("<I", 3) + b"abc\0"
    body += b"data" + struct.pack("<I", len(data)) + data
    if smpl:
        body += b"smpl" + struct.pack("<I", 60) + struct.pack("<7I2I", *[0] * 7, 1, 0) + struct.pack("<6I", 0, 0, *smpl, 0, 0)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_riff_and_wav(spark):
    files = spark.createDataFrame([("m", wav([1, -2, 3])), ("s", wav([10, 20, -30, -50], 2, 16000, (1, 2))), ("none", b""), ("junk", b"abc")], "stream_id string, content binary")
    listed = {(r["stream_id"], r["level"], r["chunk_id"]) for r in riff.chunks(files).collect()}
    assert {("m", 0, "RIFF"), ("m", 1, "fmt "), ("m", 1, "LIST"), ("m", 2, "ICMT"), ("m", 1, "data"), ("s", 1, "smpl")} <= listed
    heads = {r["stream_id"]: r for r in riff.formats(files).collect()}
    assert heads["m"]["rate"] == 8000 and heads["s"]["channels"] == 2 and tuple(heads["s"]["loop"]) == (1, 2) and heads["m"]["loop"] is None
    got = sorted((r["stream_id"], r["pos"], r["sample"]) for r in riff.mono_samples(files).collect())
    assert got == [("m", 0, 1.0), ("m", 1, -2.0), ("m", 2, 3.0), ("s", 0, 15.0), ("s", 1, -40.0)]


def test_text_sources(spark, tmp_path):
    lines = ["# a comment", "binary ./game.bin", "name Disc #1 of 2 ", "", "makerid ABC", "maker  Somebody", "version 256", "asset a b.dat", "unheard of", "alone", " name late", "blocks\t12", "lbaheader x.h"]
    (tmp_path / "disc.txt").write_text("\n".join(lines) + "\n")
    got = {(r["directive"], r["value"], r["known"]) for r in text.directives(spark, str(tmp_path / "disc.txt")).collect()}
    assert got == {
        ("binary", "./game.bin", True), ("name", "Disc #1 of 2 ", True), ("makerid", "ABC", True), ("maker", " Somebody", True), ("version", "256", True), ("asset", "a b.dat", True),
        ("unheard", "of", False), ("alone", None, False), ("", "name late", False), ("blocks\t12", None, False), ("lbaheader", "x.h", True),
    }
    folder = tmp_path / "stats"
    folder.mkdir()
    (folder / "stats_1.json").write_text(json.dumps({"checkpoint": 1, "frames": 10}))
    (folder / "stats_2.json").write_text("{ broken")
    assert [(r["report"], r["frames"]) for r in text.counter_reports(spark, str(folder), "checkpoint int, frames int").collect()] == [("stats_1.json", 10)]
    lines = [
        "  0x00008010   g_done", "                0x8014 g_frame_count  ", " .bss.g_refills", "                0x00008018        0x4 main.o", ".bss.g_requests 0x801c 0x4 main.o", "  0x9999 g_requests",
        "  0x1 g_refills", "  0x8012 g_done", "other", " .bss.lonely", "no numbers", "0xffff0000 g_far", " .bss.twice 0x1 0x2", " .bss.twice 0x3 0x8",
    ]
    (tmp_path / "map").write_text("\n".join(lines))
    found = text.symbols(spark, str(tmp_path / "map"))
    assert {(r["symbol"], r["address"], r["bytes"]) for r in found.collect()} == {
        ("g_done", 0x8010, 4), ("g_frame_count", 0x8014, 4), ("g_refills", 0x8018, 4), ("g_requests", 0x801C, 4), ("g_far", 0xFFFF0000, 4), ("twice", 3, 8),
    }
    dump = spark.createDataFrame([(struct.pack("<I2xH2I", 7, 0, 0, 0)[:4] + struct.pack("<4I", 0xFFFFFF01, 0xFFFF0191, 70_000, 5),)], "content binary")
    values = {r["symbol"]: r["value"] for r in text.peek(found, dump, 0x800C).collect()}
    assert values == {"g_done": 1, "g_frame_count": 0x191, "g_refills": 70_000, "g_requests": 5}
    assert spark.range(1).select(text.c_array(F.lit("x"), F.lit(bytearray(b"\x01\xff")))).first()[0] == "static const unsigned char x[2] = { 0x01,0xff, };"


def test_units(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(U.sectors(F.lit(n))) for n in (0, 1, 2048, 2049)] == [0, 1, 1, 2]
    assert one(U.align_down(F.lit(1535))) == 1024 and one(U.swap_nibbles(F.lit(0x1F))) == 0xF1
    assert [one(U.rate_code(F.lit(r))) for r in (31468, 3934, 32000)] == [0, 3, None] and one(U.rate_code_by_threshold(F.lit(16000))) == 1
    assert [one(U.category(F.lit(v))) for v in (0, 1, -1, 255, -256)] == [0, 1, 1, 8, 9] and [one(U.payload(F.lit(v))) for v in (5, -5)] == [5, 2]
    assert [one(U.round_half_away(F.lit(v))) for v in (2.5, -2.5, 0.49)] == [3, -3, 0] and one(U.fields_per_frame(F.lit(15), F.lit(1))) == 4
    assert one(U.circular_distance(F.lit(5), F.lit(2), 10)) == 7 and one(U.macro_name(F.lit("a/b-1.c"))) == "A_B_1_C"
    word = one(U.pack_stereo(F.lit(5).cast("long"), F.lit(1000).cast("long")))
    assert (word & 1023, word >> 16) == (5, 1000)
    head = images.mp2_header(F.lit(bytearray([0xFF, 0xF4, 0x48, 0xC0])))
    assert one(head).asDict() == {"valid": True, "version": "lsf", "kbps_index": 3, "rate_index": 2, "padding": 0, "channels": 1}


def test_seeks_and_settling(spark):
    asked = spark.createDataFrame([("frame", 7), ("lba", 520), ("data", 3), ("stream", 9), ("none", 0)], "mode string, value bigint")
    got = {r["mode"]: (r["sector"], r["frame_direct"]) for r in lookup.resolve_seek(asked, 500, 63).collect()}
    assert got["lba"][0] == 20 and got["data"][0] == 66 and got["stream"][0] == 9 and got["frame"][1] == 7 and got["none"][1] == 0
    calls = []
    settled = placement.settle_addresses(lambda a: calls.append(1) or a.selectExpr("least(x + 1, 3) as x"), spark.createDataFrame([(1,)], "x int"))
    assert settled.first()["x"] == 3 and len(calls) == 3


def test_streaming_ring_equals_batch(spark, tmp_path):
    rows = []
    for s in range(3):
        for k in range(8):
            if (k + s) % 5:
                rows.append((f"s{s}", 10 * k, "loaded", k))
            rows.append((f"s{s}", 10 * k + 5, "boundary", k))
    schema = "stream_id string, field bigint, kind string, block bigint"
    for i in range(3):  # three arrivals, in order of fields
        spark.createDataFrame([r for r in rows if r[1] // 30 == i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = ring.underruns(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ring").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.sql("select stream_id, block, underrun from ring").collect()))
    assert got == sorted(map(tuple, ring.underruns_batch(spark.createDataFrame(rows, schema)).collect()))
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_empty_inputs(spark):
    frames = spark.createDataFrame([], "frame bigint, start_sector bigint, end_sector bigint")
    probes = spark.createDataFrame([], "sector bigint")
    assert lookup.sector_to_frame(probes, "sector", frames).count() == 0
    assert placement.variable_slots(spark.createDataFrame([], "k bigint, n bigint"), "k", F.col("n")).count() == 0
