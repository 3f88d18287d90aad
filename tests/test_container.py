"""Containers written, read back, and spoiled in one field at a time."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sectorlake.functions import units as U
from sectorlake.operators import adpcm, placement, rules
from sectorlake.sources import container

SECONDS, FPS, RATE = 27, 12, 31468


def build(spark, seconds=SECONDS):
    """A container of payloads of 300 to 8000 bytes, drawn at random, with random audio."""
    rng = random.Random(seconds)
    n = seconds * FPS
    payload = [(0, i, rng.randbytes(rng.randint(300, 8000))) for i in range(n)]
    frames = spark.createDataFrame([("clip", i, p) for _, i, p in payload], "stream_id string, frame bigint, payload binary")
    audio = rng.randbytes(seconds * RATE // 2)
    total = len(audio)
    blocks = placement.audio_blocks(spark.createDataFrame([("clip", total)], "stream_id string, audio_bytes bigint"))
    data = spark.createDataFrame([("clip", k, audio[k * 65536 : (k + 1) * 65536]) for k in range(-(-total // 65536))], "stream_id string, block bigint, audio binary")
    refills = placement.refill_schedule(blocks, FPS, 1, RATE)
    preroll = min(64, -(-total // 2048))
    start = -(-(64 + 32 * n) // 2048)
    layout = placement.interleaved(frames, refills, 4, start, preroll).join(data, ["stream_id", "block"], "left")
    layout = layout.select(
        "stream_id", "frame", "payload", "audio", "video_sector", F.octet_length("payload").alias("video_size"), F.lit(4).alias("video_sectors"), F.crc32("payload").alias("video_crc32"),
        "audio_sector", F.col("audio_sectors").alias("a_sectors"), F.when(F.col("audio_sectors") > 0, F.col("block") * 65536).otherwise(0).alias("audio_byte_offset"), F.lit(0).alias("entry_flags"),
    )
    head = spark.createDataFrame(
        [("clip", 256, 240, FPS, 1, n, 1, 32 * n, start, 4, total, -(-total // 2048), preroll, 32, 65536, RATE, 0, 0, audio[: preroll * 2048])],
        "stream_id string, " + ", ".join(f"{c} bigint" for c in container.HEADER) + ", preroll binary",
    )
    return container.assemble(head, layout), payload, audio


def found(files):
    sized = files.withColumn("file_bytes", F.octet_length("content").cast("long")) if "file_bytes" not in files.columns else files
    return {r["rule"] for r in rules.violations(container.streams(sized), container.frames(sized)).collect()}


@pytest.fixture(scope="module")
def clip(spark, tmp_path_factory):
    files, payload, audio = build(spark)
    folder = str(tmp_path_factory.mktemp("clips"))
    container.save_files(files.withColumn("stream_id", F.lit("clip.bin")), folder)
    return folder, payload, audio


def test_round_trip(spark, clip):
    folder, payload, audio = clip
    files = container.read_files(spark, folder)
    head = container.streams(files).first()
    assert head["magic"] == "PCFV0001" and head["codec"] == "adpcm" and head["frame_count"] == SECONDS * FPS and head["file_bytes"] % 2048 == 0
    got = {r["frame"]: r for r in container.frames(files, payloads=True).collect()}
    assert all(bytes(got[i]["payload"]) == p and got[i]["video_crc32"] == got[i]["payload_crc32"] == zlib.crc32(p) for _, i, p in payload)
    chunks = sorted((r["byte_offset"], bytes(r["data"])) for r in container.audio_chunks(files).collect())
    assert b"".join(d for _, d in chunks) == audio and [o for o, _ in chunks] == [0] + [131072 + 65536 * k for k in range(len(chunks) - 1)]
    assert found(files) == set()


def test_refills_come_before_their_deadline(spark, clip):
    carried = [r["frame"] for r in container.frames(container.read_files(spark, clip[0])).where("a_sectors > 0").orderBy("frame").collect()]
    assert carried and all(f / FPS <= (k + 1) * 131072 / RATE for k, f in enumerate(carried))
    short, _, _ = build(spark, 3)
    assert container.frames(short).where("a_sectors > 0").count() == 0 and found(short) == set()


def le(value, size=4):
    return int(value).to_bytes(size, "little")


MUTATIONS = [
    (3, b"?", "V1"), (10, le(200, 2), "V1"), (12, le(0, 2), "V2"), (20, le(7), "V3"), (28, le(6), "V4"), (52, le(11025), "V5"), (48, le(4096), "V5"),
    (36, le(3), "V6"), (40, le(45), "V7"), (64 + 8, le(11), "V8"), (64 + 12, le(77), "V9"), (18, le(2, 2), "V13"),
]


def test_mutations_are_found(spark, clip):
    files = container.read_files(spark, clip[0])
    first = container.frames(files).where("a_sectors > 0").agg(F.min("frame")).first()[0]
    every = [*MUTATIONS, (64 + 32 * first + 24, le(131072 + 6144), "V10"), (64 + 32 * first + 20, le(0), "V12")]
    content = bytes(files.first()["content"])
    spoiled = [(f"m{k}", len(content), content[:at] + data + content[at + len(data) :]) for k, (at, data, _) in enumerate(every)]
    sized = spark.createDataFrame(spoiled, "stream_id string, file_bytes bigint, content binary").repartition(4).persist()
    broken = rules.violations(container.streams(sized), container.frames(sized)).persist()
    got = {(r["stream_id"], r["rule"]) for r in broken.select("stream_id", "rule").distinct().collect()}
    assert all((f"m{k}", rule) in got for k, (_, _, rule) in enumerate(every))
    assert {r["stream_id"]: r["rule"] for r in rules.first_violation(broken).collect()}["m5"] == "V5"


def chord(rate):
    """Three low tones of unlike strength, a fifth of a second long."""
    turn = 2 * math.pi / rate
    return [round(7000 * math.sin(turn * rate / 64 * i) + 2500 * math.sin(turn * rate / 93 * i + 1) + 900 * math.sin(turn * rate / 150 * i)) for i in range(rate // 5)]


@pytest.mark.parametrize(("rate", "code"), list(U.ADPCM_RATES.items()))
def test_closed_loop_quality(spark, rate, code):
    signals = spark.createDataFrame([("t", chord(rate))], "signal_id string, pcm array<int>")
    encoded = adpcm.encode_signals(signals, "signal_id", "pcm", code)
    data = encoded.select("signal_id", adpcm.codes_to_bytes(F.col("codes")).alias("b")).select("signal_id", adpcm.bytes_to_codes(F.col("b")).alias("codes"))
    got = adpcm.decode_signals(data, "signal_id", "codes", code).first()["decoded"]
    want = chord(rate)
    noise = sum((a - b) ** 2 for a, b in zip(want, got, strict=False)) or 1
    assert 10 * math.log10(sum(a * a for a in want) / noise) > 18


def test_zero_bytes_ramp_and_the_pad_is_quiet(spark):
    codes = spark.createDataFrame([("zero", "0" * 1500), ("pad", "08" * 700)], "signal_id string, codes string")
    got = {r["signal_id"]: r["decoded"] for r in adpcm.decode_signals(codes, "signal_id", "codes").collect()}
    assert max(got["zero"]) > 30000 and max(map(abs, got["pad"])) < 64
    both = spark.createDataFrame([("0123456789ABCDEF",)], "c string").select(adpcm.codes_to_bytes(F.col("c")).alias("low"), adpcm.codes_to_bytes(F.col("c"), False).alias("high")).first()
    assert bytes(both["low"]).hex() == "1032547698badcfe" and bytes(both["high"]).hex() == "0123456789abcdef"
