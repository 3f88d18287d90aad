"""The indexed sector container as tables, and back (S1-S5, K1, K2, M1-M6): binary columns, no Python in the rows' path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions.units import SECTOR_BYTES, codec, little_endian

# The header's fields (offset, size) behind its 8-byte magic, and the index entry's.
MAGIC = b"PCFV0001"
HEADER = {
    "width": (8, 2), "height": (10, 2), "fps_num": (12, 2), "fps_den": (14, 2), "frame_count": (16, 2), "flags": (18, 2),
    "index_bytes": (20, 4), "data_start_sector": (24, 4), "max_video_sectors": (28, 4), "audio_bytes": (32, 4), "audio_sectors": (36, 4),
    "preroll_sectors": (40, 4), "refill_sectors": (44, 4), "ring_half_bytes": (48, 4), "audio_rate_hz": (52, 4), "reserved0": (56, 4), "reserved1": (60, 4),
}
ENTRY = ["video_sector", "video_size", "video_sectors", "video_crc32", "audio_sector", "a_sectors", "audio_byte_offset", "entry_flags"]
HEADER_BYTES, ENTRY_BYTES = 64, 32


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, file_bytes, content) of each file; paths are whatever Spark's readers open."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("stream_id"), F.col("length").alias("file_bytes"), "content")


def streams(files: DataFrame) -> DataFrame:
    """M1/S3: one row of header fields per file, with the codec that its flags name."""
    fields = [little_endian(F.col("content"), at, size).alias(name) for name, (at, size) in HEADER.items()]
    head = files.select("stream_id", "file_bytes", F.decode(F.substring("content", 1, 8), "ISO-8859-1").alias("magic"), *fields)
    return head.withColumn("codec", codec(F.col("flags"), F.col("audio_bytes")))


def _slice(content: Column, at: Column, size: Column) -> Column:
    return F.substring(content, (at + 1).cast("int"), size.cast("int"))


def frames(files: DataFrame, payloads: bool = False) -> DataFrame:
    """M2: one row per index entry, with the payload's CRC-32 as stored and as computed, and the payload if asked for.

    Entries are cut out of the file first and decoded from their own 32 bytes, since every access to the
    content copies it.
    """
    count = little_endian(F.col("content"), *HEADER["frame_count"])
    field = lambda entry, name: little_endian(entry, 4 * ENTRY.index(name), 4)

    def with_payload(entry: Column) -> Column:
        data = _slice(F.col("content"), field(entry, "video_sector") * SECTOR_BYTES, field(entry, "video_size"))
        return F.struct(entry.alias("entry"), (data if payloads else F.crc32(data)).alias("data"))

    entries = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: _slice(F.col("content"), HEADER_BYTES + i * ENTRY_BYTES, F.lit(ENTRY_BYTES)))
    listed = files.where(count > 0).select("stream_id", F.posexplode(F.transform(entries, with_payload)).alias("frame", "e"))
    data = F.col("e.data")
    made = [F.crc32(data).alias("payload_crc32"), data.alias("payload")] if payloads else [data.alias("payload_crc32")]
    return listed.select("stream_id", F.col("frame").cast("long").alias("frame"), *[field(F.col("e.entry"), n).alias(n) for n in ENTRY], *made)


def audio_chunks(files: DataFrame) -> DataFrame:
    """(stream_id, byte_offset, data): the preroll and each frame's chunk, cut to the audio's length."""
    head = streams(files)
    content = files.select("stream_id", "content")
    preroll = head.where("preroll_sectors > 0").select(
        "stream_id", F.lit(0).cast("long").alias("byte_offset"), F.col("data_start_sector").alias("sector"),
        F.least(F.col("audio_bytes"), F.col("preroll_sectors") * SECTOR_BYTES).alias("n"),
    )
    carried = frames(files).where("a_sectors > 0").join(head.select("stream_id", "audio_bytes"), "stream_id").select(
        "stream_id", F.col("audio_byte_offset").alias("byte_offset"), F.col("audio_sector").alias("sector"),
        F.least(F.col("audio_bytes") - F.col("audio_byte_offset"), F.col("a_sectors") * SECTOR_BYTES).alias("n"),
    )
    cut = preroll.unionByName(carried).join(content, "stream_id")
    return cut.select("stream_id", "byte_offset", _slice(F.col("content"), F.col("sector") * SECTOR_BYTES, F.col("n")).alias("data"))


def little_endian_bytes(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def _padded(data: Column, n_sectors: Column) -> Column:
    """Binary data and zero bytes up to whole sectors."""
    missing = (n_sectors * SECTOR_BYTES - F.octet_length(data)).cast("int")
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), missing)))


def assemble(head: DataFrame, layout: DataFrame) -> DataFrame:
    """K1/K2: (stream_id, content): files from header fields and placed frames.

    ``head`` has the header's fields and ``preroll`` (binary, may be null); ``layout`` the index entry's
    fields, ``frame``, ``payload`` and ``audio`` (binary, null without a chunk).  One row is one file of at
    most 4096 frames; its parts are gathered by an ordered binary aggregate.
    """
    entry = F.concat(*[little_endian_bytes(F.coalesce(F.col(c), F.lit(0)), 4) for c in ENTRY])
    body = F.concat(_padded(F.col("payload"), F.col("video_sectors")), F.when(F.col("a_sectors") > 0, _padded(F.col("audio"), F.col("a_sectors"))).otherwise(F.unhex(F.lit(""))))
    parts = layout.select("stream_id", "frame", entry.alias("entry"), body.alias("body"))
    gathered = parts.groupBy("stream_id").agg(F.expr("listagg(entry) within group (order by frame)").alias("index"), F.expr("listagg(body) within group (order by frame)").alias("data"))
    start = F.concat(F.lit(MAGIC), *[little_endian_bytes(F.coalesce(F.col(c), F.lit(0)), size) for c, (_, size) in HEADER.items()])
    preroll = F.when(F.col("preroll_sectors") > 0, _padded(F.col("preroll"), F.col("preroll_sectors"))).otherwise(F.unhex(F.lit("")))
    joined = head.withColumn("start", start).join(gathered, "stream_id")
    return joined.select("stream_id", F.concat(_padded(F.concat("start", "index"), F.col("data_start_sector")), preroll, "data").alias("content"))


def save_files(rows: DataFrame, folder: str) -> None:
    """Write each row's content as a file of a folder that all executors share; the files appear when all are written.

    ``folder`` is a path or any address that Arrow's file systems open (file, hdfs, s3, gs).
    """
    from sectorlake.sources.files import register

    register(rows.sparkSession)
    rows.select("stream_id", "content").write.format("whole_files").mode("append").save(folder)
