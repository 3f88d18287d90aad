"""Validation as data: each rule is a filter that yields (stream_id, frame, rule, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlake.functions.prefix import exclusive_sums, running
from sectorlake.functions.units import ADPCM_RATES, FLAG_ADPCM, HALF_BYTES, HALF_SECTORS, sectors
from sectorlake.operators.placement import DENSE

# The container's header and entry sizes, limits, and magic.
HEADER_BYTES, ENTRY_BYTES = 64, 32
MAX_FRAMES, MAX_STRIDE, MAX_MP2_SECTORS = 4096, 4, 8
WIDTH, HEIGHT, MAGIC = 256, 240, "PCFV0001"


def header_rules() -> dict[str, Column]:
    """Conditions over the ``stream`` table that must hold, in checking order; null counts as broken."""
    c = F.col
    index = c("frame_count") * ENTRY_BYTES
    halves = (c("preroll_sectors") > 0) & ((c("preroll_sectors") % HALF_SECTORS == 0) | (c("preroll_sectors") == c("audio_sectors")))
    adpcm = c("flags").bitwiseAND(F.lit(FLAG_ADPCM)) != 0
    return {
        "V1": (c("magic") == MAGIC) & (c("width") == WIDTH) & (c("height") == HEIGHT),
        "V2": c("frame_count").between(1, MAX_FRAMES) & (c("fps_num") > 0) & (c("fps_den") > 0) & (c("fps_num") <= 60 * c("fps_den")),
        "V3": (c("index_bytes") == index) & (c("data_start_sector") >= sectors(HEADER_BYTES + c("index_bytes"))),
        "V4": c("max_video_sectors").between(1, MAX_STRIDE) & (c("file_bytes") % 2048 == 0),
        "V5": ~adpcm | ((c("ring_half_bytes") == HALF_BYTES) & c("audio_rate_hz").isin(*ADPCM_RATES)),
        "V6": c("audio_sectors") == sectors(c("audio_bytes")),
        "V7": ~adpcm | halves,
    }


def frame_rules() -> dict[str, Column]:
    """Conditions over ``frame`` joined with ``stream``."""
    c = F.col
    end = c("video_sector") + c("video_sectors")
    chunk = c("a_sectors") > 0
    size = F.least(F.lit(HALF_BYTES).cast("long"), c("audio_bytes") - c("audio_byte_offset"))
    adpcm = c("flags").bitwiseAND(F.lit(FLAG_ADPCM)) != 0
    return {
        "V8": c("video_sectors").between(1, c("max_video_sectors")) & (c("video_size") > 0) & (c("video_size") <= c("video_sectors") * 2048)
        & (c("video_sector") >= c("data_start_sector")) & (end * 2048 <= c("file_bytes")),
        "V9": c("payload_crc32").isNull() | (c("payload_crc32") == c("video_crc32")),
        "V10": ~(chunk & adpcm) | ((c("audio_byte_offset") == c("next_block") * HALF_BYTES) & (c("a_sectors") <= HALF_SECTORS)
        & (c("a_sectors") >= sectors(size)) & ((c("audio_sector") + c("a_sectors")) * 2048 <= c("file_bytes"))),
        "V13": ~chunk | adpcm | (c("a_sectors") <= MAX_MP2_SECTORS),
    }


def _broken(rows: DataFrame, rules: dict[str, Column], frame: Column) -> DataFrame:
    """One row for each rule that doesn't hold, from a single pass over ``rows``."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.select("stream_id", frame.alias("frame"), F.explode(F.array_compact(failed)).alias("rule"))


def violations(streams: DataFrame, frames: DataFrame) -> DataFrame:
    """All broken rules of containers given as ``stream`` and ``frame`` tables.

    ``frames`` has (stream_id, frame, video_sector, video_size, video_sectors, video_crc32, audio_sector,
    a_sectors, audio_byte_offset, payload_crc32).
    """
    preroll = F.call_function("div", F.col("preroll_sectors").cast("long") + (HALF_SECTORS - 1), F.lit(HALF_SECTORS).cast("long"))
    counted = exclusive_sums(frames, "frame", {"_carried": F.when(F.col("a_sectors") > 0, 1).otherwise(0)}, ("stream_id",), width=DENSE)
    joined = counted.join(streams.drop("magic", "width", "height"), "stream_id").withColumn("next_block", preroll + F.col("_carried"))
    extents = frames.select("stream_id", "frame", F.col("video_sector").alias("start"), (F.col("video_sector") + F.col("video_sectors")).alias("end")).unionByName(
        frames.where("a_sectors > 0").select("stream_id", "frame", F.col("audio_sector").alias("start"), (F.col("audio_sector") + F.col("a_sectors")).alias("end"))
    )
    # Extents of a timeline lie dense, so chunks of sectors are chunks of rows.
    met = running(extents, ["start", "end", "frame"], {"before": ("last", F.col("end"))}, ("stream_id",), width=MAX_STRIDE * DENSE)
    overlapping = met.where("start < before").select("stream_id", "frame", F.lit("V11").alias("rule"))
    chunks = frames.groupBy("stream_id").agg(F.sum(F.when(F.col("a_sectors") > 0, 1).otherwise(0)).alias("chunks"))
    covered = streams.join(chunks, "stream_id", "left").where(F.col("flags").bitwiseAND(F.lit(FLAG_ADPCM)) != 0)
    blocks = F.call_function("div", F.col("audio_bytes").cast("long") + (HALF_BYTES - 1), F.lit(HALF_BYTES).cast("long"))
    short = covered.where(preroll + F.coalesce("chunks", F.lit(0)) != blocks).select("stream_id", F.lit(None).cast("long").alias("frame"), F.lit("V12").alias("rule"))
    return (
        _broken(streams, header_rules(), F.lit(None).cast("long"))
        .unionByName(_broken(joined, frame_rules(), F.col("frame").cast("long")))
        .unionByName(overlapping.withColumn("frame", F.col("frame").cast("long")))
        .unionByName(short)
    )


def first_violation(found: DataFrame) -> DataFrame:
    """The violation that a checker which stops early would report, per stream."""
    number = F.substring("rule", 2, 9).cast("int")
    return found.groupBy("stream_id").agg(F.min_by(F.struct("rule", "frame"), F.struct(number, F.coalesce("frame", F.lit(-1)))).alias("first")).select(
        "stream_id", "first.rule", "first.frame"
    )


def gate(metrics: DataFrame, key: str, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, metric, value, limit) of metrics outside their limit (``max`` or ``min``)."""
    rows = [
        F.when((F.col(m) > x) if kind == "max" else (F.col(m) < x), F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("limit")))
        for m, (kind, x) in limits.items()
    ]
    return metrics.select(key, F.explode(F.array_compact(F.array(*rows))).alias("v")).select(key, "v.metric", "v.value", "v.limit")
