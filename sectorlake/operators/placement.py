"""Placement of payloads and audio blocks on a sector timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.functions.prefix import dealt, exclusive_sums, running
from sectorlake.functions.units import HALF_BYTES, PREROLL_BLOCKS, SECTOR_BYTES, div, sectors

#: Consecutive frames, blocks or the like of a chunk in two-level sums.
DENSE = 4096


def variable_slots(payloads: DataFrame, key: str, n_bytes: Column, first_sector: int = 0) -> DataFrame:
    """Each payload takes as many sectors as it needs, one behind the other in ``key`` order."""
    sized = payloads.withColumn("sectors", sectors(n_bytes))
    return exclusive_sums(sized, key, {"start_sector": F.col("sectors")}).withColumn("start_sector", F.col("start_sector") + first_sector)


def refill_schedule(blocks: DataFrame, num: int, den: int, rate: int) -> DataFrame:
    """(block, frame) for each refill block: its deadline, pushed on so that no frame carries two.

    ``blocks`` has stream_id and block (0, 1, ...).  The recursion f = max(deadline, previous + 1) is
    block + running max(deadline - block).
    """
    refills = blocks.where(F.col("block") >= PREROLL_BLOCKS)
    deadline = div((F.col("block").cast("long") - 1) * (2 * HALF_BYTES) * num, rate * den)
    late = running(refills.withColumn("deadline_frame", deadline), ["block"], {"_late": ("max", F.col("deadline_frame") - F.col("block"))}, ("stream_id",), inclusive=True, width=DENSE)
    return late.withColumn("frame", F.col("block") + F.col("_late")).drop("_late")


def audio_blocks(streams: DataFrame) -> DataFrame:
    """(stream_id, block, bytes, sectors) of each stream's audio_bytes cut into ring halves."""
    count = div(F.col("audio_bytes") + (HALF_BYTES - 1), HALF_BYTES)
    cut = streams.where("audio_bytes > 0").select("stream_id", "audio_bytes", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    size = F.least(F.lit(HALF_BYTES).cast("long"), F.col("audio_bytes") - F.col("block") * HALF_BYTES)
    return cut.select("stream_id", "block", size.alias("bytes"), sectors(size).alias("sectors"))


def interleaved(frames: DataFrame, refills: DataFrame, stride: int, data_start: int, preroll: int) -> DataFrame:
    """W1 + J4: fixed-stride frames, each followed by the refill block that it carries, if any.

    ``frames`` has (stream_id, frame); ``refills`` (stream_id, frame, block, sectors).
    """
    carried = frames.join(refills.select("stream_id", "frame", "block", F.col("sectors").alias("audio_sectors")), ["stream_id", "frame"], "left")
    carried = carried.withColumn("audio_sectors", F.coalesce("audio_sectors", F.lit(0)))
    placed = exclusive_sums(carried, "frame", {"_before": F.col("audio_sectors") + stride}, ("stream_id",), width=DENSE)
    return placed.withColumn("video_sector", F.col("_before") + data_start + preroll).drop("_before").withColumn(
        "audio_sector", F.when(F.col("audio_sectors") > 0, F.col("video_sector") + stride).otherwise(0)
    )


def paced_chunks(frames: DataFrame, lead: int, chunk: int) -> DataFrame:
    """Audio bytes paced by the video: ``lead`` sectors on frame 0, then a whole chunk at the first
    frame that is due one, at most one a frame, and what is left on the last frame.

    ``frames`` has (stream_id, frame, n_frames, audio_bytes).  A chunk is due once the target passes
    all but a part of it, which bounds the chunks by c = ceil of a non-decreasing line; one a frame
    makes their number frame + running min(c - frame), a window instead of a fold.
    """
    total = sectors(F.col("audio_bytes"))
    target = div((F.col("frame").cast("long") + 1) * F.col("audio_bytes"), F.col("n_frames"))
    over = target - (lead + chunk - 1) * SECTOR_BYTES
    due = F.when(over <= 0, F.lit(0).cast("long")).otherwise(div(over + (chunk * SECTOR_BYTES - 1), chunk * SECTOR_BYTES))
    due = frames.withColumn("due", F.when(F.col("frame") == 0, F.lit(0).cast("long")).otherwise(due))
    counted = running(due, ["frame"], {"_least": ("min", F.col("due") - F.col("frame"))}, ("stream_id",), width=DENSE)
    earlier = F.coalesce(F.col("frame") - 1 + F.col("_least"), F.lit(0))  # chunks up to the frame before
    counted = counted.withColumn("chunks", F.col("frame") + F.least("_least", F.col("due") - F.col("frame")))
    begin = F.when(F.col("frame") == 0, F.lit(0).cast("long")).otherwise(F.least(total, lead + earlier * chunk))
    last = F.col("frame") == F.col("n_frames") - 1
    end = F.when(last, total).otherwise(F.least(total, lead + F.col("chunks") * chunk))
    placed = counted.select("stream_id", "frame", "audio_bytes", begin.alias("from_sector"), (end - begin).alias("audio_sectors"))
    offset = F.when(F.col("audio_sectors") > 0, F.col("from_sector") * SECTOR_BYTES).otherwise(0)
    return placed.select("stream_id", "frame", "audio_sectors", offset.cast("long").alias("audio_byte_offset"))


def overlaps(extents: DataFrame, by: list[str], start: str, end: str, tie: list[str]) -> DataFrame:
    """Extents that begin before the previous one, in (start, end, tie) order, has ended; rows are distinct in it."""
    found = running(extents, [start, end, *tie], {"previous_end": ("last", F.col(end))}, tuple(by))
    return found.where(F.col(start) < F.col("previous_end"))


def contiguous_batches(items: DataFrame, by: list[str], position: str, cap: int = 8) -> DataFrame:
    """Runs of adjacent positions, cut into batches of at most ``cap``; repeated positions count once.

    One shuffle and one order serve all steps: rows that begin a batch are told in it, and a batch has as
    many rows as lie before the next one's.  A task holds a bounded slice of the streams, sorted.
    """
    order = Window.partitionBy(*by).orderBy(position)
    before, row = F.lag(position).over(order), F.row_number().over(order)
    rows = dealt(items.select(*by, position), by).withColumns({"_before": before, "_row": row}).where((F.col("_row") == 1) | ~F.col("_before").eqNullSafe(F.col(position)))
    rows = rows.withColumns({"_before": before, "_row": row.cast("long"), "_last": F.lead(F.lit(1)).over(order).isNull()})
    rows = rows.withColumn("_new", F.coalesce(F.col(position) != F.col("_before") + 1, F.lit(True)))
    rows = rows.withColumns({"run": F.sum(F.col("_new").cast("int")).over(order), "_within": F.col("_row") - F.max(F.when(F.col("_new"), F.col("_row"))).over(order)})
    marks = rows.withColumn("_first", F.col("_within") % cap == 0).where(F.col("_first") | F.col("_last"))
    upto = F.lead(F.col("_row") + F.when(F.col("_first"), 0).otherwise(1)).over(order)
    sized = marks.withColumn("n", F.coalesce(upto, F.col("_row") + 1) - F.col("_row")).where("_first")
    return sized.select(*by, "run", div(F.col("_within"), cap).alias("batch"), F.col(position).alias("first"), "n")


def disc_addresses(files: DataFrame, key: str, n_bytes: Column, base: int = 2) -> DataFrame:
    """Logical block addresses of files that are padded to whole sectors, from ``base`` on."""
    return variable_slots(files, key, n_bytes, base).withColumnRenamed("start_sector", "lba")


def settle_addresses(rebuild, addresses: DataFrame, passes: int = 4) -> DataFrame:
    """Rebuild until the address table repeats, ``passes`` times at most."""
    for _ in range(passes):
        after = rebuild(addresses)
        if not after.exceptAll(addresses).limit(1).count() and not addresses.exceptAll(after).limit(1).count():
            return after
        addresses = after
    return addresses

