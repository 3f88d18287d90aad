"""Position lookups: as-of and containment matching in one order of marks and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlake.functions.prefix import running
from sectorlake.functions.units import circular_distance


def last_at_or_before(probes: DataFrame, position: str, marks: DataFrame, mark: str, value: str) -> DataFrame:
    """(probes, value, mark) of the last mark at or before a position; of equal marks the one of the largest value.

    Null before the first mark.  Marks and probes are put in one order, in chunks of positions, and
    each probe takes the last mark that was met, so neither gaps nor busy stretches matter.
    """
    null = lambda df, column: F.lit(None).cast(df.select(column.alias("x")).schema["x"].dataType)
    probe, pair, tie = F.struct(*probes.columns), F.struct(mark, value), F.col(value)
    met = marks.where(F.col(mark).isNotNull()).select(
        F.col(mark).cast("long").alias("_pos"), F.lit(0).alias("_kind"), tie.alias("_tie"), pair.alias("_mark"), null(probes, probe).alias("_probe")
    )
    asked = probes.select(F.col(position).cast("long").alias("_pos"), F.lit(1).alias("_kind"), null(marks, tie).alias("_tie"), null(marks, pair).alias("_mark"), probe.alias("_probe"))
    found = running(met.unionByName(asked), ["_pos", "_kind", "_tie"], {"_found": ("last", F.col("_mark"))}, inclusive=True).where("_kind = 1")
    return found.select("_probe.*", F.col("_found")[value].alias(value), F.col("_found")[mark].alias(mark))


def sector_to_frame(probes: DataFrame, sector: str, frames: DataFrame) -> DataFrame:
    """The first frame whose start is at or behind the sector or whose extent holds it; past the end the last.

    ``frames`` (frame, start_sector, end_sector) in timeline order.  A frame answers for all sectors
    from the previous frame's end to its own: it is the first whose end lies behind the sector, which
    is a search for the last mark at or before in reverse.
    """
    ends = frames.select((-F.col("end_sector").cast("long")).alias("_end"), (-F.col("frame")).alias("_frame"))
    back = probes.withColumn("_back", -F.col(sector).cast("long") - 1)
    last = frames.agg(F.max("frame").alias("_last"))
    met = last_at_or_before(back, "_back", ends, "_end", "_frame").drop("_back", "_end")
    return met.join(F.broadcast(last)).withColumn("frame", F.coalesce(-F.col("_frame"), "_last")).drop("_frame", "_last")  # one row


def nearest_ahead(slots: DataFrame, by: list[str], frame: Column, target: Column, n: int, max_skip: int, slot: str) -> DataFrame:
    """Of the ready slots at most ``max_skip`` frames ahead of the target the nearest; ties: lowest slot."""
    ahead = slots.withColumn("distance", circular_distance(target, frame, n)).where(F.col("distance") <= max_skip)
    return ahead.groupBy(*by).agg(F.min(F.struct("distance", slot)).alias("best")).select(*by, F.col("best")[slot].alias(slot), F.col("best.distance").alias("distance"))


def resolve_seek(requests: DataFrame, base_lba: int, data_start: int) -> DataFrame:
    """A request (mode, value) as a stream sector; mode ``frame`` and ``none`` keep their frame."""
    v = F.col("value").cast("long")
    sector = F.when(F.col("mode") == "stream", v).when(F.col("mode") == "lba", v - base_lba).when(F.col("mode") == "data", v + data_start)
    return requests.withColumn("sector", F.greatest(sector, F.lit(0).cast("long"))).withColumn(
        "frame_direct", F.when(F.col("mode") == "frame", v).when(F.col("mode") == "none", F.lit(0).cast("long"))
    )
