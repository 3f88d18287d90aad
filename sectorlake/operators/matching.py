"""Extents, free runs, arrival order, levels and resampling as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.functions.prefix import running
from sectorlake.functions.units import HALF_SECTORS, PREROLL_BLOCKS


def block_extents(blocks: DataFrame, placed: DataFrame, data_start: int) -> DataFrame:
    """Add ``sector``, where each ring block begins: in the preroll, or behind the frame that carries it.

    ``blocks`` has (stream_id, block, ...), ``placed`` (stream_id, block, audio_sectors, audio_sector).  A block that no
    frame carries has a null sector.
    """
    carried = placed.where("audio_sectors > 0").select("stream_id", "block", "audio_sector")
    preroll = F.col("block") * HALF_SECTORS + data_start
    met = blocks.join(carried, ["stream_id", "block"], "left")
    return met.withColumn("sector", F.when(F.col("block") < PREROLL_BLOCKS, preroll).otherwise(F.col("audio_sector"))).drop("audio_sector")


def arrival_faults(chunks: DataFrame, by: list[str], order: list[str], at: str, size: str) -> DataFrame:
    """Chunks that do not begin where those before them have ended; ``expected`` is where they should."""
    before = Window.partitionBy(*by).orderBy(*order)
    expected = F.coalesce(F.lag(F.col(at) + F.col(size)).over(before), F.lit(0).cast("long"))
    return chunks.withColumn("expected", expected).where(F.col(at) != F.col("expected"))


def first_free_run(free: DataFrame, by: list[str], position: str, cap: int = 8) -> DataFrame:
    """(by, first_slot, n) of the first run of adjacent free positions, however short, of ``cap`` at most."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    runs = free.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(position).alias("first_slot"), F.count("*").alias("n"))
    best = runs.groupBy(*by).agg(F.min(F.struct("first_slot", "n")).alias("_best"))
    return best.select(*by, "_best.first_slot", F.least(F.lit(cap).cast("long"), F.col("_best.n")).alias("n"))


def high_water(rows: DataFrame, by: list[str], order: list[str], change: Column) -> DataFrame:
    """Add ``ready``, the level after each change, and ``high``, the highest level so far; rows are distinct in ``order``."""
    level = running(rows, order, {"ready": ("sum", change)}, tuple(by), inclusive=True)
    return running(level, order, {"high": ("max", F.col("ready"))}, tuple(by), inclusive=True)


def running_energy(samples: DataFrame, signal: str, value: str, win: int) -> DataFrame:
    """Energy of the last ``win`` samples as a difference of prefix sums; the first ``win`` - 1 have none."""
    order = Window.partitionBy(signal).orderBy("pos")
    summed = samples.withColumn("_sum", F.sum(F.col(value) * F.col(value)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    energy = F.col("_sum") - F.coalesce(F.lag("_sum", win).over(order), F.lit(0.0))
    return summed.withColumn("energy", energy).where(F.col("pos") >= win - 1).drop("_sum")


def resample(envelope: DataFrame, signal: str, value: str, points: int) -> DataFrame:
    """(signal, point, value): each signal's hops at ``points`` even places, linear between neighbours."""
    lasts = envelope.groupBy(signal).agg(F.max("hop").alias("_last"))
    placed = lasts.select(signal, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "_last")
    x = F.col("point") * F.col("_last") / float(points - 1)
    placed = placed.withColumn("_x", x).withColumn("hop", F.floor("_x").cast("long"))
    left = envelope.select(signal, "hop", F.col(value).alias("_a"))
    right = envelope.select(signal, (F.col("hop") - 1).alias("hop"), F.col(value).alias("_b"))
    met = placed.join(left, [signal, "hop"]).join(right, [signal, "hop"], "left")
    between = F.col("_a") + (F.col("_x") - F.col("hop")) * (F.coalesce("_b", "_a") - F.col("_a"))
    return met.select(signal, "point", between.alias(value))


# The picture gate's limits (dark lower halves, their difference, mean error, correlation, edge error).
DARK, REFERENCE_DARK, DARKER, ERROR, CORRELATION, EDGE = 0.70, 0.40, 0.45, 75, 0.45, (2, 12)


def picture_rules() -> Column:
    """The names of the limits that a picture's metrics break, as an array.

    Metrics are dark and ref_dark (dark shares of the lower halves), mae, corr, edge and body (mean absolute errors of
    the right edge and the rest).
    """
    c = F.col
    limits = {
        "bottom_black": (c("dark") > DARK) & (c("ref_dark") < REFERENCE_DARK),
        "black_delta": c("dark") - c("ref_dark") > DARKER,
        "mae": c("mae") > ERROR,
        "corr": c("corr") < CORRELATION,
        "edge": c("edge") > EDGE[0] * c("body") + EDGE[1],
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in limits.items()]))


def picture_faults(metrics: DataFrame, key: str) -> DataFrame:
    """(key, rule) for each limit that a picture's metrics break; see ``picture_rules``."""
    return metrics.select(key, F.explode(picture_rules()).alias("rule"))
