"""Sampled signals as rows: envelopes, segments, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.functions.prefix import running
from sectorlake.functions.units import div


def number_samples(rows: DataFrame, signal: str, order: list[str]) -> DataFrame:
    """Add ``pos``: 0, 1, ... within each signal, whose rows are distinct in ``order``."""
    return running(rows, order, {"pos": ("sum", F.lit(1))}, (signal,))


def rms_envelope(samples: DataFrame, signal: str, value: str, win: int, floor: float = 1e-12) -> DataFrame:
    """A1/A2: root mean square of whole windows of ``win`` samples; a short tail is dropped."""
    windows = samples.groupBy(signal, div(F.col("pos"), win).alias("hop")).agg(F.count("*").alias("_n"), F.avg(F.col(value) * F.col(value)).alias("_ms"))
    return windows.where(F.col("_n") == win).select(signal, "hop", F.sqrt(F.col("_ms") + floor).alias("rms"))


def zscores(rows: DataFrame, signal: str, value, name: str) -> DataFrame:
    """A3: standard scores by the population deviation; each signal's mean and deviation join back."""
    made = rows.withColumn(name, value)
    stats = made.groupBy(signal).agg(F.avg(name).alias("_avg"), F.stddev_pop(name).alias("_std"))
    return made.join(stats, signal).withColumn(name, (F.col(name) - F.col("_avg")) / F.col("_std")).drop("_avg", "_std")


def active_segments(envelope: DataFrame, signal: str, level_db: float = -34.0, least: float = 0.0015, gap: int = 2, min_len: int = 2, min_start: int = 0) -> DataFrame:
    """(signal, start, end) of hops over the threshold, gaps of at most ``gap`` hops closed."""
    peak = F.max("rms").over(Window.partitionBy(signal))
    loud = envelope.withColumn("_peak", peak).where((F.col("_peak") > 1e-7) & (F.col("rms") > F.greatest(F.col("_peak") * 10 ** (level_db / 20), F.lit(least))))
    order = Window.partitionBy(signal).orderBy("hop")
    new = F.when(F.col("hop") - F.lag("hop").over(order) - 1 <= gap, 0).otherwise(1)
    islands = loud.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    found = islands.groupBy(signal, "_island").agg(F.min("hop").alias("start"), (F.max("hop") + 1).alias("end"))
    return found.where((F.col("end") - F.col("start") >= min_len) & (F.col("start") >= min_start)).select(signal, "start", "end")


def dynamic_anchor(envelope: DataFrame, signal: str, hops: int = 8, stride: int = 2) -> DataFrame:
    """The window of ``hops`` hops, at every ``stride``, of the largest deviation over mean; ties: the first."""
    order = Window.partitionBy(signal).orderBy("hop")
    ahead = order.rowsBetween(0, hops - 1)
    moved = envelope.select(signal, "hop", F.count("*").over(ahead).alias("_n"), F.round(F.stddev_pop("rms").over(ahead) / (F.avg("rms").over(ahead) + 1e-9), 9).alias("dynamics"))
    whole = moved.where((F.col("_n") == hops) & (F.col("hop") % stride == 0))
    best = F.max_by(F.struct("hop", "dynamics"), F.struct("dynamics", -F.col("hop")))
    return whole.groupBy(signal).agg(best.alias("_best")).select(signal, "_best.hop", "_best.dynamics")


def snr_db(rows: DataFrame, by: list[str], value: str, decoded: str) -> DataFrame:
    """10 log10 of signal over error power; a zero sum counts as 1."""
    guard = lambda x: F.when(x == 0, 1.0).otherwise(x)
    e = F.col(value) - F.col(decoded)
    return rows.groupBy(*by).agg((10 * F.log10(guard(F.sum(F.col(value) * F.col(value))) / guard(F.sum(e * e)))).alias("snr_db"))


def clock_drift(rows: DataFrame, by: list[str], samples, rate: int, frames, num: int, den: int) -> DataFrame:
    """A10: the largest distance between the audio and the video clock, in seconds."""
    return rows.groupBy(*by).agg(F.max(F.abs(samples / rate - frames * den / num)).alias("max_drift"))


def start_checkpoint(checkpoints: DataFrame, by: list[str], order: str, latched) -> DataFrame:
    """The first checkpoint that has latched, else the last one."""
    first = F.min(F.when(latched, F.col(order)))
    return checkpoints.groupBy(*by).agg(F.coalesce(first, F.max(order)).alias(order))
