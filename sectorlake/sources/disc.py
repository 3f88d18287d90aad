"""Disc images of files, with their address header and cue sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions.prefix import running
from sectorlake.functions.units import SECTOR_BYTES, macro_name, sectors
from sectorlake.sources.shared import written

# Sectors of the boot record, and of the smallest disc.
BOOT_SECTORS, LEAST_SECTORS = 2, 300


def addresses(files: DataFrame, order: str, boot_blocks: int = 0) -> DataFrame:
    """Add ``bytes``, ``sectors`` and ``lba`` to files (order, content), one behind the other behind the boot record.

    The first file is the boot program; ``boot_blocks`` gives it that many sectors, which must hold it.  Files
    must be distinct in ``order``, which isn't null.  Only their sizes are put in order, not what they hold.
    """
    sized = files.select(order, F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"))
    first = files.agg(F.min(order).alias("_first"))
    own = sectors(F.col("bytes"))
    wide = F.when((F.col(order) == F.col("_first")) & (F.lit(boot_blocks) > 0), F.when(own > boot_blocks, F.raise_error(F.lit("the boot program needs more blocks"))).otherwise(F.lit(boot_blocks))).otherwise(own)
    held = sized.join(F.broadcast(first)).withColumn("sectors", wide.cast("long")).drop("_first")  # one row
    placed = running(held, [order], {"_before": ("sum", F.col("sectors"))}).withColumn("lba", F.col("_before") + BOOT_SECTORS).drop("_before")
    return files.join(written(placed, "addresses"), order)


def write_image(spark: SparkSession, placed: DataFrame, path: str) -> None:
    """K8: the image of files with addresses; tasks write their files at their places, and it appears when all are done."""
    from sectorlake.sources.files import register

    register(spark)
    rows = placed.select((F.col("lba") * SECTOR_BYTES).alias("at"), F.coalesce("content", F.lit(b"")).alias("content"))
    end = placed.agg(F.max(F.col("lba") + F.col("sectors"))).first()[0] or BOOT_SECTORS
    rows.write.format("disc_image").option("sectors", max(end, LEAST_SECTORS)).mode("append").save(path)


def header_lines(placed: DataFrame, order: str, name: str) -> DataFrame:
    """(part, n, line) of a C header that names each file's address, as an enumeration and as macros; n is the address."""
    macro = F.concat(F.lit("BINARY_LBA_"), macro_name(F.col(name)))
    number = F.col("lba").cast("string")
    both = F.explode(F.array(
        F.struct(F.lit("enum").alias("part"), F.concat(F.lit("\t"), macro, F.lit(" = "), number, F.lit(",")).alias("line")),
        F.struct(F.lit("macro").alias("part"), F.concat(F.lit("#define "), macro, F.lit(" "), number).alias("line")),
    )).alias("l")
    return placed.select(F.col(order).alias("n"), both).select("l.part", "n", "l.line")


def cue_sheet(image: str) -> str:
    """K8: one data track over an image."""
    return f'FILE "{image}" BINARY\n  TRACK 01 MODE1/2048\n    INDEX 01 00:00:00\n'
