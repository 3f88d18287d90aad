"""8x8 block coding as joins and folds over 64-element arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectorlake.functions.units import category, round_half_away

# The base quantizers of the public JPEG standard (annex K), in natural order.
BASE_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
BASE_CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
# Bits of the luma codes of direct-current categories 0 to 9.
DC_LUMA_BITS = [3, 4, 3, 3, 3, 3, 3, 3, 6, 7]
LIMIT = 511


def zigzag() -> list[int]:
    """Natural positions along the diagonals, without the first: up on even diagonals, down on odd ones."""
    out = []
    for s in range(1, 15):
        rows = range(max(0, s - 7), min(s, 7) + 1)
        out += [8 * r + s - r for r in (rows if s % 2 else reversed(rows))]
    return out


def quant_tables(spark: SparkSession, qualities: range) -> DataFrame:
    """(quality, plane, pos, entry): base entries scaled by quality, 1 to 255."""
    base = spark.createDataFrame([(p, i, v) for p, t in (("y", BASE_LUMA), ("uv", BASE_CHROMA)) for i, v in enumerate(t)], "plane string, pos int, base int")
    levels = spark.range(qualities.start, qualities.stop).select(F.col("id").cast("int").alias("quality"))
    scale = F.expr("case when quality = 100 then 1 when quality < 50 then int(5000 div quality) else 200 - 2 * quality end")
    scaled = levels.withColumn("scale", scale).crossJoin(F.broadcast(base))  # 128 fixed rows
    entry = F.greatest(F.lit(1), F.least(F.lit(255), F.expr("int((base * scale + 50) div 100)")))
    return scaled.select("quality", "plane", "pos", entry.alias("entry"))


def _basis() -> np.ndarray:
    """Weights of 64 pixels (lines) in 64 coefficients: products of two cosines, halved for frequency 0."""
    one = np.array([[(math.sqrt(0.5) if u == 0 else 1.0) * math.cos((2 * x + 1) * u * math.pi / 16) / 4 for x in range(8)] for u in range(8)])
    return np.einsum("vy,ux->yxvu", one, one).reshape(64, 64)


def forward_dct(blocks: DataFrame, pixels: str, out: str = "coefficients") -> DataFrame:
    """64 coefficients of 64 pixels, centred on 128: one matrix product for each Arrow batch, no shuffle."""
    basis = _basis()

    @F.pandas_udf("array<double>")
    def transform(p: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(p.to_list()) - 128.0) @ basis)) if len(p) else pd.Series([], dtype=object)

    return blocks.withColumn(out, transform(F.col(pixels)))


def quantize(coefficients: Column, table: list[int], digits: int = 9) -> Column:
    """Rounded half away from zero after division, and clamped.

    Quotients are first rounded to ``digits`` places, so that sums in another order give the same.
    """
    steps = F.array(*[F.lit(q) for q in table])
    return F.zip_with(coefficients, steps, lambda c, q: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), round_half_away(F.round(c / q, digits)))))


def runs(blocks: DataFrame, key: str, quantized: str) -> DataFrame:
    """(key, seq, run, level) of the non-zero coefficients behind the first, in zigzag order.

    A run over 15 is written as symbols of 15 zeros each; ``escapes`` counts them and ``run`` is the rest.
    """
    order = F.array(*[F.lit(i + 1) for i in zigzag()])
    scanned = blocks.select(key, F.posexplode(F.transform(order, lambda i: F.element_at(F.col(quantized), i))).alias("seq", "level")).where("level <> 0")
    w = Window.partitionBy(key).orderBy("seq")
    gap = (F.col("seq") - F.coalesce(F.lag("seq").over(w), F.lit(-1)) - 1).cast("int")
    escapes = F.when(F.col("gap") > 15, F.expr("int((gap - 1) div 15)")).otherwise(0)
    return scanned.withColumn("gap", gap).select(key, "seq", escapes.alias("escapes"), (F.col("gap") - 15 * escapes).alias("run"), "level")


def bit_cost(found: DataFrame, key: str, blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """A13 + J6: bits of each block's alternating part: codes of (run, category), payloads, escapes, end mark.

    ``codes`` has (symbol, bits) with symbol 16 * run + category.  A symbol without a code leaves null.
    """
    symbols = found.withColumn("category", category(F.col("level"))).withColumn("symbol", 16 * F.col("run") + F.col("category"))
    coded = symbols.join(F.broadcast(codes), "symbol", "left")  # at most 256 symbols
    escape = codes.where("symbol = 16").select(F.col("bits").alias("escape_bits"))
    end = codes.where("symbol = 0").select(F.col("bits").alias("end_bits"))
    spent = coded.join(F.broadcast(escape)).groupBy(key).agg(  # one row
        F.sum(F.col("bits") + F.col("category") + F.col("escapes") * F.col("escape_bits")).alias("spent"), F.max("seq").alias("last"),
        F.count_if(F.col("bits").isNull()).alias("uncoded"),
    )
    closed = F.when(F.col("last") == 62, 0).otherwise(F.col("end_bits"))
    return blocks.select(key).join(spent, key, "left").join(F.broadcast(end)).select(  # one row
        key, (F.coalesce("spent", F.lit(0)) + closed).cast("long").alias("bits"), F.coalesce("uncoded", F.lit(0)).cast("long").alias("uncoded")
    )


def uncoded_symbols(found: DataFrame, codes: DataFrame) -> DataFrame:
    """Symbols for which no code exists; a writer must refuse them."""
    symbols = found.select((16 * F.col("run") + category(F.col("level"))).alias("symbol")).distinct()
    return symbols.join(codes, "symbol", "left_anti")


def dc_differences(blocks: DataFrame, strip: list[str], order: str, dc: Column) -> DataFrame:
    """Each block's first coefficient less that of the block before it in its strip."""
    w = Window.partitionBy(*strip).orderBy(order)
    return blocks.withColumn("dc_diff", dc - F.coalesce(F.lag(dc).over(w), F.lit(0)))


def weighted_error(original: Column, decoded: Column) -> Column:
    """Squared error, the first coefficient weighing 1.6 and the next 15 in natural order 1.15."""
    weights = F.array(*[F.lit(1.60 if i == 0 else 1.15 if i < 16 else 1.0) for i in range(64)])
    return F.aggregate(F.zip_with(weights, F.zip_with(original, decoded, lambda a, b: (a - b) * (a - b)), lambda w, e: w * e), F.lit(0.0), lambda a, b: a + b)


def halve(plane: Column, width: int = 8) -> Column:
    """Means of 2x2 cells of a plane in row order."""
    at = lambda x, y: F.element_at(plane, y * width + x + 1)
    return F.array(*[(at(x, y) + at(x + 1, y) + at(x, y + 1) + at(x + 1, y + 1)) / 4 for y in range(0, width, 2) for x in range(0, width, 2)])
