"""Codes of varying length as bytes, in columns: offsets by prefix sums, words by OR, stuffing byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlake.functions.prefix import running
from sectorlake.functions.units import category, div, payload
from sectorlake.operators.blocks8 import LIMIT

#: Bits of a word that tokens are laid into.
WORD = 32


def canonical(bits: dict[int, int], end: int | None = None, last: int | None = None) -> list[tuple[int, int, int]]:
    """(symbol, code, bits): codes that count up by length and symbol; ``last`` comes behind all of its length.

    ``end`` is no part of that order: its code is all ones.
    """
    code, size, out = 0, 0, []
    for symbol, n in sorted(((s, n) for s, n in bits.items() if s != end), key=lambda x: (x[1], x[0] == last, x[0])):
        code <<= n - size
        size = n
        out.append((symbol, code, n))
        code += 1
    return out + ([(end, (1 << bits[end]) - 1, bits[end])] if end is not None else [])


def _clamped(value: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), value)).cast("long")


def _coded(rows: DataFrame, keys: list[str], symbol: Column, value: Column, codes: DataFrame) -> DataFrame:
    """(keys, value, bits): a symbol's code with the payload of ``value`` behind it; null without a code."""
    n = category(value).cast("int")
    asked = rows.select(*keys, symbol.cast("int").alias("symbol"), n.alias("_n"), payload(value).cast("long").alias("_p"))
    met = asked.join(F.broadcast(codes), "symbol", "left")  # at most 256 codes
    return met.select(*keys, F.call_function("shiftleft", F.col("code"), F.col("_n")).bitwiseOR(F.when(F.col("_n") > 0, F.col("_p")).otherwise(0)).alias("value"), (F.col("bits") + F.col("_n")).alias("bits"))


def block_tokens(blocks: DataFrame, runs: DataFrame, strip: str, block: str, dc_codes: DataFrame, ac_codes: DataFrame) -> DataFrame:
    """C11: (strip, block, seq, value, bits): what a block's differences and runs are written as, in order of ``seq``.

    ``blocks`` has (strip, block, dc_diff), ``runs`` (block, seq, escapes, run, level) as ``blocks8.runs`` gives
    them; code tables are (symbol, code, bits) with AC symbols 16 * run + category.  A block whose last
    coefficient is zero ends in symbol 0.  A symbol without a code leaves null bits.
    """
    diff = _clamped(F.col("dc_diff"))
    keys = [strip, block, "seq"]
    dc = _coded(blocks.withColumn("seq", F.lit(-2)), keys, category(diff), diff, dc_codes)
    own = runs.join(blocks.select(strip, block), block)
    level = _clamped(F.col("level"))
    ac = _coded(own.withColumns({"seq": 2 * F.col("seq") + 1, "level": level}), keys, 16 * F.col("run") + category(level), F.col("level"), ac_codes)
    zeros = ac_codes.where("symbol = 16").select(F.col("code").alias("_z"), F.col("bits").alias("_b"))
    again = lambda s, _: F.call_function("shiftleft", s, F.col("_b")).bitwiseOR(F.col("_z"))
    escaped = own.where("escapes > 0").join(F.broadcast(zeros)).select(  # one row
        strip, block, (2 * F.col("seq")).alias("seq"), F.aggregate(F.sequence(F.lit(1), F.col("escapes")), F.lit(0).cast("long"), again).alias("value"), (F.col("escapes") * F.col("_b")).alias("bits")
    )
    lasts = runs.groupBy(block).agg(F.max("seq").alias("_last"))
    end = ac_codes.where("symbol = 0").select(F.col("code").alias("value"), "bits")
    ends = blocks.select(strip, block).join(lasts, block, "left").where("_last is null or _last < 62").join(F.broadcast(end)).select(strip, block, F.lit(1000).alias("seq"), "value", "bits")  # one row
    return dc.unionByName(ac).unionByName(escaped).unionByName(ends)


def block_bits(tokens: DataFrame, block: str) -> DataFrame:
    """(block, bits): all of a block's bits, its first coefficient's included; null where a symbol has no code."""
    return tokens.groupBy(block).agg(F.when(F.count_if(F.col("bits").isNull()) == 0, F.sum("bits")).cast("long").alias("bits"))


def pack(tokens: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """(stream, n_bits, n_bytes, data): tokens (value, bits) of at most 64 bits, one behind the other, as bytes.

    The last byte is filled up with zeros.  Behind each byte of 255 a zero byte is put, which ``n_bytes``
    doesn't count.  A token's place is the sum of the bits before it, so tokens are laid into their words
    wherever they are; a stream's words, a few bytes each, are gathered once.
    """
    some = tokens.where("bits > 0").select(stream, *order, F.col("value").cast("long").alias("value"), F.col("bits").cast("long").alias("bits"))
    placed = running(some, order, {"_at": ("sum", F.col("bits"))}, (stream,))
    end = F.col("_at") + F.col("bits")
    laid = placed.withColumn("_word", F.explode(F.sequence(div(F.col("_at"), WORD), div(end - 1, WORD))))
    over = ((F.col("_word") + 1) * WORD - end).cast("int")
    part = F.when(over >= 0, F.call_function("shiftleft", F.col("value"), over)).otherwise(F.call_function("shiftright", F.col("value"), -over)).bitwiseAND((1 << WORD) - 1)
    words = laid.groupBy(stream, "_word").agg(F.bit_or(part).alias("_v"), F.max(end).alias("_end"))
    digits = F.lpad(F.hex("_v"), WORD // 4, "0")
    held = F.least(F.lit(WORD // 8).cast("long"), div(F.col("_end") - F.col("_word") * WORD + 7, 8)).cast("int")
    byte = lambda k: F.substring(digits, 2 * k + 1, 2)
    stuffed = F.concat(*[F.when(held > k, F.concat(byte(k), F.when(byte(k) == "FF", "00").otherwise(""))).otherwise("") for k in range(WORD // 8)])
    made = words.select(stream, "_word", "_end", held.alias("_held"), F.unhex(stuffed).alias("_b"))
    return made.groupBy(stream).agg(F.max("_end").alias("n_bits"), F.sum("_held").cast("long").alias("n_bytes"), F.expr("listagg(_b) within group (order by _word)").alias("data"))
