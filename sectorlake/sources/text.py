"""Text and counter sources and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The directives of a disc description.
DIRECTIVES = ("binary", "blocks", "append", "asset", "lbaheader", "name", "makerid", "maker", "date", "country", "version")


def parse_directives(lines: DataFrame, keep: list[str], known: tuple[str, ...] = DIRECTIVES) -> DataFrame:
    """(kept columns, directive, value, known) of lines of a directive, one blank and its value.

    Lines that begin with ``#`` are comments, and empty ones are skipped; a ``#`` further on belongs to
    the value.  Only the line's end is trimmed.  A line without a blank, or whose first word stands
    further right, has no known directive.
    """
    own = lines.select(*keep, F.regexp_replace("value", r"[\r\n]+$", "").alias("line")).where("line <> '' and not startswith(line, '#')")
    word = F.regexp_extract("line", r"^([^ ]*)", 1)
    has = F.contains("line", F.lit(" "))
    value = F.when(has, F.substring("line", F.length(word) + 2, F.length("line")))
    return own.select(*keep, word.alias("directive"), value.alias("value"), (has & word.isin(*known)).alias("known"))


def directives(spark: SparkSession, path: str, known: tuple[str, ...] = DIRECTIVES) -> DataFrame:
    """The directives of text files, with their path."""
    return parse_directives(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"), ["path"], known)


def counter_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per readable JSON report, with its file name; unreadable ones are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)
    return rows.withColumn("report", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


# Counters of four, two and one bytes; all other counters have four.
COUNTER_BYTES = {
    2: ("g_frame_count", "g_start_frame", "g_next_display_frame", "g_next_load_frame", "g_fields_per_frame", "g_field_counter", "g_audio_chunk_count", "g_next_audio_chunk"),
    1: (
        "g_done", "g_abort", "g_header_ready", "g_rainbow_visible", "g_audio_codec", "g_audio_active", "g_mp2_enabled", "g_adpcm_enabled", "g_adpcm_started", "g_adpcm_playing",
        "g_adpcm_finished", "g_paused",
    ),
}
_ADDRESS = r"0x([0-9a-fA-F]+)"
PLAIN = rf"^\s*{_ADDRESS}\s+([A-Za-z_]\w*)\s*$"
SECTION, SECTION_HEAD = rf"^\s*\.bss\.(\w+)\s+{_ADDRESS}\s+{_ADDRESS}", r"^\s*\.bss\.(\w+)\s*$"


def parse_symbols(lines: DataFrame, keep: list[str], order: str = "line_no") -> DataFrame:
    """(kept columns, symbol, address, bytes) of a linker map's lines, one row a symbol.

    A symbol stands behind its address (of four bytes), or names a ``.bss.`` section, whose address and
    size follow on its line or the next one (by ``order``, lines numbered without gaps).  A section's size
    overrides a plain line; of several sections the last counts, of plain lines the first.
    """
    number = lambda c: F.conv(c, 16, 10).cast("long")
    part = lambda pattern, k: F.regexp_extract("value", pattern, k)
    line = lines.select(*keep, F.col(order).cast("long").alias("_no"), "value")
    plain = line.where(F.col("value").rlike(PLAIN)).select(*keep, "_no", part(PLAIN, 2).alias("symbol"), number(part(PLAIN, 1)).alias("address"), F.lit(4).cast("long").alias("bytes"), F.lit(0).alias("_rank"))
    whole = line.where(F.col("value").rlike(SECTION)).select(*keep, "_no", part(SECTION, 1).alias("symbol"), number(part(SECTION, 2)).alias("address"), number(part(SECTION, 3)).alias("bytes"), F.lit(1).alias("_rank"))
    pair = rf"{_ADDRESS}\s+{_ADDRESS}"
    heads = line.where(F.col("value").rlike(SECTION_HEAD)).select(*keep, (F.col("_no") + 1).alias("_no"), part(SECTION_HEAD, 1).alias("symbol"))
    below = line.where(F.col("value").rlike(pair)).select(*keep, "_no", number(part(pair, 1)).alias("address"), number(part(pair, 2)).alias("bytes"))
    split = heads.join(below, [*keep, "_no"]).select(*keep, "_no", "symbol", "address", "bytes", F.lit(1).alias("_rank"))
    found = plain.unionByName(whole).unionByName(split)
    turn = F.struct("_rank", F.when(F.col("_rank") == 1, F.col("_no")).otherwise(-F.col("_no")))
    return found.groupBy(*keep, "symbol").agg(F.max_by(F.struct("address", "bytes"), turn).alias("_s")).select(*keep, "symbol", "_s.address", "_s.bytes")


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """(path, symbol, address, bytes) of linker maps; each file's lines are numbered in its own order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return parse_symbols(whole, ["path"])


def counter_bytes(symbol: Column) -> Column:
    """How many bytes a counter has, by its name."""
    return F.when(symbol.isin(*COUNTER_BYTES[1]), 1).when(symbol.isin(*COUNTER_BYTES[2]), 2).otherwise(4)


def peek(symbols_: DataFrame, dump: DataFrame, base: int) -> DataFrame:
    """(symbol, value) of the counters (``g_`` names) that lie in a memory dump (one row, column ``content``), which starts at ``base``."""
    from sectorlake.functions.units import little_endian

    held = symbols_.where(F.startswith("symbol", F.lit("g_"))).withColumn("_n", counter_bytes(F.col("symbol"))).join(F.broadcast(dump.select("content")))  # one dump
    at = F.col("address") - base
    inside = held.where((at >= 0) & (at + F.col("_n") <= F.octet_length("content")))
    value = F.coalesce(*[F.when(F.col("_n") == n, little_endian(F.col("content"), at, n)) for n in (1, 2, 4)])
    return inside.select("symbol", value.alias("value"))


def parse_reports(lines: DataFrame, schema: str) -> DataFrame:
    """The fields of one report a line; lines that don't parse are skipped."""
    parsed = lines.select(F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r._broken is null").select("r.*").drop("_broken")


def report_line(fields: Column) -> Column:
    """K7: a report as one line of JSON."""
    return F.to_json(fields)


def write_report(rows: DataFrame, path: str) -> None:
    """K7: a report as JSON lines."""
    rows.write.mode("overwrite").json(path)


def c_array(name: Column, content: Column) -> Column:
    """K9: binary data as a C array definition."""
    digits = F.regexp_replace(F.lower(F.hex(content)), "(..)", "0x$1,")
    return F.concat(F.lit("static const unsigned char "), name, F.lit("["), F.octet_length(content).cast("string"), F.lit("] = { "), digits, F.lit(" };"))
