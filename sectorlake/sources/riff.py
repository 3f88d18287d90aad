"""RIFF/WAVE files as chunk rows and sample rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlake.functions.units import little_endian

CONTAINERS = (b"RIFF", b"LIST")


def _walk(content: bytes, begin: int, end: int, level: int, out: list[list]) -> None:
    """Append [level, id, type, size, offset of the data, last] of the chunks of an area, a container's own behind it.

    A chunk's number is its place in the list; ``last`` is that of the last chunk inside it.
    """
    while begin + 8 <= end:
        name, size = content[begin : begin + 4], int.from_bytes(content[begin + 4 : begin + 8], "little")
        inner = name in CONTAINERS
        own = [level, name.decode("latin-1"), content[begin + 8 : begin + 12].decode("latin-1") if inner else None, size, begin + 8, 0]
        out.append(own)
        if inner:
            _walk(content, begin + 12, min(end, begin + 8 + size), level + 1, out)
        own[5] = len(out) - 1
        begin += 8 + size + size % 2


def chunks(files: DataFrame) -> DataFrame:
    """(stream_id, level, chunk_id, chunk_type, size, offset, last, number) of every chunk of each file, a tree as nested intervals.

    Chunks are numbered as they begin; those inside one have the numbers behind its own up to ``last``.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for stream, content in zip(p["stream_id"], p["content"], strict=True):
                found: list[list] = []
                _walk(content or b"", 0, len(content or b""), 0, found)
                rows += [(stream, *c, k) for k, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=["stream_id", "level", "chunk_id", "chunk_type", "size", "offset", "last", "number"])

    return files.select("stream_id", "content").mapInPandas(scan, "stream_id string, level int, chunk_id string, chunk_type string, size bigint, offset bigint, last bigint, number bigint")


def descend(tree: DataFrame, parents: DataFrame, chunk_id: str, chunk_type: str | None = None) -> DataFrame:
    """The first chunk of an id (and, of a container, of a type) directly inside each of ``parents``, rows of ``tree``."""
    inside = parents.select("stream_id", F.col("number").alias("_from"), F.col("last").alias("_to"), (F.col("level") + 1).alias("level"))
    found = tree.where(F.col("chunk_id") == chunk_id)
    found = found.where(F.col("chunk_type") == chunk_type) if chunk_type else found
    met = found.join(inside, ["stream_id", "level"]).where((F.col("number") > F.col("_from")) & (F.col("number") <= F.col("_to")))
    first = F.min_by(F.struct(*[c for c in tree.columns if c != "stream_id"]), "number").alias("_c")
    return met.groupBy("stream_id", "_from").agg(first).select("stream_id", "_c.*").select(*tree.columns)


def _integer(text: Column) -> Column:
    """A number as C's ``strtol`` of base 0 takes it: hexadecimal behind 0x, octal behind 0, else decimal."""
    digits = F.regexp_replace(text, "^[+-]", "")
    value = (
        F.when(digits.rlike("^0[xX]"), F.conv(F.substring(digits, F.lit(3), F.length(digits)), 16, 10))
        .when(digits.rlike("^0[0-7]+$"), F.conv(digits, 8, 10))
        .when(digits.rlike("^([1-9][0-9]*|0)$"), digits)
    ).cast("long")
    return F.when(F.startswith(text, F.lit("-")), -value).otherwise(value)


def comment_loop(comment: Column) -> Column:
    """Struct (start, end), end behind the last sample, of a comment that begins with two numbers; else null."""
    words = F.split(F.regexp_replace(comment, "^[ \t\r\n]+", ""), "[ \t\r\n]+")
    first, last = (_integer(F.try_element_at(words, F.lit(k))) for k in (1, 2))
    return F.when((F.length(comment) <= 255) & first.isNotNull() & last.isNotNull(), F.struct(first.alias("start"), (last + 1).alias("end")))


def details(files: DataFrame, loop_in_comment: bool = False) -> DataFrame:
    """(stream_id, total_samples, loop_start, loop_end, comment, info) of wave files.

    ``total_samples`` is the fact chunk's, or for plain PCM what the data holds.  The loop (its end behind
    its last sample) is the first of smpl, or with ``loop_in_comment`` the two numbers of INFO's ICMT where it
    has them.  ``info`` maps INFO's ids to their texts.  Files without RIFF, fmt and data have no row.
    """
    tree = chunks(files)
    root = descend_root(tree)
    part = {name: descend(tree, root, name).select("stream_id", F.struct("offset", "size").alias(f"_{name.strip()}")) for name in ("fmt ", "fact", "data", "smpl")}
    listed = descend(tree, root, "LIST", "INFO")
    items = tree.join(listed.select("stream_id", F.col("number").alias("_from"), F.col("last").alias("_to")), "stream_id").where("number > _from and number <= _to")
    met = files.select("stream_id", "content").join(part["fmt "], "stream_id").join(part["data"], "stream_id")
    for name in ("fact", "smpl"):
        met = met.join(part[name], "stream_id", "left")
    at = lambda name, k, n: little_endian(F.col("content"), F.col(f"_{name}.offset") + k, n)
    plain = F.call_function("div", F.col("_data.size") * 8, F.nullif(at("fmt", 14, 2), F.lit(0)))
    total = F.when(F.col("_fact").isNotNull(), at("fact", 0, 4)).when(at("fmt", 0, 2) == 1, plain)
    looped = F.when(F.col("_smpl").isNotNull() & (at("smpl", 28, 4) > 0), F.struct(at("smpl", 44, 4).alias("start"), (at("smpl", 48, 4) + 1).alias("end")))
    text = F.substring("content", (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    texts = items.join(files.select("stream_id", "content"), "stream_id").select("stream_id", "number", "chunk_id", F.regexp_replace(F.decode(text, "ISO-8859-1"), "(?s)\u0000.*$", "").alias("text"))
    first = texts.groupBy("stream_id", "chunk_id").agg(F.min_by("text", "number").alias("text"))  # of one id the first counts
    info = first.groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "text"))).alias("info")).withColumn("comment", F.try_element_at("info", F.lit("ICMT")))
    whole = met.select("stream_id", total.alias("total_samples"), looped.alias("_loop")).join(info, "stream_id", "left")
    loop = F.coalesce(comment_loop(F.col("comment")), F.col("_loop")) if loop_in_comment else F.col("_loop")
    return whole.withColumn("_loop", loop).select("stream_id", "total_samples", F.col("_loop.start").alias("loop_start"), F.col("_loop.end").alias("loop_end"), "comment", "info")


def descend_root(tree: DataFrame) -> DataFrame:
    """The outermost RIFF chunk of each file that is of type WAVE and comes first."""
    return tree.where("number = 0 and chunk_id = 'RIFF' and chunk_type = 'WAVE'")


def formats(files: DataFrame) -> DataFrame:
    """The fields of each file's fmt chunk and the extent of its data."""
    listed = chunks(files).where("level = 1")
    found = listed.groupBy("stream_id").agg(
        F.min(F.when(F.col("chunk_id") == "fmt ", F.col("offset"))).alias("fmt"), F.min(F.when(F.col("chunk_id") == "data", F.struct("offset", "size"))).alias("data"),
        F.min(F.when(F.col("chunk_id") == "smpl", F.col("offset"))).alias("smpl"),
    )
    joined = found.join(files, "stream_id")
    at = lambda base, k, size: little_endian(F.col("content"), F.col(base) + k, size)
    loops = F.when(F.col("smpl").isNotNull() & (at("smpl", 28, 4) > 0), F.struct(at("smpl", 44, 4).alias("start"), at("smpl", 48, 4).alias("end")))
    return joined.where("fmt is not null").select(
        "stream_id", at("fmt", 0, 2).alias("format_tag"), at("fmt", 2, 2).alias("channels"), at("fmt", 4, 4).alias("rate"), at("fmt", 8, 4).alias("byte_rate"),
        at("fmt", 12, 2).alias("block_align"), at("fmt", 14, 2).alias("bits"), F.col("data.offset").alias("data_offset"), F.col("data.size").alias("data_bytes"), loops.alias("loop"),
    )


#: Frames of a coarse and of a fine piece: a decoded sample then copies a fine piece, not the file.
COARSE, FINE = 16_384, 128


def _pieces(rows: DataFrame, data: str, frames: int) -> DataFrame:
    """Rows whose binary data is cut into pieces of ``frames`` frames, with the first frame of each."""
    size = F.col("block_align") * frames
    begins = F.sequence(F.lit(0).cast("long"), F.octet_length(data) - 1, size.cast("long"))
    cut = F.transform(begins, lambda b: F.struct(F.call_function("div", b, F.col("block_align")).alias("at"), F.substring(F.col(data), (b + 1).cast("int"), size.cast("int")).alias("data")))
    return rows.select("stream_id", "channels", "block_align", "base", F.explode(cut).alias("p")).select(
        "stream_id", "channels", "block_align", (F.col("base") + F.col("p.at")).alias("base"), F.col("p.data").alias("data")
    )


def mono_samples(files: DataFrame) -> DataFrame:
    """(stream_id, pos, sample): 16-bit PCM with channels averaged, from data cut into ever smaller pieces."""
    known = formats(files).where("format_tag = 1 and bits = 16 and data_bytes > 0").join(files.select("stream_id", "content"), "stream_id")
    whole = known.select(
        "stream_id", "channels", "block_align", F.lit(0).cast("long").alias("base"),
        F.substring("content", (F.col("data_offset") + 1).cast("int"), (F.col("data_bytes") - F.col("data_bytes") % F.col("block_align")).cast("int")).alias("data"),
    ).where(F.octet_length("data") > 0)
    fine = _pieces(_pieces(whole, "data", COARSE), "data", FINE)
    count = F.call_function("div", F.octet_length("data").cast("long"), F.col("block_align"))

    def value(frame, channel):
        raw = little_endian(F.col("data"), frame * F.col("block_align") + channel * 2, 2)
        return F.when(raw >= 32768, raw - 65536).otherwise(raw)

    def sample(frame):
        total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("channels") - 1), F.lit(0).cast("long"), lambda a, c: a + value(frame, c))
        return F.struct((F.col("base") + frame).alias("pos"), (total / F.col("channels")).alias("sample"))

    return fine.select("stream_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), sample)).alias("s")).select("stream_id", "s.pos", "s.sample")


def _number(value: Column | int, size: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def sample_bytes(value: Column) -> Column:
    """A 16-bit sample, clipped, in two bytes."""
    held = F.greatest(F.lit(-32768).cast("long"), F.least(F.lit(32767).cast("long"), value.cast("long")))
    return _number(F.pmod(held, F.lit(65536)), 2)


def wave_file(
    data: Column, channels: int, rate: int, loop_start: Column | None = None, loop_end: Column | None = None, tag: int = 1, bits: int = 16, fact: Column | None = None,
    info: list[tuple[str, Column]] | None = None,
) -> Column:
    """K4/K5: a file of fmt, fact, data, smpl and INFO, in this order, those that are given; odd chunks are padded.

    ``fact`` is a number of samples, ``info`` has ids and texts, which end in a zero byte; null texts are left out.
    """
    name = lambda n: F.lit(n.encode())
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  a value used more than once
    padded = lambda b: F.concat(_number(F.octet_length(b), 4), b, F.when(F.octet_length(b) % 2 == 1, F.lit(bytes(1))).otherwise(F.lit(b"")))
    chunk = lambda n, body: F.concat(name(n), let(body, padded))
    block = max(channels * bits // 8, 1)
    parts = [name("WAVE"), chunk("fmt ", F.concat(_number(tag, 2), _number(channels, 2), _number(rate, 4), _number(rate * channels * bits // 8, 4), _number(block, 2), _number(bits, 2)))]
    if fact is not None:
        parts.append(chunk("fact", _number(fact, 4)))
    parts.append(chunk("data", data))
    if loop_start is not None:
        head = [0, 0, 1_000_000_000 // rate, 60, 0, 0, 0, 1, 0]  # one loop
        looped = F.concat(*[_number(v, 4) for v in head], *[_number(v, 4) for v in (0, 0, loop_start, loop_end, 0, 0)])
        parts.append(F.when(loop_start.isNotNull(), chunk("smpl", looped)).otherwise(F.lit(b"")))
    if info:
        texts = [F.when(text.isNotNull(), chunk(n, F.concat(text.cast("binary"), F.lit(bytes(1))))).otherwise(F.lit(b"")) for n, text in info]
        parts.append(chunk("LIST", F.concat(name("INFO"), *texts)))
    return let(F.concat(*parts), lambda whole: F.concat(name("RIFF"), _number(F.octet_length(whole), 4), whole))


def vox_file(codes: Column, pad: int = 2048) -> Column:
    """K6: 4-bit codes (hexadecimal digits) without a header, padded with zeros to whole sectors."""
    even = F.concat(codes, F.when(F.length(codes) % 2 == 1, "0").otherwise(""))
    missing = F.pmod(-F.length(even), F.lit(2 * pad))
    return F.unhex(F.concat(even, F.repeat(F.lit("0"), missing)))


def vox_codes(files: DataFrame, rate: int) -> DataFrame:
    """(stream_id, rate, codes) of headerless files; the rate is the caller's."""
    return files.select("stream_id", F.lit(rate).alias("rate"), F.hex("content").alias("codes"))
