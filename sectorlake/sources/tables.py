"""Small binary formats with big-endian tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.functions.units import big_endian

# A library's header and member sizes, a member's name length and where its offset and size lie.
LIBRARY_HEADER, MEMBER_BYTES, NAME_BYTES, OFFSET_AT, SIZE_AT = 0x20, 0x40, 0x20, 0x28, 0x2C
#: Where the number of members is kept.
COUNT_AT = 0x1C


def image_kind(content: Column) -> Column:
    """The reader for an image file by its first bytes; null if there is none."""
    start = F.hex(F.substring(content, 1, 8))
    return F.when(F.startswith(start, F.lit("89504E47")) & (F.octet_length(content) >= 8), "png").when(F.startswith(start, F.lit("5036")), "ppm")


def _big(value: Column, size: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def libraries(members: DataFrame) -> DataFrame:
    """(library, content) of members (library, n, name, data), in the order of ``n``; one library is one row."""
    w = Window.partitionBy("library")
    sized = members.withColumn("size", F.octet_length("data").cast("long")).withColumn("count", F.count("*").over(w))
    before = F.coalesce(F.sum("size").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("count") * MEMBER_BYTES + LIBRARY_HEADER + before
    name = F.concat(F.col("name").cast("binary"), _zeros(NAME_BYTES - F.octet_length("name")))
    entry = F.concat(name, _zeros(F.lit(OFFSET_AT - NAME_BYTES)), _big(at), _big(F.col("size")), _zeros(F.lit(MEMBER_BYTES - SIZE_AT - 4)))
    parts = sized.select("library", "n", "count", "data", entry.alias("entry"))
    made = parts.groupBy("library").agg(F.max("count").alias("count"), F.expr("listagg(entry) within group (order by n)").alias("index"), F.expr("listagg(data) within group (order by n)").alias("body"))
    return made.select("library", F.concat(_zeros(F.lit(COUNT_AT)), _big(F.col("count")), "index", "body").alias("content"))


def library_members(files: DataFrame) -> DataFrame:
    """(library, n, name, offset, size, content) of every member, by the big-endian table behind the header."""
    count = big_endian(F.col("content"), COUNT_AT, 4)
    entries = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.substring(F.col("content"), (i * MEMBER_BYTES + LIBRARY_HEADER + 1).cast("int"), F.lit(MEMBER_BYTES)))
    listed = files.where(count > 0).select("library", "content", F.posexplode(entries).alias("n", "entry"))
    found = listed.withColumns({"offset": big_endian(F.col("entry"), OFFSET_AT, 4), "size": big_endian(F.col("entry"), SIZE_AT, 4)})
    name = F.regexp_replace(F.decode(F.substring("entry", 1, NAME_BYTES), "ISO-8859-1"), "\u0000+$", "")
    return found.select("library", "n", name.alias("name"), "offset", "size", F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("content"))


# An object's header size and where it counts its sections; a section's size, name length and fields.
OBJECT_HEADER, SECTIONS_AT, SECTION_BYTES, SECTION_NAME = 0x40, 0x0C, 0x30, 0x10
SECTION_FIELDS = {"offset": 0x10, "size": 0x14, "relocations_at": 0x18, "relocations": 0x1C}


def objects(sections: DataFrame) -> DataFrame:
    """(object, content) of sections (object, n, name, data), in the order of ``n``, none with relocations; one object is one row."""
    w = Window.partitionBy("object")
    sized = sections.withColumn("size", F.octet_length("data").cast("long")).withColumn("count", F.count("*").over(w))
    before = F.coalesce(F.sum("size").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("count") * SECTION_BYTES + OBJECT_HEADER + before
    name = F.concat(F.col("name").cast("binary"), _zeros(SECTION_NAME - F.octet_length("name")))
    entry = F.concat(name, _big(at), _big(F.col("size")), _zeros(F.lit(SECTION_BYTES - SECTION_NAME - 8)))
    parts = sized.select("object", "n", "count", "data", entry.alias("entry"))
    made = parts.groupBy("object").agg(F.max("count").alias("count"), F.expr("listagg(entry) within group (order by n)").alias("index"), F.expr("listagg(data) within group (order by n)").alias("body"))
    return made.select("object", F.concat(_zeros(F.lit(SECTIONS_AT)), _big(F.col("count")), _zeros(F.lit(OBJECT_HEADER - SECTIONS_AT - 4)), "index", "body").alias("content"))


def object_sections(files: DataFrame) -> DataFrame:
    """(object, n, name, offset, size, relocations_at, relocations, content) of every section of objects (object, content)."""
    count = big_endian(F.col("content"), SECTIONS_AT, 4)
    entries = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.substring(F.col("content"), (i * SECTION_BYTES + OBJECT_HEADER + 1).cast("int"), F.lit(SECTION_BYTES)))
    listed = files.where(count > 0).select("object", "content", F.posexplode(entries).alias("n", "entry"))
    name = F.regexp_replace(F.decode(F.substring("entry", 1, SECTION_NAME), "ISO-8859-1"), "\u0000+$", "")
    found = listed.select("object", "n", name.alias("name"), *[big_endian(F.col("entry"), k, 4).alias(c) for c, k in SECTION_FIELDS.items()], "content")
    return found.withColumn("content", F.substring("content", (F.col("offset") + 1).cast("int"), F.col("size").cast("int")))
