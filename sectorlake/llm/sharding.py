"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots per shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.llm.tables import materialize

#: Hexadecimal digits of a row's sub-bucket: slots are numbered in (shard, sub-bucket) groups, so
#: that no task sorts a whole shard.
SUB_HEX = 3
#: Slots of one group of identical rows are written out in runs of this many.
RUN = 65536
#: Hexadecimal digits of an MD5 digest that one shard takes: a digest serves four shards.
HEX_PER_SHARD = 8


def shard_scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """One score per shard from key and shard number alone; the largest wins the record.

    The uniform draw u of (key, shard) is 32 bits of ``md5(key:block)``.  ``weight / -ln(u)`` makes
    shard i the winner with probability weight_i / sum(weights), whatever other shards exist.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive numbers")
    per_digest = 32 // HEX_PER_SHARD
    scores = []
    for shard, weight in enumerate(weights):
        digest = F.md5(F.concat(key, F.lit(f":{shard // per_digest}")))
        word = F.substring(digest, 1 + HEX_PER_SHARD * (shard % per_digest), HEX_PER_SHARD)
        u = (F.conv(word, 16, 10).cast("double") + 0.5) / float(16**HEX_PER_SHARD)
        scores.append(F.lit(float(weight)) / -F.ln(u))
    return scores


def _best(scores: list[Column]) -> Column:
    """Struct (score, negated shard): ties go to the lower shard."""
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("neg")) for i, s in enumerate(scores)]))


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard) for every row of ``docs``.

    Only doc_id and the weights decide ``shard``.  ``grown_shard`` is the shard after one more of
    ``grown_weight`` joins: a record either stays or moves to the new shard.  A null doc_id hashes
    as the empty string; rows that share a doc_id share a shard; a null text has no bytes.  Other
    columns of the input are ignored.  No shuffle.
    """
    n = len(weights)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    scores = shard_scores(key, [*weights, grown_weight])
    text = F.coalesce(F.col("text"), F.lit(""))
    scored = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _best(scores[:n]).alias("best"),
        scores[n].alias("more"),
    )
    shard = (-F.col("best.neg")).cast("int")
    return scored.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"),
        F.when(F.col("more") > F.col("best.score"), F.lit(n)).otherwise(shard).cast("int").alias("grown_shard"),
    )


def number_slots(assigned: DataFrame, sub_hex: int = SUB_HEX) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard without a gap.

    Slots follow (sub-bucket, doc_id, text_crc32, size).  Identical rows are counted first, and a
    key's different texts fall into different sub-buckets, so a hot key is spread.  Counts of the
    sub-buckets are summed up to offsets, and only a sub-bucket is numbered in one task.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.col("text_crc32").cast("string"))
    sub = F.conv(F.substring(F.md5(key), 1, sub_hex), 16, 10).cast("int")
    names = assigned.columns
    counted = materialize(assigned.withColumn("sub", sub).groupBy(*names, "sub").agg(F.count("*").alias("copies")), "shard-rows")
    earlier_sum = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    offsets = (
        counted.groupBy("shard", "sub").agg(F.sum("copies").alias("n"))
        .select("shard", "sub", earlier_sum("n", Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)).alias("offset"))
    )
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.join(offsets, ["shard", "sub"]).withColumn("first", F.col("offset") + earlier_sum("copies", within))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("long"), F.lit(RUN))))
    upto = F.least(F.col("run") + RUN, F.col("copies")) - 1
    return runs.select(*names, F.explode(F.sequence(F.col("first") + F.col("run"), F.col("first") + upto)).alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Shard every row of ``docs`` and number its slots; an empty input gives an empty result."""
    return number_slots(assign_shards(docs, weights)).withColumn("law", F.lit("key"))
