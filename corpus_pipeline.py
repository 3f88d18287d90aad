"""The corpus pipeline: filter by quality, drop near copies, cut repeated passages, drop leaks, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.llm import decontamination, near_dedup, packing, quality_rules, substring_dedup
from sectorlake.llm.tables import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the rule ensemble scores 0.3 or more, with all their columns, whatever these are called.

    A null text is scored as an empty one; null, repeated and long ones are judged row by row.  Without
    usable labels all rows have one score.  An empty table stays empty.
    """
    return quality_rules.accepted(docs, _table(spark, sf_dir, "labels"), threshold=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with all its columns, of each group of texts whose sets of 5-word shingles are linked at 0.8.

    The smallest doc_id stays (null ids last; ties: the smaller hash of the text).  Null, empty and
    blank texts are linked with nothing; of rows that repeat an id and a text one stays, and of
    different texts under one id each.
    """
    return near_dedup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows without the words of 20-word windows that start earlier; n_chars, if there is one, follows a cut text.

    A null text becomes an empty one, and texts under 20 words stay.  Windows are first in the smallest
    doc_id (null ids last; ties: the smaller hash of the text), of repeated rows in one.  All other columns are
    carried, whatever they are called.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    cut = substring_dedup.dedup_substrings(docs.select("doc_id", "text", rest.alias("rest")), with_text=True, carry=("rest",))

    def column(name: str):
        if name in ("doc_id", "text"):
            return F.col(name)
        kept = F.col("rest")[name]
        return (F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(kept) if name == "n_chars" else kept).alias(name)

    return cut.select(*[column(c) for c in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows, with all their columns, that cover no benchmark item by four fifths or more.

    Null and empty texts cover nothing; null items and items without words are covered by nothing.
    """
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens; a null or empty text is its end mark alone, repeated rows are packed each."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", leaks),
    ("packing", packed),
]

#: Tokenizer ids and a learned model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's result is written before the next one reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
