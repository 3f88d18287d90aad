"""Target-distribution importance resampling: documents drawn by how much likelier the target makes their word n-grams.

Hashed n-gram counts weigh each document against a target (Xie et al., "Data Selection for Language
Models via Importance Resampling", 2023), and Gumbel noise on the weights draws without replacement.
DuckDB takes the n-grams of each partition's texts in SQL; their bucket counts are spilled to Parquet,
which Spark sums over all documents and scores.
"""

from __future__ import annotations

import shutil
import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sectorlake.llm.tables import drop, materialize

BUCKETS = 10_000
NGRAMS = 2
#: Bytes of text that one DuckDB statement takes (or one longer text), its megabytes of memory before it spills, and those for each megabyte of a longer text.
SLICE_BYTES, DUCKDB_MEMORY, FOR_LONG = 2 << 20, 300, 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _crc32(features: pa.Array | pa.ChunkedArray) -> pa.Array:
    """zlib's CRC-32 of each string's bytes, read in place."""
    whole = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    kind = np.int64 if pa.types.is_large_string(whole.type) else np.int32
    _, where, data = whole.buffers()
    at = np.frombuffer(where, kind)[whole.offset : whole.offset + len(whole) + 1].tolist()
    view = memoryview(data if data is not None else b"")
    return pa.array(np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, len(whole)))


def _statement(n: int, buckets: int) -> str:
    """Words by position, runs of 1 to ``n`` of them, and each document's counts by bucket, in bucket order."""
    runs = [" || ' ' || ".join(["w", *(f"lead(w, {k}) over by_place" for k in range(1, size))]) for size in range(1, n + 1)]
    return f"""
with docs as (select i, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as ws from texts),
words as (select i, unnest(ws) as w, generate_subscripts(ws, 1) as place from docs),
grams as (select i, {", ".join(f"{run} as g{k}" for k, run in enumerate(runs))} from words window by_place as (partition by i order by place)),
features as ({" union all ".join(f"select i, g{k} as f from grams where g{k} is not null" for k in range(n))}),
counted as (select i, cast(crc32(f) % {buckets} as integer) as bucket, count(*) as n from features group by i, bucket),
listed as (select i, list(bucket order by bucket) as buckets, list(n order by bucket) as counts from counted group by i)
select cast(len(ws) as bigint) as n_words, coalesce(buckets, []) as buckets, coalesce(counts, []) as counts from docs left join listed using (i) order by docs.i"""


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(from, to, bytes) of runs of texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield lo, hi, int(ends[hi - 1] - before)
        lo = hi


def bucket_counts(docs: DataFrame, carry: list[str], n: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(carried columns, n_words, buckets, counts): each row's n-gram counts by bucket of their CRC-32; a null text has none.

    ``text`` is read whole.  Words are runs of digits, lower-cased A-Z and everything beyond ASCII.  Each task
    has one DuckDB of one thread, which takes some megabytes of text at a time.
    """
    rows = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in carry])
    statement = _statement(n, buckets)
    made = pa.schema([("n_words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = tempfile.mkdtemp(prefix="ngrams-")  # the task's own scratch, removed with it
        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MEMORY}MB", "temp_directory": spill})
        try:
            con.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                texts = batch.column(0)
                for lo, hi, size in _slices(texts):
                    if size > SLICE_BYTES:
                        con.execute(f"set memory_limit = '{DUCKDB_MEMORY + FOR_LONG * (size >> 20)}MB'")
                    con.register("texts", pa.table({"i": pa.array(np.arange(hi - lo)), "text": texts.slice(lo, hi - lo)}))
                    found = con.sql(statement).to_arrow_table().cast(made).combine_chunks()
                    con.unregister("texts")
                    kept = batch.slice(lo, hi - lo)
                    columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in found.columns]
                    yield pa.RecordBatch.from_arrays([*kept.columns[1:], *columns], [*kept.schema.names[1:], *made.names])
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return rows.mapInArrow(counted, StructType([*rows.schema.fields[1:], *StructType.fromDDL("n_words bigint, buckets array<int>, counts array<bigint>")]))


def bucket_totals(counted: DataFrame) -> DataFrame:
    """(bucket, total) over all rows of ``bucket_counts``; summed within tasks before anything moves."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("total"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Floored thousandths of the log-ratio of target to raw in each bucket, with one added to every count.

    ``raw`` and ``target`` are ``bucket_totals``.  As many numbers as buckets come to the driver, whatever the corpus.
    """
    grid = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = grid.join(raw.withColumnRenamed("total", "s"), "bucket", "left").join(target.withColumnRenamed("total", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    found = both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # one row
    return [r["gain"] for r in sorted(found.collect())]


def _floored_mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n), n)).otherwise(0)


def gumbel(key: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel draw that ``seed`` and ``key`` decide alone; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add ``name``: 1, 2, 3, ... over all rows in ``order``, which should end in a column that tells equal rows apart.

    Rows are dealt by ranges of the order and numbered within each range; the ranges' counts, a row a
    partition, are summed in one order.  No task holds more than its range.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    dealt = materialize(dealt.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(before, "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_at", "_range", "_place", "_before")


def score_documents(
    docs: DataFrame, target: DataFrame, carry: tuple[str, ...] = (), n: int = NGRAMS, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7
) -> DataFrame:
    """(doc_id, carried columns, n_features, weight, score, rank), all long, for every row of ``docs``.

    ``weight`` is the floored mean gain of a text's features against ``target`` (text), ``score`` adds the
    draw of its doc_id, and ``rank`` numbers the best ``percent`` of a hundred of the texts of ``least_words``
    or more; others have null.  Ties go to the smaller doc_id, null ids last; rows equal in id and score are ordered by
    features and weight, and rows that repeat wholly are each ranked.  Null and empty texts have no
    features and weight 0.  An empty target or table is no error.  Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_rest")] if carry else []))
    kept = ["doc_id", "_rest"] if carry else ["doc_id"]
    counted = materialize(bucket_counts(rows, kept, n, buckets), "bucket-counts")
    aim = bucket_totals(bucket_counts(target.select("text"), [], n, buckets))
    gains = bucket_gains(bucket_totals(counted), aim, buckets)
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: c * F.get(table, b)), F.lit(0).cast("long"), lambda s, x: s + x)
    features = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    weighed = counted.select(*kept, "n_words", features.alias("n_features"), total.alias("_total"))
    weighed = weighed.withColumn("weight", _floored_mean(F.col("_total"), F.col("n_features")).cast("long"))
    scored = weighed.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "_row": F.monotonically_increasing_id()}).drop("_total")
    scored = materialize(scored, "scores")
    drop(counted)
    long_enough = F.col("n_words") >= least_words
    drawn = F.floor(scored.where(long_enough).count() * F.lit(percent) / 100)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    numbered = ranked(scored.where(long_enough), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    out = numbered.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    rest = [F.col("_rest")[c].alias(c) for c in carry]
    return out.select("doc_id", *rest, "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` draws, with all their columns as they are."""
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(F.col("doc_id"), F.col("text"), *[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner, strict=True)])
    found = score_documents(renamed, target, tuple(inner), **options).where("rank is not null")
    return found.select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner, strict=True)])
