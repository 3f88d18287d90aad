"""Candidate buckets and groups in bounded blocks: every pair of a group meets in one block, however large the group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlake.llm.tables import materialize

#: Rows of a chunk: a group is cut into up to SPREAD chunks of SMALL rows, into larger ones of up to LARGE rows beyond that.
SMALL, LARGE, SPREAD = 512, 2048, 64
#: Groups of so many rows at most are compared many at a time.
FEW = 48


class Forest:
    """Union-find over positions; ``join`` tells whether two trees became one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` of each group of non-null ``keys``, streamed from sorted partitions; groups must be bounded."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [], 0
        for group in _runs(batches, keys):
            made = function(group)
            if made is not None and made.num_rows:
                out.append(made)
                rows += made.num_rows
                if rows > 20_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, rows = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(per_partition, schema)


def map_runs(df: DataFrame, keys: list[str], function: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Like ``map_groups``, but ``function`` takes many whole groups at once: a table and the rows where groups begin."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def begins(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for k in keys:
                column = table[k].to_numpy()
                new[1:] |= column[1:] != column[:-1]
            return np.flatnonzero(new)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            at = begins(table)
            if len(at) > 1:  # the last group may go on
                made = function(table.slice(0, at[-1]).combine_chunks(), at[:-1])
                if made is not None and made.num_rows:
                    yield made
                held = table.slice(at[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            made = function(table, begins(table))
            if made is not None and made.num_rows:
                yield made

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(per_partition, schema)


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows (bucket, band, node, ...) of the buckets that hold two nodes or more.

    Buckets that hold the same nodes say the same; the one of the lowest band stays.
    """
    sizes = rows.groupBy("bucket", "band").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("print"), F.min("node").alias("low"))
    one = sizes.where("members > 1").groupBy("members", "print", "low").agg(F.min(F.struct("band", "bucket")).alias("kept"))
    return rows.join(one.select("kept.bucket"), "bucket")


def deal_blocks(df: DataFrame, by: str, rest: str | None = None, small: int | None = None, large: int | None = None) -> DataFrame:
    """Add (chunk, lo, hi): a row goes to the blocks of its chunk with every chunk of its group ``by``.

    ``rest`` names a boolean column: rows without it need not meet each other, so their chunks meet
    only those of rows with it, and few of the latter cost few copies, however large the group.
    """
    own = df.withColumn("_rest", F.col(rest) if rest else F.lit(True))
    sizes = materialize(own.groupBy(by).agg(F.count("*").alias("_all"), F.count_if("_rest").alias("_open")), "group-sizes")
    sizes = sizes.where("_open > 0 and _all > 1")
    rows = F.expr(f"least({large or LARGE}, greatest({small or SMALL}, _all div {SPREAD}))")
    cut = sizes.select(by, F.ceil(F.col("_open") / rows).cast("int").alias("_k1"), F.ceil((F.col("_all") - F.col("_open")) / rows).cast("int").alias("_k0"))
    dealt = own.join(cut, by)
    turn = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    dealt = dealt.withColumn("chunk", F.when(F.col("_rest"), turn(F.col("_k1"))).otherwise(F.col("_k1") + turn(F.greatest("_k0", F.lit(1)))))
    upto = F.when(F.col("_rest"), F.col("_k1") + F.col("_k0") - 1).otherwise(F.col("_k1") - 1)
    spread = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), upto)))
    return spread.select(*df.columns, "chunk", F.least("chunk", "_other").alias("lo"), F.greatest("chunk", "_other").alias("hi"))


def meeting(group: pa.Table, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) that meet in the blocks of ``group``, a bounded number at a time, each pair once."""
    rows = group.num_rows
    chunk, single = group["chunk"].to_numpy(), group["lo"].to_numpy() == group["hi"].to_numpy()
    size = np.diff(np.append(begins, rows))
    end = np.repeat(begins + size, size)
    few = np.repeat(size <= FEW, size)
    at = np.arange(rows)
    for shift in range(1, min(FEW, int(size.max(initial=0)))):
        i = at[few & (at + shift < end)]
        j = i + shift
        apart = single[i] | (chunk[i] != chunk[j])
        if apart.any():
            yield i[apart], j[apart]
    for begin, n in zip(begins[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        own = np.arange(begin, begin + n)
        if single[begin]:
            for k in range(n - 1):
                yield np.full(n - 1 - k, begin + k), own[k + 1 :]
        else:
            low = chunk[own] == chunk[own].min()
            right = own[~low]
            for i in own[low].tolist():
                if len(right):
                    yield np.full(len(right), i), right


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))
