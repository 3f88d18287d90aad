"""Sums, numbers and carried values in one order of a stream, however long it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.sources.shared import written

#: Estimated bytes up to which rows are put in order by a plain window.
SMALL_BYTES = 128 << 20
#: Estimated bytes (of Parquet, mostly) of a slice of whole streams, and slices where an estimate is far off.
SLICE_BYTES, MOST_SLICES = 4 << 20, 4096
#: Rows of a stream (of one ``by``) beyond which it is cut.
LONG = 1 << 21

_TOTAL = {"sum": F.sum, "min": F.min, "max": F.max}


def _over(kind: str, value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window) if kind == "last" else _TOTAL[kind](value).over(window)


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's planner takes the size of ``df`` to be; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, by: tuple[str, ...] | list[str]) -> DataFrame:
    """``df`` with each stream in one of as many partitions as its size asks for, so that what a task sorts doesn't grow with the input."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_SLICES, -(-estimated_bytes(df) // SLICE_BYTES)))
    return df.repartition(n, *by)


_BOTH = {
    "sum": lambda o, s: (F.coalesce(o, F.lit(0)) + F.coalesce(s, F.lit(0))).cast("long"),
    "min": F.least, "max": F.greatest, "last": lambda o, s: F.coalesce(s, o),
}


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], by: tuple[str, ...] = (), inclusive: bool = False, width: int | None = None) -> DataFrame:
    """Add running values over the rows before each one (``inclusive``: and itself) in ``order`` within ``by``.

    ``values`` gives for each new column a kind and what it is taken of: ``sum`` (0 where nothing came
    before), ``min``, ``max``, or ``last``, the last non-null one.  Rows must be distinct in ``order`` within
    ``by``.  In tables of more than SMALL_BYTES, streams of more than LONG rows go through two levels, so no task
    holds one: rows are cut into chunks, chunks' totals are put in one order and join back to running values
    within a chunk.  Chunks are ``width`` consecutive keys of the first order column where that is given, for keys
    that lie dense; else ranges of ``by`` and ``order`` of about equal numbers of rows, which are written down
    first.  All other streams cost one shuffle, in slices that follow the size.  All ways give the same values.
    """
    if by and not width and estimated_bytes(df) > SMALL_BYTES:
        long = written(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > LONG).select(*by), "long-streams")
        if long.isEmpty():
            return _plain(dealt(df, by), order, values, by, inclusive)
        met = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by))
        short, cut = (df.alias("a").join(F.broadcast(long.alias("b")), met, how) for how in ("left_anti", "left_semi"))
        return _plain(dealt(short, by), order, values, by, inclusive).unionByName(_cut(cut, order, values, by, inclusive, None))
    return _plain(df, order, values, by, inclusive) if estimated_bytes(df) <= SMALL_BYTES else _cut(df, order, values, by, inclusive, width)


def _plain(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], by: tuple[str, ...], inclusive: bool) -> DataFrame:
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    keyed = df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    found = {n: _over(kind, F.col(f"_v_{n}"), whole) for n, (kind, _) in values.items()}
    made = {n: _BOTH["sum"](F.lit(None), c) if values[n][0] == "sum" else c for n, c in found.items()}
    return keyed.withColumns(made).drop(*[f"_v_{n}" for n in values])


def _cut(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], by: tuple[str, ...], inclusive: bool, width: int | None) -> DataFrame:
    keyed = df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    end = 0 if inclusive else -1
    if width:
        keyed, inner = keyed.withColumn("_chunk", F.call_function("div", F.col(order[0]).cast("long"), F.lit(width).cast("long"))), order
    else:
        ranged = keyed.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_row_at", F.monotonically_increasing_id())
        keyed, inner = written(ranged, "ranges").withColumn("_chunk", F.shiftright("_row_at", 33)), ["_row_at"]
    own = [*by, "_chunk"]

    def total(name: str, kind: str) -> Column:
        value = F.col(f"_v_{name}")
        return (F.max_by(value, F.when(value.isNotNull(), F.struct(*inner))) if kind == "last" else _TOTAL[kind](value)).alias(f"_t_{name}")

    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*own).agg(*[total(n, kind) for n, (kind, _) in values.items()])
    offsets = totals.select(*own, *[_over(kind, F.col(f"_t_{n}"), before).alias(f"_o_{n}") for n, (kind, _) in values.items()])
    local = Window.partitionBy(*own).orderBy(*inner).rowsBetween(Window.unboundedPreceding, end)
    same = F.lit(True)
    for c in own:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    # Ranges of long streams are few: one row for each, and one more for each stream.
    out = keyed.alias("a").join(offsets.alias("b") if width else F.broadcast(offsets.alias("b")), same).select("a.*", *[f"b._o_{n}" for n in values])
    out = out.withColumns({f"_s_{n}": _over(kind, F.col(f"_v_{n}"), local) for n, (kind, _) in values.items()})
    made = {n: _BOTH[kind](F.col(f"_o_{n}"), F.col(f"_s_{n}")) for n, (kind, _) in values.items()}
    return out.withColumns(made).drop("_chunk", "_row_at", *[f"_{k}_{n}" for k in "vos" for n in values])


def exclusive_sums(df: DataFrame, key: str, sums: dict[str, Column], by: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """Add, for each name of ``sums``, the total of its column over rows of smaller ``key`` (of the same ``by``)."""
    return running(df, [key], {n: ("sum", c) for n, c in sums.items()}, by, width=width)


def numbered(df: DataFrame, key: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in ``key`` order within ``by``."""
    return exclusive_sums(df, key, {name: F.lit(1)}, by)
