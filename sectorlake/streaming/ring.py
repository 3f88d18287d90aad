"""A two-half audio ring as keyed streaming state, and its batch equal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTPUT = "stream_id string, block bigint, underrun boolean"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State: the block held in each half. A boundary that finds another block there is an underrun."""
    held = list(state.get) if state.exists else [-1, -1]
    out = []
    for p in batches:
        for kind, block in p.sort_values("field")[["kind", "block"]].itertuples(index=False, name=None):
            if kind == "loaded":
                held[block % 2] = block
            else:
                out.append((key[0], block, held[block % 2] != block))
    state.update(tuple(held))
    yield pd.DataFrame(out, columns=["stream_id", "block", "underrun"])


def underruns(events: DataFrame) -> DataFrame:
    """Streaming: (stream_id, block, underrun) at each ``boundary`` of (stream_id, field, kind, block) events."""
    return events.groupBy("stream_id").applyInPandasWithState(_advance, OUTPUT, "even bigint, odd bigint", "append", "NoTimeout")


def underruns_batch(events: DataFrame) -> DataFrame:
    """The same from a table: the last block loaded into the boundary's half before it, by a window."""
    half = Window.partitionBy("stream_id", F.pmod("block", F.lit(2))).orderBy("field").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("kind") == "loaded", F.col("block")), ignorenulls=True).over(half)
    return events.withColumn("held", held).where("kind = 'boundary'").select("stream_id", "block", (~F.col("held").eqNullSafe(F.col("block"))).alias("underrun"))
