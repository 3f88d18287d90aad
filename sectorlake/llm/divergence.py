"""Source divergence audit: how far the sources of a language lie from each other, and by which terms.

Sorted streaming instead of tables in memory: texts become runs of (lang, term, source, document), which are
sorted and scanned, first within slices of a task, then, dealt by (lang, term), over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.llm import words as W
from sectorlake.llm.tables import materialize

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Bytes of text that are sorted at once (or one longer text), pairs of sources that are summed at once, and sums that a task holds.
SLICE_BYTES, PAIRS, HELD = 8 << 20, 1 << 19, 1 << 20

_RUNS = "lang string, term string, source string, n_docs bigint, n bigint"
_FOUND = "lang string, term string, source string, n bigint, lang_n bigint, first int, other string, other_n bigint, n_terms bigint"
_FOUND_ARROW = pa.schema([
    ("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64()), ("first", pa.int32()),
    ("other", pa.string()), ("other_n", pa.int64()), ("n_terms", pa.int64()),
])


def _strings(words: W.Words) -> pa.Array:
    """The words as one string array; their bytes are copied once, without what lies between them."""
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    offsets = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(offsets), pa.py_buffer(words.data[np.cumsum(inside[:-1]) > 0]))


def _slice_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, document) of a slice sorted and scanned: documents and occurrences of each (lang, term, source)."""
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(k), "").dictionary_encode() for k in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
        known, group = np.unique(group, return_inverse=True)
        for words in W.segments(batch.column(2), lower=True, limit=SLICE_BYTES, hashed=False, letters=True):
            terms = _strings(words).dictionary_encode()
            n_terms, n_docs = len(terms.dictionary), len(words.offsets) - 1
            if not n_terms:
                continue
            doc = words.documents()
            keys = (group[words.lo + doc] * n_terms + terms.indices.to_numpy()) * n_docs + doc
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])  # a document's run
            runs = keys[first] // n_docs
            start = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            g, t = np.divmod(runs[start], n_terms)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(known[g] // len(source.dictionary))), terms.dictionary.take(pa.array(t)).cast(pa.string()),
                    source.dictionary.take(pa.array(known[g] % len(source.dictionary))), pa.array(np.diff(np.r_[start, len(first)])),
                    pa.array(np.diff(np.r_[first[start], len(keys)])),
                ],
                ["lang", "term", "source", "n_docs", "n"],
            )


def _starts(*columns: pa.Array) -> np.ndarray:
    """Places where any of the columns changes, 0 first."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


class _Pairs:
    """Numbers of terms by (lang, source, other source, count here, count there), summed before they leave the task."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def codes(self, values: pa.Array) -> np.ndarray:
        coded = values.dictionary_encode()
        own = np.array([self.names.setdefault(v, len(self.names)) for v in coded.dictionary.to_pylist()], np.int64)
        return own[coded.indices.to_numpy()]

    def add(self, lang: np.ndarray, source: np.ndarray, n: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Row i meets the ``after[i]`` rows behind it, which are of the same term."""
        ends = np.cumsum(after)
        lo = 0
        while lo < len(after):
            done = ends[lo] - after[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            a = np.repeat(np.arange(lo, hi), after[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(ends[lo:hi] - after[lo:hi] - done, after[lo:hi])
            self.parts.append(_summed(np.column_stack([lang[a], source[a], source[b], n[a], n[b], np.ones(len(a), np.int64)])))
            self.held += len(self.parts[-1])
            lo = hi
            if self.held > HELD:
                yield from self.flush(HELD // 2)

    def flush(self, above: int = 0) -> Iterator[pa.RecordBatch]:
        """What is held, summed, as rows, once that is more than ``above`` of them."""
        if not self.parts:
            return
        whole = _summed(np.concatenate(self.parts))
        self.parts, self.held = [whole], len(whole)
        if len(whole) > above:
            self.parts, self.held = [], 0
            names = pa.array(list(self.names), pa.string())
            text = lambda k: names.take(pa.array(whole[:, k]))
            yield _found(len(whole), lang=text(0), source=text(1), other=text(2), n=pa.array(whole[:, 3]), other_n=pa.array(whole[:, 4]), n_terms=pa.array(whole[:, 5]))


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows of equal keys as one, their last numbers summed."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows[:, 4::-1].T)]
    start = np.flatnonzero(np.r_[True, (rows[1:, :5] != rows[:-1, :5]).any(axis=1)])
    out = rows[start]
    out[:, 5] = np.add.reduceat(rows[:, 5], start)
    return out


def _found(length: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(length, f.type)).cast(f.type) for f in _FOUND_ARROW], schema=_FOUND_ARROW)


def _scan(least: int):
    """Scan sorted runs: rows of terms that enough documents of the language hold, and of pairs of sources that share them."""

    def emit(rows: pa.Table, starts: np.ndarray, pairs: _Pairs) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        n = column["n"].to_numpy()
        size = np.diff(np.r_[starts, rows.num_rows])
        docs, total = np.add.reduceat(column["n_docs"].to_numpy(), starts), np.add.reduceat(n, starts)
        kept = np.repeat(docs >= least, size)
        if not kept.any():
            return
        at = np.flatnonzero(kept)
        lang, term, source = (column[c].take(pa.array(at)) for c in ("lang", "term", "source"))
        head = np.zeros(rows.num_rows, np.int32)
        head[starts] = 1
        yield _found(len(at), lang=lang, term=term, source=source, n=pa.array(n[at]), lang_n=pa.array(np.repeat(total, size)[at]), first=pa.array(head[at]))
        after = np.repeat(starts + size, size) - 1 - np.arange(rows.num_rows)
        yield from pairs.add(pairs.codes(lang), pairs.codes(source), n[at], after[at])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, pairs = None, _Pairs()
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
            column = {c: whole.column(c).combine_chunks() for c in whole.column_names}
            at = _starts(column["lang"], column["term"], column["source"])
            summed = {c: column[c].take(pa.array(at)) for c in ("lang", "term", "source")}
            summed |= {c: pa.array(np.add.reduceat(column[c].to_numpy(), at)) for c in ("n_docs", "n")}
            runs = pa.table(summed)
            starts = _starts(summed["lang"], summed["term"])
            carried = runs.slice(starts[-1])  # the open term, one row a source
            yield from emit(runs.slice(0, starts[-1]), starts[:-1], pairs)
        if carried is not None:
            yield from emit(carried, np.zeros(1, np.int64), pairs)
        yield from pairs.flush()

    return scanned


def term_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n_docs, n): partial runs over all whole texts, one a slice of a task; nulls count as ''."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(_slice_runs, _RUNS)


def scan_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, source, n, lang_n, first) and pairs (lang, source, other, n, other_n, n_terms).

    Runs of a term meet in one task, sorted, at most one row a source and slice of text, so a term of all
    documents costs as many rows as there are slices.  A pair row says how many kept terms have ``n``
    occurrences in the one and ``other_n`` in the other source (the smaller name first; both over 0); its
    numbers are partial and add up over tasks.
    """
    dealt = term_runs(docs).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = materialize(dealt.mapInArrow(_scan(least), _FOUND), "term-runs")
    terms = found.where("other is null").select("lang", "term", "source", "n", "lang_n", "first")
    return terms, found.where("other is not null").select("lang", "source", "other", "n", "other_n", "n_terms")


def _whole(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("decimal(38,0)")


def _share(n: Column, total: Column, kept: Column, smooth: int) -> Column:
    """1 and the floor of SCALE times the smoothed share, exact."""
    return (1 + F.call_function("div", _whole(SCALE) * (_whole(n) + smooth), F.nullif(_whole(total) + smooth * _whole(kept), _whole(0)))).cast("long")


def _distance(p: Column, q: Column) -> Column:
    """The floored chi-square term of two scaled shares; at most 10**18."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, smooth: int = 1) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against each other one of its language, and against the language.

    Part ``pair`` sums chi-square terms of smoothed shares over all terms that ``least`` documents of the
    language hold, from its own side; part ``term`` has the ``top`` terms that a source uses more than its
    language.  A pair's sum is that of two sources without terms, corrected for the terms that one
    of them has (by their numbers of each count) and for those of both (by pairs of counts), so absent terms
    cost nothing.  Null lang, source and text count as ''; repeated rows are documents each; a source
    without terms has its pairs, a language without kept terms values of 0; an empty table gives no rows.
    Ties: the smaller item in bytes.  Other columns are ignored.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    terms, pairs = scan_terms(docs, least)
    # Numbers of terms by count, from which all totals follow.
    counts = materialize(terms.groupBy("lang", "source", "n").agg(F.count("*").alias("n_terms")), "counts")
    kept = terms.groupBy("lang").agg(F.sum("first").alias("kept"))
    own = counts.groupBy("lang", "source").agg(F.sum(_whole(F.col("n")) * F.col("n_terms")).cast("long").alias("total"))
    totals = own.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = docs.select(blank("lang"), blank("source")).distinct().join(own, ["lang", "source"], "left").join(kept, "lang", "left").join(totals, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total"])
    groups = materialize(groups.withColumn("zero", _share(F.lit(0), F.col("total"), F.col("kept"), smooth)), "groups")

    side = lambda suffix: groups.select("lang", *[F.col(c).alias(c + suffix) for c in ("source", "total", "kept", "zero")])
    grid = side("_a").join(side("_b").drop("kept_b"), "lang").where("source_a <> source_b")
    f00 = _distance(F.col("zero_a"), F.col("zero_b"))
    add = lambda x, n: _whole(x) * _whole(n)
    base = grid.select("lang", "source_a", "source_b", F.when(F.col("kept_a") > 0, add(f00, F.col("kept_a"))).otherwise(_whole(0)).alias("value"))
    share = lambda n, s: _share(F.col(n), F.col(f"total_{s}"), F.col("kept_a"), smooth)
    one = counts.withColumnRenamed("source", "source_a").join(grid, ["lang", "source_a"]).withColumn("p", share("n", "a"))
    one = one.select("lang", "source_a", "source_b", add(_distance(F.col("p"), F.col("zero_b")) - f00, F.col("n_terms")).alias("value"))
    other = counts.withColumnRenamed("source", "source_b").join(grid, ["lang", "source_b"]).withColumn("q", share("n", "b"))
    other = other.select("lang", "source_a", "source_b", add(_distance(F.col("zero_a"), F.col("q")) - f00, F.col("n_terms")).alias("value"))
    met = pairs.groupBy("lang", "source", "other", "n", "other_n").agg(F.sum("n_terms").alias("n_terms"))
    ways = met.select("lang", "n_terms", F.explode(F.array(
        F.struct(F.col("source").alias("source_a"), F.col("other").alias("source_b"), F.col("n").alias("n_a"), F.col("other_n").alias("n_b")),
        F.struct(F.col("other").alias("source_a"), F.col("source").alias("source_b"), F.col("other_n").alias("n_a"), F.col("n").alias("n_b")),
    )).alias("w")).select("lang", "n_terms", "w.*")
    both = ways.join(grid, ["lang", "source_a", "source_b"]).withColumns({"p": share("n_a", "a"), "q": share("n_b", "b")})
    corrected = _distance(F.col("p"), F.col("q")) - _distance(F.col("p"), F.col("zero_b")) - _distance(F.col("zero_a"), F.col("q")) + f00
    both = both.select("lang", "source_a", "source_b", add(corrected, F.col("n_terms")).alias("value"))
    summed = base.unionByName(one).unionByName(other).unionByName(both).groupBy("lang", "source_a", "source_b").agg(F.sum("value").cast("long").alias("value"))
    pair = summed.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    held = terms.join(groups, ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("kept"), smooth)
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), smooth)
    term = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    term = term.select("lang", "source", "part", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    best = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(best)
