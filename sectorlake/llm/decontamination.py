"""Benchmark decontamination by greedy string tiling over words (Wise, "YAP3", 1996).

Items and documents that share a seed of SEED words are tiled: the longest match of words that are
not marked yet is marked, again and again, down to SEED words.  Karp-Rabin fingerprints find the
matches.  The share of an item's words under tiles is its coverage, whatever their order, so reordered
passages are caught as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sectorlake.llm import words as W
from sectorlake.llm.tables import materialize

SEED = 5
THRESHOLD = 0.8
#: Benchmark text that one pass over the documents holds; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20


def _runs(free: np.ndarray) -> np.ndarray:
    """Free words from each position on."""
    stops = np.flatnonzero(~free)
    stops = np.r_[stops, len(free)]
    at = np.arange(len(free))
    return stops[np.searchsorted(stops, at)] - at


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) of at least ``least`` words.

    The longest match of words that are not marked yet is marked, again and again (ties: smallest item
    position, then document position).  Its length is found by halving, as a match of a length holds
    one of each smaller length; matches of one length are found by their fingerprints, and each
    fingerprint's places in the document are walked once, so pairs of places are never listed and
    repeated words cost no more than others.
    """
    if min(len(item), len(doc)) < least or least < 1:
        return []
    prints = W.Prefixes(np.concatenate([item, doc]))
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    item_at, doc_at = np.arange(len(item) - least + 1), np.arange(len(doc) - least + 1)

    def matches(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free starts, with their fingerprints, of the item and the document that match over n words."""
        i, j = item_at[item_runs[item_at] >= n], doc_at[doc_runs[doc_at] >= n]
        a, b = prints.spans(i, i + n), prints.spans(j + len(item), j + len(item) + n)
        in_doc, in_item = np.isin(a, b), np.isin(b, a)
        return i[in_doc], a[in_doc], j[in_item], b[in_item]

    found = []
    most = len(item)
    while most >= least:
        item_runs, doc_runs = _runs(item_free), _runs(doc_free)
        item_at, _, doc_at, _ = matches(least)
        if not len(item_at):
            break
        low, high = least, min(most, int(item_runs[item_at].max()), int(doc_runs[doc_at].max()))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(matches(middle)[0]) else (low, middle - 1)
        n = low
        starts, own, places, theirs = matches(n)
        order = np.argsort(theirs, kind="stable")
        theirs, places = theirs[order], places[order]
        begins, ends = np.searchsorted(theirs, own, "left").tolist(), np.searchsorted(theirs, own, "right").tolist()
        walked: dict[int, int] = {}
        for i, begin, end in zip(starts.tolist(), begins, ends, strict=True):
            if not item_free[i : i + n].all():
                continue
            k = walked.get(begin, begin)
            while k < end:
                j = int(places[k])
                taken = np.flatnonzero(~doc_free[j : j + n])
                if not len(taken):
                    break
                # Every start up to the last marked word is marked as well.
                k += int(np.searchsorted(places[k:end], j + taken[-1] + 1))
            walked[begin] = k
            if k < end:
                item_free[i : i + n] = doc_free[j : j + n] = False
                found.append((i, j, n))
        most = n - 1
    return sorted(found)


class Seeds:
    """Seeds of a block of items: all runs of SEED words; an item of fewer words is one seed itself."""

    def __init__(self, texts: list[str], seed: int):
        self.items: list[np.ndarray] = []
        for words in W.segments(pa.array(texts, pa.string()), lower=True, bare=True):
            self.items += [words.sequence(d) for d in range(len(words.counts))]
        self.least = [min(seed, len(x)) for x in self.items]
        prints, item, at, size = [], [], [], []
        for n, (words, k) in enumerate(zip(self.items, self.least, strict=True)):
            if k:
                starts = np.arange(len(words) - k + 1)
                prints.append(W._spans(words, starts, starts + k))
                item.append(np.full(len(starts), n))
                at.append(starts)
                size.append(np.full(len(starts), k))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        prints, item, at = join(prints, np.uint64), join(item, np.int64), join(at, np.int64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.item, self.at = prints[order], item[order], at[order]
        self.sizes = sorted({k for k in self.least if k})
        self.least_of, self.length_of = np.array(self.least, np.int64), np.array([len(x) for x in self.items], np.int64)

    def shared(self, prints: np.ndarray, threshold: float) -> list[int]:
        """Items whose words lie under seeds among ``prints`` (distinct) by ``threshold`` at least: no tiles cover more."""
        lo, hi = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        size = hi - lo
        if not size.sum():
            return []
        rows = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item, at = self.item[rows], self.at[rows]
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        least = self.least_of[item]
        ahead = least.copy()
        same = item[1:] == item[:-1]
        ahead[:-1][same] = np.minimum(least[:-1], at[1:] - at[:-1])[same]
        first = np.flatnonzero(np.r_[True, ~same])
        covered = np.add.reduceat(ahead, first)
        return item[first][covered >= threshold * self.length_of[item[first]]].tolist()


def _scan(seeds: Seeds, threshold: float, schema: pa.Schema):
    """For batches of (row, text): (row, item number, coverage, tiles, longest tile) of what is found."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for words in W.segments(batch.column(1), lower=True, bare=True):
                prints, docs = [], []
                for k in seeds.sizes:
                    own, _, doc = words.windows(k)
                    hit = np.isin(own, seeds.prints)
                    prints.append(own[hit])
                    docs.append(doc[hit])
                if not prints:
                    continue
                prints, docs = np.concatenate(prints), np.concatenate(docs)
                order = np.lexsort((prints, docs))
                prints, docs = prints[order], docs[order]
                new = np.r_[True, (prints[1:] != prints[:-1]) | (docs[1:] != docs[:-1])][: len(prints)]
                prints, docs = prints[new], docs[new]
                for d, own in zip(np.unique(docs).tolist(), np.split(prints, np.flatnonzero(np.diff(docs)) + 1), strict=False):
                    for n in seeds.shared(own, threshold):
                        item = seeds.items[n]
                        made = tiles(item, words.sequence(d), seeds.least[n])
                        covered = sum(t[2] for t in made)
                        if covered >= threshold * len(item):
                            found.append((batch.column(0)[words.lo + d].as_py(), n, covered / len(item), len(made), max(t[2] for t in made)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return per_batch


def _distinct_items(benchmark: DataFrame) -> DataFrame:
    """(h1, h2, text): each text of the benchmark once, however often it is repeated."""
    text = F.col("text")
    keyed = benchmark.where(text.isNotNull()).select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text)
    return keyed.groupBy("h1", "h2").agg(F.first("text").alias("text"))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows (h1, h2, text) of distinct items in blocks of about ``block_bytes`` of text, dealt by hash."""
    items = materialize(_distinct_items(benchmark), "benchmark-items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    block = F.pmod("h1", F.lit(max(1, -(-total // block_bytes))))
    for n in items.select(block.alias("block")).distinct().orderBy("block").collect():  # blocks that have items
        yield items.where(block == n["block"]).orderBy("h1", "h2").collect()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) for each document row and item covered by ``threshold`` or more.

    Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased.  Null texts
    and items without words match nothing; items of fewer words than ``seed`` must occur whole.
    Repeated rows are reported each, null ids too; empty tables give no rows; other columns are ignored.

    The benchmark is a query set: its distinct texts are held in blocks of bounded size, and each block
    takes one pass over all documents, in place, without a shuffle: the documents' seeds are looked up
    among the block's, and items that shared seeds could cover by ``threshold`` are tiled.  Ids come
    back by a join on the texts' hashes, so repeated items cost a row each.
    """
    spark = docs.sparkSession
    sql = f"doc_id {dict(docs.dtypes)['doc_id']}, h1 bigint, h2 bigint, coverage double, n_tiles int, longest_tile int"
    schema = to_arrow_schema(spark.createDataFrame([], sql).schema)
    flat = pa.schema([("row", schema.field(0).type), ("item", pa.int64()), ("coverage", pa.float64()), ("n", pa.int32()), ("longest", pa.int32())])

    def keyed(rows: list):
        scan = _scan(Seeds([r["text"] for r in rows], seed), threshold, flat)
        h1, h2 = (np.array([r[h] for r in rows], np.int64) for h in ("h1", "h2"))

        def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in scan(batches):
                item = found.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([found.column(0), pa.array(h1[item]), pa.array(h2[item]), *found.columns[2:]], schema=schema)

        return per_batch

    parts = [docs.select("doc_id", "text").mapInArrow(keyed(rows), sql) for rows in _blocks(benchmark, block_bytes)]
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], sql)
    named = benchmark.where(F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"))
    return out.join(named, ["h1", "h2"]).select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that cover no item by ``threshold`` or more.

    Null ids and texts, repeated rows and other columns, whatever their names, are kept as they are.
    """
    place = docs.columns.index("text")
    flag = pa.schema([("row", pa.int64()), ("item", pa.int64()), ("coverage", pa.float64()), ("n", pa.int32()), ("longest", pa.int32())])

    def keep(scan):
        def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plain = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], ["row", "text"])
                clean = np.ones(batch.num_rows, bool)
                for found in scan(iter([plain])):
                    clean[found.column(0).to_numpy()] = False
                yield batch.filter(pa.array(clean))

        return per_batch

    for rows in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(keep(_scan(Seeds([r["text"] for r in rows], seed), threshold, flag)), docs.schema)
    return docs
