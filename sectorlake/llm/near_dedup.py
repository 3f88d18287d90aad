"""MinHash near-dedup: HyperMinHash registers, banding, corrected estimates, then full-set confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlake.llm import blocks
from sectorlake.llm import words as W
from sectorlake.llm.components import connected_components
from sectorlake.llm.tables import materialize

SHINGLE = 5
THRESHOLD = Fraction(8, 10)
#: 2**BUCKET_BITS registers, each of leading zeros (6 bits) and MANTISSA_BITS bits behind the first one.
BUCKET_BITS = 7
MANTISSA_BITS = 10
REGISTERS = 1 << BUCKET_BITS
#: BANDS * ROWS registers are banded: a pair of similarity 0.85 misses all bands with probability 4e-7, one of 0.8 with 5e-5.
BANDS, ROWS = 25, 5
#: Standard errors by which an estimate may lie under the threshold and still be confirmed on full sets.
SLACK = 4.5
LAST = (1 << 63) - 1
#: Rounds in which buckets are confirmed against a leader before what is left meets in blocks.
LEADER_ROUNDS = 2
#: Members that meet their leader's text in one group.
PART = 128

_U = np.uint64
#: For each try, the register that an empty register j looks at.
_TRIES = (W.mix(np.arange(512 * REGISTERS, dtype=np.uint64) + _U(7)) % _U(REGISTERS)).astype(np.int64).reshape(512, REGISTERS)


def shingles(words: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document), sorted and distinct, of runs of k words; a shorter text is one shingle."""
    hashes, _, doc = words.windows(k)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = W._spans(words.hashes, words.first[short], words.first[short + 1])
        hashes, doc = np.concatenate([hashes, own]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def compress(rest: np.ndarray) -> np.ndarray:
    """Leading zeros and the next MANTISSA_BITS bits of 64-bit values, in 16 bits."""
    zeros = np.zeros(len(rest), np.uint64)
    x = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        empty = (x >> _U(64 - step)) == 0
        zeros[empty] += _U(step)
        x[empty] <<= _U(step)
    zeros = np.minimum(zeros, _U(63))
    return ((zeros << _U(MANTISSA_BITS)) | ((x << _U(1)) >> _U(64 - MANTISSA_BITS))).astype(np.uint16)


def registers(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Registers (n documents x REGISTERS) of sorted distinct hashes.

    The top bits choose the register, which keeps its smallest rest.  An empty register takes the
    value of the first non-empty one among registers that depend on its own number alone, so that
    registers of short texts still agree as often as their sets do.
    """
    bucket = (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)
    place = doc * REGISTERS + bucket
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    flat = np.zeros(n * REGISTERS, np.uint16)
    flat[place[first]] = compress(hashes[first] << _U(BUCKET_BITS))
    have = np.zeros(n * REGISTERS, bool)
    have[place[first]] = True
    out, have = flat.reshape(n, REGISTERS), have.reshape(n, REGISTERS)
    lacking = np.flatnonzero(have.any(1) & ~have.all(1))
    value, got = out[lacking], have[lacking].copy()
    origin_value, origin = out[lacking].copy(), have[lacking]
    for sources in _TRIES:
        if not len(lacking):
            break
        take = ~got & origin[:, sources]
        value[take] = origin_value[:, sources][take]
        got |= take
        done = got.all(1)
        if done.any():
            out[lacking[done]] = value[done]
            stay = ~done
            lacking, value, got, origin_value, origin = lacking[stay], value[stay], got[stay], origin_value[stay], origin[stay]
    for i, v, g, o in zip(lacking, value, got, origin, strict=True):
        v[~g] = v[np.flatnonzero(o)[0]]
        out[i] = v
    return out


def _sketch(k: int):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in W.segments(batch.column(2), lower=True):
                n = len(words.offsets) - 1
                hashes, doc = shingles(words, k)
                size = np.bincount(doc, minlength=n)
                d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                some = np.flatnonzero(size)
                if len(some):
                    at = np.searchsorted(doc, some)
                    d1[some] = np.add.reduceat(hashes, at)
                    d2[some] = np.add.reduceat(W.mix(hashes ^ _U(0x5851F42D4C957F2D)), at)
                sketch = registers(hashes, doc, n)
                own = [batch.column(c).slice(words.lo, n) for c in (0, 1, 3, 4)]
                made = [pa.array(size.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([r.tobytes() for r in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *made], ["doc_key", "doc_id", "h1", "h2", "n", "d1", "d2", "sketch"])

    return per_batch


def _bands(bands: int, rows: int):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS).astype(np.uint64)
            keys = np.zeros((len(sketch), bands), np.uint64)
            for b in range(bands):
                key = np.full(len(sketch), b + 1, np.uint64)
                for r in range(rows):
                    key = W.mix(key ^ (sketch[:, b * rows + r] + _U(r << 20)))
                keys[:, b] = key
            node = np.repeat(batch.column(0).to_numpy(), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), len(sketch))
            yield blocks.batch_of(bucket=keys.reshape(-1).view(np.int64), band=band, node=node)

    return per_batch


def estimate(matches: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the collisions expected of compressed ones.

    The expected share of collisions is that of the HyperMinHash paper (Yu and Weber, 2017) for sets
    of more elements than registers: 0.16992 * 2**-mantissa * 4nm / (n + m)**2.
    """
    x = n / np.maximum(m, 1)
    by_chance = 0.16992 * 2.0**-MANTISSA_BITS * 4 * x / (1 + x) ** 2
    return (matches - by_chance) / (1 - by_chance)


def _sketches(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _close(group: pa.Table, begins: np.ndarray, threshold: float, bands: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unlike label that meet in these blocks, whose estimate reaches the threshold less SLACK standard errors.

    A pair that shares several bands is taken in the lowest of them only.
    """
    cut = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    sketch, n = _sketches(group), group["n"].to_numpy().astype(float)
    label, band = group["label"].to_numpy(), group["band"].to_numpy()
    for i, j in blocks.meeting(group, begins):
        unlike = label[i] != label[j]
        i, j = i[unlike], j[unlike]
        if not len(i):
            continue
        near = estimate((sketch[i] == sketch[j]).mean(1), np.minimum(n[i], n[j]), np.maximum(n[i], n[j])) >= cut
        i, j = i[near], j[near]
        same = (sketch[i, : bands * rows] == sketch[j, : bands * rows]).reshape(len(i), bands, rows).all(2)
        lowest = same.argmax(1) == band[i] if len(i) else np.zeros(0, bool)
        if lowest.any():
            yield i[lowest], j[lowest]


def _flag(threshold: float, bands: int, rows: int):
    """The rows of blocks that have a close pair."""

    def per_run(group: pa.Table, begins: np.ndarray) -> pa.RecordBatch | None:
        met = np.zeros(group.num_rows, bool)
        for i, j in _close(group, begins, threshold, bands, rows):
            met[i] = met[j] = True
        kept = group.filter(pa.array(met)).select(["bucket", "lo", "hi", "chunk", "band", "node", "label"]).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else None

    return per_run


def _sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row), sorted by row, of the distinct shingles of each text."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for words in W.segments(texts, lower=True):
        own, doc = shingles(words, k)
        hashes.append(own)
        owners.append(words.lo + doc)
    return np.concatenate(hashes), np.concatenate(owners)


def _star(k: int, threshold: Fraction):
    """Confirm members of each (leader, part) against the leader's full set."""
    num, den = threshold.numerator, threshold.denominator

    def per_run(group: pa.Table, begins: np.ndarray) -> pa.RecordBatch | None:
        rows = group.num_rows
        node, leader = group["node"].to_numpy(), group["leader"].to_numpy()
        which = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, rows)))
        leads = node == leader
        hashes, owner = _sets(group["text"], k)
        size = np.bincount(owner, minlength=rows)
        own = W.mix(hashes ^ W.mix(which[owner].astype(np.uint64)))
        theirs = ~leads[owner]
        both = np.bincount(owner[theirs][np.isin(own[theirs], own[~theirs])], minlength=rows)
        of_leader = np.zeros(len(begins), np.int64)
        of_leader[which[leads]] = size[leads]
        union = size + of_leader[which] - both
        linked = ~leads & (both * den >= num * union)
        return blocks.batch_of(a=node[linked], b=leader[linked])

    return per_run


#: Hashes that are compared at once when a large block is confirmed by matrix products.
SLAB = 4096


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes (left x right) by products of 0/1 matrices over slabs of shared hashes."""
    every = np.concatenate([sets[i] for i in range(len(sets))])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared, code, times = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    code, owner = rank[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, SLAB):
        a, b = np.searchsorted(code, [lo, lo + SLAB])
        has = np.zeros((len(sets), SLAB), np.float32)
        has[owner[a:b], code[a:b] - lo] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def _confirm(k: int, threshold: Fraction, bands: int, rows: int):
    """Confirm the close pairs of a block on full sets, as far as they aren't connected yet."""
    num, den = threshold.numerator, threshold.denominator

    def per_block(group: pa.Table) -> pa.RecordBatch | None:
        group = group.combine_chunks()
        pairs = list(_close(group, np.zeros(1, np.int64), float(threshold), bands, rows))
        if not pairs:
            return None
        hashes, owner = _sets(group["text"], k)
        sets = np.split(hashes, np.searchsorted(owner, np.arange(1, group.num_rows)))
        size = np.array([len(s) for s in sets])
        nodes, labels = group["node"].to_numpy(), group["label"].to_numpy()
        forest, found = blocks.Forest(len(sets)), []
        first: dict[int, int] = {}
        for i, x in enumerate(labels.tolist()):  # equal labels are connected already
            forest.join(first.setdefault(x, i), i)
        many = sum(len(i) for i, _ in pairs) > 4000
        shared = _intersections(sets, np.arange(len(sets)), np.arange(len(sets))) if many else None
        for i, j in ((int(x), int(y)) for i, j in pairs for x, y in zip(i, j, strict=True)):
            if forest.find(i) == forest.find(j) or num * max(size[i], size[j]) > den * min(size[i], size[j]):
                continue
            both = int(shared[i, j]) if many else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * den >= num * (size[i] + size[j] - both) and forest.join(i, j):
                found.append((i, j))
        at = np.array(found, np.int64).reshape(-1, 2)
        return blocks.batch_of(a=nodes[at[:, 0]], b=nodes[at[:, 1]])

    return per_block


def _to_leaders(rows: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(node, leader): each node with the lowest of its buckets' leaders that has another label.

    A bucket's leader is its lowest node by a hash that changes with ``turn``.
    """
    order = F.xxhash64(F.lit(turn), F.col("node"))
    own = F.struct(order.alias("order"), "node", "label")
    named = rows.join(labels, "node") if labels is not None else rows.withColumn("label", F.col("node"))
    leaders = named.groupBy("bucket").agg(F.min(own).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket", "lead")
    met = named.join(leaders, "bucket").where("label != lead.label")
    return met.groupBy("node").agg(F.min("lead").alias("lead")).select("node", F.col("lead.node").alias("leader"))


def _stars(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: Fraction) -> DataFrame:
    """(a, b): the (node, leader) pairs that full sets confirm; a leader's text goes to each part of its members."""
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("node"), F.expr(f"(members + {PART - 1}) div {PART}")).cast("int")
    dealt = materialize(pairs.join(sizes, "leader").select("leader", part.alias("part"), "node"), "leader-parts")
    heads = dealt.select("leader", "part").distinct().withColumn("node", F.col("leader"))
    return blocks.map_runs(dealt.unionByName(heads).join(texts, "node"), ["leader", "part"], _star(shingle, threshold), "a bigint, b bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, text, h1, h2): null doc_ids come last; a row is told from others by its key and its text's hashes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), "doc_id", text.alias("text"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
    )


def _found(docs: DataFrame, shingle: int, threshold: Fraction, bands: int, rows: int) -> DataFrame:
    """(doc_key, doc_id, h1, h2, row, n, first) per row of ``docs``: ``first`` is the least (doc_key, h1, h2, row) of its component."""
    share = float(threshold)
    keyed = _keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]
    sketches = keyed.mapInArrow(_sketch(shingle), f"doc_key bigint, doc_id {kind}, h1 bigint, h2 bigint, n bigint, d1 bigint, d2 bigint, sketch binary")
    sketched = materialize(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    own = F.struct("doc_key", "h1", "h2", "row")
    # A class is a node of its own, whatever doc_ids its rows have.
    classes = materialize(
        sketched.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(own).alias("first"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    # Below this many shingles only equal sets reach the threshold.
    least = -(-threshold.numerator // (threshold.denominator - threshold.numerator)) if threshold < 1 else LAST
    banded = classes.where(F.col("n") >= least).select("node", "sketch").mapInArrow(_bands(bands, rows), "bucket bigint, band int, node bigint")
    met = materialize(blocks.shared_buckets(banded), "shared-bands")
    # One text stands for a class; rows that share its key and text hold the same.
    chosen = classes.join(met.select("node").distinct(), "node", "left_semi").select("node", "first.doc_key", "first.h1", "first.h2")
    texts = materialize(keyed.join(chosen, ["doc_key", "h1", "h2"]).groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")

    links, labels = [], None
    for turn in range(LEADER_ROUNDS):
        pairs = materialize(_to_leaders(met, labels, turn), "to-leaders")
        found = materialize(_stars(pairs, texts, shingle, threshold), "leader-links")
        links.append(found)
        have = labels if labels is not None else texts.select("node", F.col("node").alias("label"))
        # A label follows its leader's: equal labels are always connected, connected nodes may have several.
        onto = have.join(found.select(F.col("a").alias("node"), "b"), "node", "left").withColumn("to", F.coalesce("b", "label")).select("node", "to")
        labels = materialize(onto.join(onto.select(F.col("node").alias("to"), F.col("to").alias("label")), "to").select("node", "label"), "labels")
    named = met.join(labels, "node")
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("members"))
    open_ = counts.groupBy("bucket").agg(F.max_by("label", F.struct("members", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1")
    rest = materialize(named.join(open_.select("bucket", "major"), "bucket").withColumn("rest", F.col("label") != F.col("major")).select("bucket", "band", "node", "label", "rest"), "open-buckets")
    dealt = blocks.deal_blocks(rest, "bucket", "rest").drop("rest")
    sketches_of = classes.select("node", "n", "sketch")
    key = ["bucket", "lo", "hi"]
    flagged = blocks.map_runs(dealt.join(sketches_of, "node"), key, _flag(share, bands, rows), "bucket bigint, lo int, hi int, chunk int, band int, node bigint, label bigint")
    flagged = materialize(flagged, "close-rows")
    last = blocks.map_groups(flagged.join(sketches_of, "node").join(texts, "node"), key, _confirm(shingle, threshold, bands, rows), "a bigint, b bigint")
    roots = connected_components(reduce(DataFrame.unionByName, [*links, last]), "a", "b")

    placed = classes.select("n", "d1", "d2", "node", "first").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("first"))
    by_class = placed.drop("first").join(firsts, "component").select("n", "d1", "d2", "first")
    return sketched.join(by_class, ["n", "d1", "d2"], "left").select("doc_key", "doc_id", "h1", "h2", "row", "n", F.coalesce("first", own).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Words are runs of bytes other than white space with A-Z lower-cased; a text's set holds its
    distinct runs of ``shingle`` words, a shorter text's whole sequence is one, and a null text or
    one without words has none and links with nothing.  Texts whose sets have a Jaccard similarity
    of ``threshold`` or more are linked; ``component_id`` is the smallest doc_id reachable and ``kept``
    marks its row.  Equal sets are one class and need no pairs.  Links are between texts: rows that share
    a doc_id, or have none, are linked only if their texts are.  Null doc_ids come last: a component of
    nothing else has a null component_id, and one of its rows is kept.  An empty table gives no rows;
    other columns are ignored.

    Sketches are banded.  In each bucket members are first confirmed against one of them, the leader,
    so a group of near copies costs a comparison a text.  Buckets that still hold several labels are compared
    in blocks of registers, texts outside a bucket's main label with all; those with a corrected
    estimate no further than SLACK standard errors under the threshold are confirmed on full sets, and
    only texts of such pairs travel.  Neither a bucket nor a group is ever gathered or written as pairs.
    """
    component = F.col("first.doc_key")
    return _found(docs, shingle, threshold, bands, rows).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(component < LAST, component).alias("component_id"),
        F.when(component < LAST, F.col("doc_key") == component).otherwise(F.col("row") == F.col("first.row")).alias("kept"),
    )


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their component by (doc_id, hash of the text).

    Null doc_ids come last.  Rows without words are a component each, but of rows that share doc_id and text one stays.
    """
    first = F.col("first")
    kept = _found(docs, shingle, threshold, BANDS, ROWS).where(first["row"] == F.col("row")).select(*(F.col(c).alias(f"_{c}") for c in ("doc_key", "h1", "h2"))).distinct()
    text = F.coalesce("text", F.lit(""))
    own = docs.withColumns({
        "_doc_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text), "_null": F.col("text").isNull()
    })
    return own.join(kept, ["_doc_key", "_h1", "_h2"], "left_semi").dropDuplicates(["_doc_key", "_h1", "_h2", "_null"]).select(*docs.columns)
