"""Language-model scoring by masked pseudo-likelihood: a window network predicts every word from both sides.

A word's probability given the words around it is softmax over clusters times softmax within the
cluster, both linear in a hidden layer that sums position-wise embeddings of the neighbours.  Words
without an id of their own share buckets: such a word's probability is its bucket's times the word's
share of the bucket's counts.  Contexts that the network can't know, as both neighbours are without an id,
are remembered: their counts over the corpus, less the word's own occurrence, are mixed with the
network's probability.  A document's score is the sum of the log-probabilities of all its words, each masked in turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlake.llm import blocks
from sectorlake.llm import words as W
from sectorlake.llm.tables import drop, materialize

#: A network of C clusters has C * C ids: frequent words of the corpus each have one, all others share RARE * C by hash.
CLUSTERS, RARE = 32, 2
#: A vocabulary that fits this many clusters has an id for each word; C follows 2 * V ** (1/4) of V words where that is more.
WHOLE = 64
#: Words whose counts are looked up in place while scoring; those of all others are joined by hash.
KNOWN = 1 << 18
SIDE = 2
WIDTH = 24
#: Words of a training step for each cluster.
STEP_WORDS = 128
#: Rows that are worked on at once, so that their logits stay in a core's cache.
ROWS = 1024
#: While scoring, hidden values and weights are multiples of its inverse, so that sums below 2 ** 11 are exact in any order.
EXACT = 1 << 21
#: Logits from which a row's largest one is taken off before exponentials.
STEEP = 60.0
#: Occurrences of a remembered context that the network's probability weighs as much as.
PRIOR = 1.0
RATE = 0.1
#: Joined terms are summed as whole numbers of this fraction, so that their order doesn't matter.
FINE = float(1 << 32)
#: Words that are counted at once before they are shuffled.
COUNTED = 1 << 21
#: Models that are summed in one group while averaging.
FAN_IN = 32
#: Parameters of one slice of a model while averaging.
SLICE = 16_384


class Places:
    """Places in sorted hashes, looked up by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = min(max(len(hashes), 1).bit_length() + 2, 22)
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((hashes >> self.shift).view(np.int64), minlength=1 << bits)
        self.shared = counts > 1
        self.first = np.minimum(np.cumsum(counts) - counts, max(len(hashes) - 1, 0)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        lead = (hashes >> self.shift).view(np.int64)
        at = self.first.take(lead)
        met = self.hashes.take(at) == hashes
        out = np.where(met, at, np.int32(-1))
        rest = np.flatnonzero(self.shared.take(lead) & ~met)
        later = np.minimum(np.searchsorted(self.hashes, hashes[rest]), len(self.hashes) - 1)
        out[rest] = np.where(self.hashes[later] == hashes[rest], later, -1)
        return out


@dataclass
class Network:
    """Parameters in one vector, and views of it by name."""

    vocabulary: np.ndarray  #: sorted hashes of the frequent words
    ids: np.ndarray  #: their ids
    side: int
    width: int
    clusters: int
    weights: np.ndarray
    #: Counts of the words by bucket; None: a network that was not trained on a corpus.
    totals: np.ndarray | None = None
    #: (word, n) of every word of the corpus.
    counted: DataFrame | None = None
    #: The contexts of the corpus.
    remembered: Contexts | None = None

    @property
    def buckets(self) -> int:
        return RARE * self.clusters

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        n = self.clusters * self.clusters
        return {
            "rows": ((n + 1) * 2 * self.side, self.width), "hidden": (self.width,),
            "cluster": (self.clusters, self.width), "cluster_bias": (self.clusters,),
            "word": (self.clusters, self.clusters, self.width), "word_bias": (self.clusters, self.clusters),
        }

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = math.prod(shape)
            out[name] = vector[at : at + size].reshape(shape)
            at += size
        # An id's embeddings for all places are beside each other.
        out["embedding"] = out["rows"].reshape(-1, 2 * self.side, self.width).swapaxes(0, 1)
        return out

    @cached_property
    def places(self) -> Places:
        return Places(self.vocabulary)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by hash; rare words share the last ids."""
        n = self.clusters * self.clusters
        at = self.places.find(hashes)
        rare = n - self.buckets + (hashes % np.uint64(self.buckets)).astype(np.int64)
        return np.where(at >= 0, self.ids[at], rare) if len(self.vocabulary) else rare


def clusters_for(words: int) -> int:
    """Clusters of a network for a corpus of so many distinct words."""
    whole = CLUSTERS
    while whole < WHOLE and whole * (whole - RARE) < words:
        whole += 1
    return max(whole, math.ceil(2 * words**0.25))


def new_network(vocabulary: list[tuple[int, int]], total: int, seed: int = 0, clusters: int = CLUSTERS) -> Network:
    """Small random embeddings; biases of the frequent words' logarithmic shares. ``vocabulary``: (hash, count) by rank."""
    n = clusters * clusters
    hashes = np.array([h for h, _ in vocabulary], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    net = Network(hashes[order], order.astype(np.int64), SIDE, WIDTH, clusters, np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    net.weights = rng.normal(0, 0.1, sum(int(np.prod(s)) for s in net.shapes.values())).astype(np.float32)
    view = net.views(net.weights)
    share = np.full(n, 1e-6)
    counts = [c for _, c in vocabulary]
    share[: len(counts)] += np.array(counts, float) / max(total, 1)
    share[n - net.buckets :] += max(total - sum(counts), 0) / max(total, 1) / net.buckets
    share = (share / share.sum()).reshape(clusters, clusters)
    view["cluster_bias"][:] = np.log(share.sum(1))
    view["word_bias"][:] = np.log(share / share.sum(1, keepdims=True))
    return net


def contexts(ids: np.ndarray, doc: np.ndarray, side: int, pad: int) -> np.ndarray:
    """Ids of the ``side`` words before and after each word within its document, else ``pad``."""
    out = np.full((len(ids), 2 * side), pad, np.int64)
    for k in range(1, side + 1):
        same = doc[k:] == doc[:-k]
        out[k:, side - k][same] = ids[:-k][same]
        out[:-k, side + k - 1][same] = ids[k:][same]
    return out


def _order(values: np.ndarray) -> np.ndarray:
    """A stable order of numbers below 2 ** 32, sorted by digits of 16 bits in linear time."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    if values.max(initial=0) < 1 << 16:
        return order
    return order.take(np.argsort((values >> 16).astype(np.uint16).take(order), kind="stable"))


def _by_place(around: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of the embeddings for each place, of words in ``order``."""
    places = around.shape[1]
    return np.ascontiguousarray(around.T).take(order, axis=1) * places + np.arange(places)[:, None]


def _hidden(view: dict, by_place: np.ndarray) -> np.ndarray:
    total = view["rows"].take(by_place[0], axis=0)
    for rows in by_place[1:]:
        total += view["rows"].take(rows, axis=0)
    total += view["hidden"]
    return np.tanh(total, out=total)


def _steep(view: dict, name: str) -> bool:
    """Whether exponentials might overflow: no logit is beyond its bias and the sum of its weights, as a hidden value is at most 1."""
    weights = np.abs(view[name])
    return float((weights @ np.ones(weights.shape[-1], weights.dtype) + np.abs(view[name + "_bias"])).max()) > STEEP


def _with_bias(view: dict, name: str) -> np.ndarray:
    """The bias as one more weight, of a hidden value 1."""
    return np.concatenate([view[name], view[name + "_bias"][..., None]], axis=-1)


def log_probabilities(net: Network, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each word given the words around it.

    Equal words between equal neighbours are to have equal probabilities, but a product of matrices rounds rows by their
    number and place.  So factors are multiples of 1 / EXACT, and their products and sums are whole in double precision.
    """
    view, kind = net.views(net.weights), net.weights.dtype
    steep = _steep(view, "cluster"), _steep(view, "word")
    whole = (lambda x: np.rint(x * kind.type(EXACT)) / kind.type(EXACT)) if kind == np.float32 else (lambda x: x)
    by_cluster, by_word = (whole(_with_bias(view, name)).astype(float) for name in ("cluster", "word"))
    out = np.zeros(len(ids))
    size = min(ROWS, len(ids))
    hidden, space = np.ones((size, net.width + 1)), np.empty((size, net.clusters))
    line = np.arange(size) * net.clusters
    order = _order(ids)
    cluster, word = np.divmod(ids[order], net.clusters)
    by_place = _by_place(around, order)
    cuts = np.searchsorted(cluster, np.arange(net.clusters + 1)).tolist()
    for lo in range(0, len(ids), ROWS):
        hi = min(lo + ROWS, len(ids))
        h, x = hidden[: hi - lo], space[: hi - lo]
        h[:, :-1] = whole(_hidden(view, by_place[:, lo:hi]))
        made = np.zeros(hi - lo)
        for k, target in enumerate((cluster[lo:hi], word[lo:hi])):
            if k:
                for c in range(cluster[lo], cluster[hi - 1] + 1):
                    own = slice(max(cuts[c] - lo, 0), min(cuts[c + 1], hi) - lo)
                    if own.start < own.stop:
                        np.matmul(h[own], by_word[c].T, out=x[own])
            else:
                np.matmul(h, by_cluster.T, out=x)
            logits = x.astype(kind)
            if steep[k]:
                logits -= logits.max(1, keepdims=True)
            made += logits.reshape(-1).take(line[: hi - lo] + target)
            made -= np.log(np.exp(logits, out=logits).sum(1))
        out[order[lo:hi]] = made
    return out


def _sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, in order, and the sums of their rows, which go round; two columns are added at once as parts of complex numbers."""
    turn = _order(keys)
    keys = keys.take(turn)
    turn %= len(rows)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    pairs = rows.view(np.result_type(rows.dtype, np.complex64)).take(turn, axis=0)
    return keys.take(first), np.add.reduceat(pairs, first, axis=0).view(rows.dtype)


def train_step(net: Network, memory: np.ndarray, ids: np.ndarray, around: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on the mean log-probability of a batch."""
    view, seen = net.views(net.weights), net.views(memory)
    order = _order(ids)
    by_place = _by_place(around, order)
    cluster, word = np.divmod(ids[order], net.clusters)
    kind = net.weights.dtype
    steep = _steep(view, "cluster"), _steep(view, "word")
    cuts = np.searchsorted(cluster, np.arange(net.clusters + 1)).tolist()
    met = [c for c in range(net.clusters) if cuts[c] < cuts[c + 1]]
    size = min(ROWS, len(ids))
    weights, with_one = _with_bias(view, "word"), np.ones((size, net.width + 1), kind)
    one, line = np.ones(net.clusters, kind), np.arange(size) * net.clusters
    space, passed, back = np.empty((2, size, net.clusters), kind), np.empty((size, net.width), kind), np.empty((len(ids), net.width), kind)
    slope = {name: np.zeros_like(view[name]) for name in ("hidden", "cluster", "cluster_bias")}
    slopes = np.zeros_like(weights)
    at = 0
    for lo in range(0, len(ids), ROWS):
        hi = min(lo + ROWS, len(ids))
        hidden = _hidden(view, by_place[:, lo:hi])
        while cuts[met[at] + 1] <= lo:
            at += 1
        spans = []
        for c in met[at:]:
            if cuts[c] >= hi:
                break
            spans.append((c, slice(max(cuts[c], lo) - lo, min(cuts[c + 1], hi) - lo)))
        a, b = space[:, : hi - lo]
        np.matmul(hidden, view["cluster"].T, out=a)
        a += view["cluster_bias"]
        whole = with_one[: hi - lo]
        whole[:, :-1] = hidden
        for c, own in spans:
            np.matmul(whole[own], weights[c].T, out=b[own])
        over = []
        for x, target, large in ((a, cluster, steep[0]), (b, word, steep[1])):
            if large:
                x -= x.max(1, keepdims=True)
            total = np.exp(x, out=x) @ one
            # The slopes of the logits times the row's sum and the batch's words; the products' other factors are divided by them.
            flat, own = x.reshape(-1), line[: hi - lo] + target[lo:hi]
            flat[own] = flat.take(own) - total
            total *= kind.type(len(ids))
            over.append(1 / total)
        scaled = hidden * over[0][:, None]
        slope["cluster"] += a.T @ scaled
        slope["cluster_bias"] += over[0] @ a
        scaled, through = whole * over[1][:, None], passed[: hi - lo]
        for c, own in spans:
            slopes[c] += b[own].T @ scaled[own]
            np.matmul(b[own], view["word"][c], out=through[own])
        through *= over[1][:, None]
        both = np.matmul(a, view["cluster"], out=back[lo:hi])
        both *= over[0][:, None]
        both += through
        hidden *= hidden
        both *= np.subtract(1, hidden, out=hidden)
        slope["hidden"] += np.ones(hi - lo, kind) @ both

    def step(name: str, at, slope: np.ndarray) -> None:
        """Only parameters that the batch touches have a slope."""
        values, squares = view[name], seen[name]
        sums = slope * slope
        sums += squares.take(at, axis=0) if at is not ... else squares
        squares[at] = sums
        np.sqrt(sums, out=sums)
        np.divide(slope, sums, out=sums)
        sums *= kind.type(rate)
        values[at] -= sums

    for name, own in (("word", np.ascontiguousarray(slopes[..., :-1])), ("word_bias", slopes[..., -1])):
        step(name, *((..., own) if len(met) == net.clusters else (met, own[met])))
    for name in ("cluster", "cluster_bias", "hidden"):
        step(name, ..., slope[name])
    step("rows", *_sums(back, by_place.reshape(-1)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    held, size = [], 0
    for batch in batches:
        for words in W.segments(batch.column(0), lower=True):
            held.append(words.hashes)
            size += len(words.hashes)
            if size > COUNTED:
                yield counted(held)
                held, size = [], 0
    if size:
        yield counted(held)


_LEARNT = "slice int, part int, seen bigint, total binary"


def _learn(net: Network):
    """The partition's model, in slices, from one pass over the words."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(net.vocabulary, net.ids, net.side, net.width, net.clusters, net.weights.copy())
        memory, seen = np.full(len(own.weights), 1e-6, np.float32), 0
        for batch in batches:
            for words in W.segments(batch.column(0), lower=True):
                ids = own.encode(words.hashes)
                around = contexts(ids, words.documents(), own.side, own.clusters * own.clusters)
                step = STEP_WORDS * own.clusters
                for lo in range(0, len(ids), step):
                    train_step(own, memory, ids[lo : lo + step], around[lo : lo + step])
                seen += len(ids)
        if seen:
            parts = np.split(own.weights * np.float64(seen), range(SLICE, len(own.weights), SLICE))
            n, part = len(parts), TaskContext.get().partitionId() // FAN_IN
            columns = np.arange(n, dtype=np.int32), np.full(n, part, np.int32), np.full(n, seen, np.int64), [x.tobytes() for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slice", "part", "seen", "total"])

    return per_partition


def _add(group: pa.Table) -> pa.RecordBatch:
    total = sum(np.frombuffer(x, np.float64) for x in group["total"].to_pylist())
    part = group["part"][0].as_py() // FAN_IN
    return pa.RecordBatch.from_arrays(
        [group["slice"].combine_chunks()[:1], pa.array([part], pa.int32()), pa.array([sum(group["seen"].to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())],
        ["slice", "part", "seen", "total"],
    )


class Contexts:
    """Contexts that a corpus has at least ``least`` times; their tables are made when other texts are first scored."""

    def __init__(self, texts: DataFrame, least: int):
        self.texts, self.least = texts, least
        self.made: tuple[DataFrame, DataFrame] | None = None

    def tables(self, net: Network) -> tuple[DataFrame, DataFrame]:
        """(around, n) of the contexts, and (whole, n) of those with a word between."""
        if self.made is None:
            met = materialize(self.texts.mapInArrow(_met(_bare(net)), "around bigint, whole bigint"), "contexts-met")
            often = lambda key: met.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= self.least)
            self.made = materialize(often("around"), "contexts"), materialize(often("whole"), "contexts-with-words")
            drop(met)
        return self.made


def _met(net: Network):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in W.segments(batch.column(0), lower=True):
                _, around, whole = _beyond(net, words, net.encode(words.hashes))
                yield pa.RecordBatch.from_arrays([pa.array(around.view(np.int64)), pa.array(whole.view(np.int64))], ["around", "whole"])

    return per_batch


def train(docs: DataFrame, for_others: bool = False) -> Network:
    """A network from all of ``docs``: every partition passes over all its words once, and models are averaged.

    A network that is to score other texts also keeps contexts met once (``for_others``); they say nothing about
    ``docs`` itself, where the scored occurrence doesn't count.  How rows lie in partitions moves the weights a little, as models are averaged once.

    Words are counted over the corpus first; the frequent ones get an id each.  Partitions start from
    the same network; their parameters, weighted by words, are summed in slices, FAN_IN at a time.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = materialize(texts.mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    size = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("words")).first()
    clusters = clusters_for(size["words"])
    top = counted.orderBy(F.desc("n"), "word").limit(clusters * (clusters - RARE)).collect()
    net = new_network([(r["word"], r["n"]) for r in top], size["total"], clusters=clusters)
    sums = materialize(texts.mapInArrow(_learn(net), _LEARNT), "models")
    while (sums.agg(F.max("part")).first()[0] or 0) > 0:
        sums = materialize(blocks.map_groups(sums, ["slice", "part"], _add, _LEARNT), "models")
    rows = blocks.map_groups(sums, ["slice", "part"], _add, _LEARNT).orderBy("slice").collect()  # one row a slice
    if rows:
        net.weights = np.concatenate([np.frombuffer(r["total"], np.float64) / r["seen"] for r in rows]).astype(np.float32)
    net.counted, net.totals = counted, np.zeros(net.buckets)
    buckets = counted.mapInArrow(_bucket_totals(_bare(net)), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in buckets.collect():  # one row a bucket
        net.totals[r["bucket"]] = r["n"]
    net.remembered = Contexts(texts, 1 if for_others else 2)
    return net


def _bare(net: Network) -> Network:
    """The network without its table, for executors."""
    return replace(net, counted=None, remembered=None)


def _beyond(net: Network, words: W.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash of the neighbours, hash of them and the word) where neither neighbour has an id of its own."""
    own, doc = net.clusters**2 - net.buckets, words.documents()
    rare = ids >= own
    at = np.flatnonzero(rare[:-2] & rare[2:] & (doc[:-2] == doc[2:])) + 1 if len(ids) > 2 else np.zeros(0, np.int64)
    around = W.mix(W.mix(words.hashes[at - 1]) + words.hashes[at + 1])
    return at, around, W.mix(around ^ W.mix(words.hashes[at]))


def _bucket_totals(net: Network):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = net.encode(batch.column(0).to_numpy().view(np.uint64)) - (net.clusters**2 - net.buckets)
            n = np.bincount(bucket[bucket >= 0], batch.column(1).to_numpy()[bucket >= 0], net.buckets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(net.buckets, dtype=np.int32)), pa.array(n)], ["bucket", "n"])

    return per_batch


def _met_often(asked: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
    """How often each context is met, and met with its word, of contexts that are met twice or more.

    Its neighbours have no id: of all words at most one in as many as there are ids is such a neighbour, so groups are small.
    """
    sizes = np.diff(begins, append=asked.num_rows)
    n = np.repeat(sizes, sizes)
    often = np.flatnonzero(n > 1)
    kept = asked.select(["row", "each", "rest"]).take(pa.array(often)).combine_chunks()
    _, at, m = np.unique(asked["whole"].to_numpy()[often], return_inverse=True, return_counts=True)
    columns = [kept["row"], n[often], m[at], kept["each"], kept["rest"]]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c.combine_chunks() for c in columns], ["row", "n", "m", "each", "rest"])


def _score(net: Network, known: np.ndarray, counts: np.ndarray, join: bool):
    """Scores by row, and words whose counts are not among the ``known``: their counts enter as 1 until they are joined."""
    n_own = net.clusters**2 - net.buckets

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, logs = Places(known), np.log(counts)
        for batch in batches:
            for words in W.segments(batch.column(1), lower=True):
                n = len(words.counts)
                ids, doc = net.encode(words.hashes), words.documents()
                each = log_probabilities(net, ids, contexts(ids, doc, net.side, net.clusters * net.clusters))
                rare = np.flatnonzero(ids >= n_own) if net.totals is not None else np.zeros(0, np.int64)
                # One count more in each bucket is for words that the corpus doesn't have.
                each[rare] -= np.log(net.totals[ids[rare] - n_own] + 1) if len(rare) else 0
                at = places.find(words.hashes[rare])
                found = at >= 0
                each[rare[found]] += logs[at[found]]
                total = np.bincount(doc, each, n).astype(float)
                count = words.counts
                rest = rare[~found] if join else rare[:0]
                at, around, whole = _beyond(net, words, ids) if net.totals is not None else [np.zeros(0, np.int64)] * 3
                to_join = np.zeros(len(ids), np.int64)
                to_join[rest] = words.hashes[rest].view(np.int64)

                def lists(places, values, n=n, doc=doc):
                    offsets = pa.array(np.searchsorted(doc[places], np.arange(n + 1)).astype(np.int32))
                    return pa.ListArray.from_arrays(offsets, values)

                joined = lists(rest, pa.array(words.hashes[rest].view(np.int64)))
                parts = around.view(np.int64), whole.view(np.int64), each[at].astype(np.float32), to_join[at]
                context = lists(at, pa.StructArray.from_arrays([pa.array(x) for x in parts], ["around", "whole", "each", "rest"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.lo, n), pa.array(count.astype(np.int64)), pa.array(total), joined, context],
                    ["doc_id", "n_words", "log_likelihood", "words", "contexts"],
                )

    return per_batch


def score_documents(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row's whole text.

    Words are runs of bytes other than white space, A-Z lower-cased.  A null or empty text has no
    words, log_likelihood 0 and a null mean.  ``net`` None trains on ``docs`` first.  A word without an
    id has the probability of its bucket times its count over the bucket's, of which one is for all
    words that the training corpus doesn't have.  Between two neighbours without ids that the corpus has
    n times, with the word between them m times, p becomes (m + PRIOR p) / (n + PRIOR); where the
    corpus is ``docs`` itself, the occurrence that is scored doesn't count.  Repeated rows and null ids are
    scored row by row.  An empty table gives no rows; other columns are ignored.
    """
    itself = 0 if net else 1
    net = net or train(docs)
    kind = dict(docs.dtypes)["doc_id"]
    known, counts, beyond = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    if net.counted is not None:
        # A count of 1 is that of an unseen word, so nothing needs to be looked up for it.
        often = net.counted.where("n > 1")
        limit = len(net.vocabulary) + KNOWN
        top = often.orderBy(F.desc("n"), "word").limit(limit).toArrow()
        known, counts = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
        by_hash = np.argsort(known)
        known, counts = known[by_hash], counts[by_hash]
        beyond = often if often.count() > limit else None
    lists = "words array<bigint>, contexts array<struct<around: bigint, whole: bigint, each: float, rest: bigint>>"
    scores = docs.select("doc_id", "text").mapInArrow(
        _score(_bare(net), known, counts, beyond is not None), f"doc_id {kind}, n_words bigint, log_likelihood double, {lists}"
    )
    if net.totals is not None:
        scores = materialize(scores.withColumn("row", F.monotonically_increasing_id()), "scores")
        more = []
        if beyond is not None:
            more.append(scores.select("row", F.explode("words").alias("word")).join(beyond, "word").select("row", F.log("n").alias("more")))
        if net.remembered:
            asked = scores.select("row", F.inline("contexts"))
            if itself:  # the texts' own contexts are all there are; one that is met once tells nothing
                asked = blocks.map_runs(asked, ["around"], _met_often, "row bigint, n bigint, m bigint, each float, rest bigint")
            else:
                met, with_word = net.remembered.tables(net)
                asked = asked.join(met, "around").join(with_word.select("whole", F.col("n").alias("m")), "whole", "left")
            if beyond is not None:  # what the word's count adds to its probability
                asked = asked.join(beyond.select(F.col("word").alias("rest"), F.log("n").alias("add")), "rest", "left").withColumn("each", F.col("each") + F.coalesce("add", F.lit(0.0)))
            n, m = F.col("n") - itself, F.greatest(F.coalesce("m", F.lit(0)) - itself, F.lit(0))
            mixed = F.log((m + PRIOR * F.exp(F.col("each").cast("double"))) / (n + PRIOR)) - F.col("each")
            more.append(asked.select("row", mixed.alias("more")))
        if more:
            sums = reduce(DataFrame.unionByName, more).groupBy("row").agg((F.sum(F.round(F.col("more") * FINE).cast("long")) / FINE).alias("more"))
            scores = scores.join(sums, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scores.select("doc_id", "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))
