"""Embedding near-dedup: codes by iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlake.llm import blocks
from sectorlake.llm import words as W
from sectorlake.llm.components import connected_components
from sectorlake.llm.tables import materialize

THRESHOLD = 0.95
#: Bits of a code, in two 64-bit numbers.  Vectors of fewer components have bits from several rotations.
BITS = 128
#: The rotation is learned from about this many numbers, on vectors picked by hash; all vectors are indexed.
SAMPLE_NUMBERS = 1_000_000
ITERATIONS = 30
#: Pairs at exactly the threshold, made from sampled vectors, on which tables and radius are measured.
TRIALS = 2000
#: Share of such pairs that may meet in no table, and that may lie outside the radius.
MISSED = 0.01
#: A table's key has as many bits as the logarithm of the number of vectors, so that most unlike ones have a bucket to themselves.
LEAST_KEY, MOST_KEY = 6, 40
#: So many tables are tried with one key width; where they don't find enough, keys become a bit narrower, with fuller buckets.
MOST_TABLES = 256
#: Rows of a chunk of codes and vectors; see ``blocks.deal_blocks``.
SMALL, LARGE = 256, 2048
LAST = (1 << 63) - 1


def learn_rotation(sample: np.ndarray, bits: int, iterations: int = ITERATIONS, seed: int = 0, centre: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned so that signs lose least (Gong and Lazebnik, 2011); mean 0 unless ``centre``."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    mean = sample.mean(0) if centre and len(sample) else np.zeros(d)
    centred = sample - mean
    if len(sample) > 1:
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    else:
        axes = np.linalg.qr(rng.normal(size=(d, d)))[0]
    axes = axes[:, :bits]
    turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
    low = centred @ axes
    for _ in range(iterations if len(sample) > 1 else 0):
        signs = np.where(low @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ low)
        turn = (u @ v).T
    return mean, axes @ turn


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the lists of each length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[begins[at][:, None] + np.arange(d)]


@dataclass(frozen=True)
class Index:
    """How vectors of one length are coded and dealt to tables."""

    mean: np.ndarray
    projection: np.ndarray  #: components x BITS
    tables: np.ndarray  #: tables x 2: masks of the code's bits that are a table's key
    radius: int  #: differing bits of a pair that is worth measuring

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes, two 64-bit numbers each."""
        bits = (_unit(vectors) - self.mean) @ self.projection >= 0
        powers = np.arange(64, dtype=np.uint64)
        return np.stack([(bits[:, lo : lo + 64].astype(np.uint64) << powers).sum(1, dtype=np.uint64) for lo in (0, 64)], 1)


def _pairs_at(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at exactly the threshold: sampled ones, each turned in a random direction."""
    own = sample[rng.integers(0, len(sample), TRIALS)]
    away = rng.normal(size=own.shape)
    away -= (away * own).sum(1, keepdims=True) * own
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    return own, threshold * own + np.sqrt(1 - threshold**2) * away


def _index_of(sample: np.ndarray, trials: np.ndarray, width: int, threshold: float, seed: int, centre: bool) -> tuple[Index, float, float]:
    """(index, share of trial pairs missed, share of unlike pairs that a table's key lets meet)."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed + d)
    parts, have = [], 0
    while have < BITS:
        mean, own = learn_rotation(sample, min(BITS - have, d), seed=seed + len(parts), centre=centre)
        parts.append(own)
        have += own.shape[1]
    plain = Index(mean, np.concatenate(parts, 1)[:, :BITS], np.zeros((0, 2), np.uint64), BITS)
    one, other = _pairs_at(trials, threshold, rng)
    differ = plain.encode(one) ^ plain.encode(other)
    radius = int(np.quantile(np.bitwise_count(differ).sum(1), 1 - MISSED / 10))
    codes = plain.encode(trials)
    unlike = codes ^ np.roll(codes, 1, 0)
    tables, open_, chance = [], np.ones(TRIALS, bool), 0.0
    while len(tables) < MOST_TABLES and open_.mean() > MISSED:
        chosen = rng.choice(BITS, width, replace=False)
        mask = np.array([sum(1 << int(b) for b in chosen if b < 64), sum(1 << int(b - 64) for b in chosen if b >= 64)], np.uint64)
        tables.append(mask)
        open_ &= ((differ & mask) != 0).any(1)
        chance += ((unlike & mask) == 0).all(1).mean()
    return Index(mean, plain.projection, np.array(tables), radius), float(open_.mean()), chance / len(tables)


def build_index(sample: np.ndarray, vectors: int, threshold: float = THRESHOLD, seed: int = 0) -> Index:
    """An index for about ``vectors`` vectors like those of ``sample`` (unit vectors, one length).

    Rotations are learned until there are BITS bits.  Keys are random choices of bits, as wide as the
    number of vectors asks for, and tables are added until all but MISSED of trial pairs at the
    threshold share a key; where MOST_TABLES don't reach that, keys are narrower, and an error tells where
    even the narrowest ones don't.  Signs are taken about the sample's mean, which balances codes, or about
    zero, which keeps the angle that the threshold is about: the cheaper one that finds the trial pairs.
    """
    d = sample.shape[1]
    if d == 1:  # all directions there are
        return Index(np.zeros(1), np.ones((1, BITS)), np.zeros((1, 2), np.uint64), BITS)
    width = int(np.clip(np.ceil(np.log2(max(vectors, 1))), LEAST_KEY, MOST_KEY))
    few = len(sample) < 40
    # Trials are made of vectors that the rotations have not seen, where there are enough.
    trials, own = (sample, sample) if few else (sample[::4], sample[np.arange(len(sample)) % 4 > 0])
    for narrower in range(width, LEAST_KEY - 1, -1):
        made = [_index_of(own, trials, narrower, threshold, seed, centre) for centre in ((False,) if few else (True, False))]
        index, missed, _ = min(made, key=lambda m: (m[1] > MISSED, len(m[0].tables) * (1 + vectors * m[2])))
        if missed <= MISSED:
            return index
    raise ValueError(f"{missed:.1%} of pairs at the threshold share no key of {LEAST_KEY} bits in {MOST_TABLES} tables; code more bits or raise the threshold")


def _tables(indexes: dict[int, Index]):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, vectors in _by_length(batch.column(1)):
                d = vectors.shape[1]
                index = indexes[d]
                codes, n = index.encode(vectors), len(index.tables)
                masked = codes[:, None, :] & index.tables[None, :, :]
                label = (np.uint64(d) << np.uint64(16)) + np.arange(n, dtype=np.uint64)
                keys = W.mix(W.mix(masked[:, :, 0] ^ W.mix(label)[None, :]) ^ masked[:, :, 1])
                node = batch.column(0).to_numpy()[at]
                yield blocks.batch_of(
                    bucket=keys.reshape(-1).view(np.int64), band=np.tile(np.arange(n, dtype=np.int32), len(at)), node=np.repeat(node, n),
                    length=np.full(n * len(at), d, np.int32), c0=np.repeat(codes[:, 0].view(np.int64), n), c1=np.repeat(codes[:, 1].view(np.int64), n),
                )

    return per_batch


def _close(group: pa.Table, begins: np.ndarray, indexes: dict[int, Index]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in these blocks whose codes lie within the radius, each in the lowest table that it shares only."""
    codes = np.stack([group[c].to_numpy().view(np.uint64) for c in ("c0", "c1")], 1)
    length, band = group["length"].to_numpy(), group["band"].to_numpy()
    radius = np.zeros(len(codes), np.int64)
    for d in np.unique(length).tolist():
        radius[length == d] = indexes[d].radius
    for i, j in blocks.meeting(group, begins):
        near = np.bitwise_count(codes[i] ^ codes[j]).sum(1) <= radius[i]
        i, j = i[near], j[near]
        lowest = np.ones(len(i), bool)
        for d in np.unique(length[i]).tolist():
            own = np.flatnonzero(length[i] == d)
            for t, mask in enumerate(indexes[d].tables[: int(band[i[own]].max())]):
                own = own[t < band[i[own]]]
                lowest[own[((codes[i[own]] ^ codes[j[own]]) & mask == 0).all(1)]] = False
                own = own[lowest[own]]
        if lowest.any():
            yield i[lowest], j[lowest]


def _flag(indexes: dict[int, Index]):
    """The rows of blocks that have a close pair."""

    def per_run(group: pa.Table, begins: np.ndarray) -> pa.RecordBatch | None:
        met = np.zeros(group.num_rows, bool)
        for i, j in _close(group, begins, indexes):
            met[i] = met[j] = True
        kept = group.filter(pa.array(met)).select(["bucket", "lo", "hi", "chunk", "band", "node", "length", "c0", "c1"]).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else None

    return per_run


def _links(indexes: dict[int, Index], threshold: float):
    """Exact cosines of close pairs: (0, node, links) of each row and (1, a, b) of a spanning forest of the links."""

    def per_run(group: pa.Table, begins: np.ndarray) -> pa.RecordBatch | None:
        nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        units: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place = np.zeros(len(nodes), np.int64)
        for at, vectors in _by_length(group["vector"]):
            units[vectors.shape[1]] = _unit(vectors)
            place[at] = np.arange(len(at))
        length = group["length"].to_numpy()
        count, forest, edges = np.zeros(len(nodes), np.int64), blocks.Forest(len(nodes)), []
        for i, j in _close(group, begins, indexes):
            linked = np.zeros(len(i), bool)
            for d in np.unique(length[i]).tolist():
                own = np.flatnonzero(length[i] == d)
                unit = units[d]
                linked[own] = np.einsum("ij,ij->i", unit[place[i[own]]], unit[place[j[own]]]) >= threshold
            i, j = i[linked], j[linked]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            edges += [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
        at = np.array(edges, np.int64).reshape(-1, 2)
        some = np.flatnonzero(count)
        return blocks.batch_of(
            kind=np.repeat([0, 1], [len(some), len(at)]).astype(np.int32), a=np.concatenate([nodes[some], nodes[at[:, 0]]]), b=np.concatenate([count[some], nodes[at[:, 1]]])
        )

    return per_run


def embedding_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``embeddings``: (vec_id, n_links, component_id, kept).

    Vectors of cosine ``threshold`` or more, in double precision, are linked; a link is only ever
    between vectors of one length.  Null, empty and zero vectors and those with a null, NaN or infinite
    component link with nothing.  ``n_links`` counts other rows, ``component_id`` is the smallest
    vec_id reachable, ``kept`` marks its row.  Equal vectors are one class and need no pairs.  Rows
    that share a vec_id, or have none, are linked only if their vectors are.  Null vec_ids come last and have a null component_id unless linked to others; an empty table gives no rows;
    other columns are ignored.

    Codes of all classes are dealt to tables by chosen bits, as many and as wide as the number of vectors
    and trial pairs at the threshold ask for (``build_index``).  Buckets are compared in blocks of codes;
    vectors travel only to blocks in which they are close to another, where each pair, in the lowest
    table that it shares, is measured and counted once.  No pair list is written and no group gathered.
    """
    keyed = embeddings.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("key"), "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    keyed = keyed.withColumns({
        "ok": F.coalesce(sound, F.lit(False)), "h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), F.col("vector"))
    })
    # A class is a node of its own, whatever vec_ids its rows have.
    classes = keyed.where("ok").groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a length
    share = min(1.0, SAMPLE_NUMBERS / max(sum(d * n for d, n in sizes.items()), 1))
    picked = classes.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").toArrow()
    samples = {v.shape[1]: _unit(v) for _, v in _by_length(picked["vector"])} if picked.num_rows else {}
    indexes = {d: build_index(samples[d] if d in samples else np.eye(1, d), n, threshold) for d, n in sizes.items()}

    coded = classes.select("node", "vector").mapInArrow(_tables(indexes), "bucket bigint, band int, node bigint, length int, c0 bigint, c1 bigint")
    met = materialize(blocks.shared_buckets(coded), "shared-tables")
    key = ["bucket", "lo", "hi"]
    dealt = blocks.deal_blocks(met, "bucket", small=SMALL, large=LARGE)
    flagged = materialize(
        blocks.map_runs(dealt, key, _flag(indexes), "bucket bigint, lo int, hi int, chunk int, band int, node bigint, length int, c0 bigint, c1 bigint"), "close-codes"
    )
    vectors = flagged.join(classes.select("node", "copies", "vector"), "node")
    found = materialize(blocks.map_runs(vectors, key, _links(indexes, threshold), "kind int, a bigint, b bigint"), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = connected_components(found.where("kind = 1"), "a", "b")

    by_class = classes.select("h1", "h2", "node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left")
    by_class = by_class.withColumn("component", F.coalesce("component", "node"))
    by_class = by_class.drop("first").join(by_class.groupBy("component").agg(F.min("first").alias("first")), "component")
    rows = keyed.select("vec_id", "key", "ok", "h1", "h2").join(by_class.withColumn("ok", F.lit(True)), ["h1", "h2", "ok"], "left")
    component = F.coalesce("first", "key")
    return rows.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.when(component < LAST, component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
