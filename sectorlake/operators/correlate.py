"""Where one signal lies in another: correlation over all lags in blocks, by the Fourier transform.

A needle is cut into blocks and a hay into segments of two blocks each, which overlap by one.  The
correlation at the lags of one output block is a sum over needle blocks of products of spectra (uniformly
partitioned overlap-save), so signals of any length are met in pieces: a task holds two blocks and one sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sectorlake.functions.units import div
from sectorlake.sources.shared import written

#: Samples of a block; a power of two.
BLOCK = 4096
#: Scores are compared at so many decimals, so that sums in another order find the same place.
DIGITS = 6
#: Ranges of scales that one envelope is stretched in, and the longest block of lags there.
PARTS, LONGEST = 10, 1 << 17


def _lists(rows: DataFrame, keys: list[str], block: str, size: int, doubled: bool) -> DataFrame:
    """(keys, block, at, x): samples of each block as lists of offsets and values; ``doubled``: of it and the next one."""
    at, x = (F.col("pos") % size).cast("int"), F.coalesce(F.col("x").cast("double"), F.lit(0.0))
    own = F.struct(div(F.col("pos"), size).alias("b"), at.alias("at"))
    if doubled:
        before = F.struct((div(F.col("pos"), size) - 1).alias("b"), (at + size).alias("at"))
        rows = rows.select(*keys, x.alias("x"), F.explode(F.array(own, before)).alias("o")).where("o.b >= 0")
    else:
        rows = rows.select(*keys, x.alias("x"), own.alias("o"))
    return rows.groupBy(*keys, F.col("o.b").alias(block)).agg(F.collect_list(F.struct("o.at", "x")).alias("_s"))


def _dense(lists: pa.Array, size: int) -> Iterator[np.ndarray]:
    ends, flat = lists.offsets.to_numpy(), lists.flatten()
    base, at, x = int(ends[0]), flat.field(0).to_numpy(), flat.field(1).to_numpy()
    for lo, hi in zip(ends[:-1] - base, ends[1:] - base, strict=True):
        out = np.zeros(size)
        out[at[lo:hi]] = x[lo:hi]
        yield out


def _mapped(df: DataFrame, column: str, made: dict[str, str], each, keep: list[str]) -> DataFrame:
    """Replace a list column by binary ones that ``each`` makes of a row."""
    place = df.columns.index(column)
    others = [k for k, c in enumerate(df.columns) if c in keep]
    names = [*(df.columns[k] for k in others), *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = each(batch, place)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), *(pa.array(c, pa.binary()) for c in found)], names)

    return df.mapInArrow(run, StructType([*(df.schema[k] for k in others), *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in made.items()))]))


def correlate(hays: DataFrame, needles: DataFrame, on: list[str], extra: list[str] | None = None, size: int = BLOCK, by_energy: bool = True) -> DataFrame:
    """(on, extra, lag, score): the place of each needle in the hay of the same ``on`` where they go together best.

    Both have ``pos`` (0, 1, ... without gaps) and ``x`` (null counts as 0); needles are told apart by ``on`` and
    ``extra``.  A needle's mean is taken off.  With ``by_energy`` a score is normalized by the energies of needle
    and of the hay under it (G2); without, by the needle's length.  Ties: the first place.  Needles that
    are longer than their hay have no row.
    """
    extra = extra or []
    keys = [*on, *extra]
    sizes = hays.groupBy(*on).agg((F.max("pos") + 1).alias("_n"))
    x = F.coalesce(F.col("x").cast("double"), F.lit(0.0))
    stats = needles.groupBy(*keys).agg((F.max("pos") + 1).alias("_m"), F.avg(x).alias("_mean"), (F.var_pop(x) * F.count("*")).alias("_power"))
    stats = stats.join(sizes, on).where("_m <= _n")

    def hay_spectra(batch: pa.RecordBatch, place: int):
        spectra, energies = [], []
        for s in _dense(batch.column(place), 2 * size):
            spectra.append(np.fft.rfft(s).tobytes())
            energies.append(np.concatenate([[0.0], np.cumsum(s * s)]).tobytes())
        return spectra, energies

    segments = _mapped(_lists(hays, on, "_seg", size, doubled=True), "_s", {"_hay": "binary", "_energy": "binary"}, hay_spectra, [*on, "_seg"])
    pieces = _lists(needles, keys, "_p", size, doubled=False).join(stats, keys)
    where = {c: pieces.columns.index(c) for c in ("_p", "_m", "_mean")}

    def needle_spectra(batch: pa.RecordBatch, place: int):
        p, m, mean = (batch.column(where[c]).to_numpy() for c in ("_p", "_m", "_mean"))
        spectra = []
        for k, s in enumerate(_dense(batch.column(place), 2 * size)):
            s[: min(size, m[k] - p[k] * size)] -= mean[k]
            spectra.append(np.conj(np.fft.rfft(s)).tobytes())
        return (spectra,)

    pieces = _mapped(pieces, "_s", {"_needle": "binary"}, needle_spectra, [*keys, "_p", "_m", "_power", "_n"])
    asked = pieces.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("_n") - F.col("_m"), size)))).withColumn("_seg", F.col("_o") + F.col("_p"))
    met = asked.join(segments, [*on, "_seg"]).select(*keys, "_o", "_p", "_m", "_n", "_power", "_needle", "_hay", "_energy")
    met = met.repartition(*keys, "_o").sortWithinPartitions(*keys, "_o", "_p")
    n_keys = len(keys)

    def best(key: list[pa.Array], o: int, m: int, n: int, power: float, product: np.ndarray, energy: np.ndarray) -> pa.RecordBatch:
        valid = min(size, n - m - o * size + 1)
        c = np.fft.irfft(product, 2 * size)[:valid]
        score = np.round(c / np.sqrt(np.maximum(energy[:valid], 1e-9) * power + 1e-9) if by_energy else c / m, DIGITS) + 0.0
        at = int(np.argmax(score))
        return pa.RecordBatch.from_arrays([*key, pa.array([o * size + at]), pa.array([float(score[at])])], [*keys, "lag", "score"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, product, energy = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for c in batch.columns[: n_keys + 1]:
                change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            first = tuple(c[0].as_py() for c in batch.columns[: n_keys + 1])
            change[0] = held is None or first != held[0]
            o, p, m, n, power = (batch.column(n_keys + k).to_numpy() for k in range(5))
            needle, hay, squares = (batch.column(n_keys + 5 + k) for k in range(3))
            for k in range(batch.num_rows):
                if change[k]:
                    if held is not None:
                        yield best(*held[1:], product, energy)
                    key = [c.slice(k, 1) for c in batch.columns[:n_keys]]
                    held = (tuple(c[k].as_py() for c in batch.columns[: n_keys + 1]), key, int(o[k]), int(m[k]), int(n[k]), float(power[k]))
                    product, energy = np.zeros(size + 1, complex), np.zeros(size)
                product += np.frombuffer(needle[k].as_buffer(), complex) * np.frombuffer(hay[k].as_buffer(), complex)
                sums = np.frombuffer(squares[k].as_buffer())
                own = min(size, int(m[k] - p[k] * size))
                energy += sums[own : own + size] - sums[:size]
        if held is not None:
            yield best(*held[1:], product, energy)

    blocks = met.mapInArrow(summed, StructType([*(met.schema[k] for k in keys), *StructType.fromDDL("lag bigint, score double")]))
    found = blocks.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("lag")).alias("_back"))).alias("_b"))
    return found.select(*keys, (-F.col("_b._back")).alias("lag"), F.col("_b.score").alias("score"))


def lag_correlation(pairs: DataFrame, samples: DataFrame, signal: str, value: str, lags: int, size: int = BLOCK) -> DataFrame:
    """For each (left, right) pair the lag in -lags..lags of the largest normalized correlation; ties: the smallest lag.

    Means are taken off, and a lag counts the energies of the samples that meet at it.  Blocks of the left
    signal meet the blocks of the right one that lie within reach; sums of all lags are taken there.
    """
    means = samples.groupBy(signal).agg(F.avg(value).alias("_mean"))
    centred = samples.join(means, signal).select(signal, "pos", (F.col(value) - F.col("_mean")).alias("x"))
    left = _lists(pairs.join(centred.withColumnRenamed(signal, "left"), "left"), ["left", "right"], "_b", size, doubled=False).withColumnRenamed("_s", "_left")
    reach = -(-lags // size)
    near = F.explode(F.sequence(F.col("_b") - reach, F.col("_b") + reach)).alias("_near")
    right = _lists(centred.withColumnRenamed(signal, "right"), ["right"], "_near", size, doubled=False).withColumnRenamed("_s", "_right")
    met = left.select("left", "right", "_b", "_left", near).join(right, ["right", "_near"]).select("left", "right", "_b", "_near", "_left", "_right")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            b, o = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            held = [(s.field(0).to_numpy(), s.field(1).to_numpy()) for c in (4, 5) for s in (v.values for v in batch.column(c))]
            n = batch.num_rows
            for k in range(n):
                (at, x), (to, y) = held[k], held[n + k]
                a, b2, here, there = np.zeros(size), np.zeros(size), np.zeros(size, bool), np.zeros(size, bool)
                a[at], here[at], b2[to], there[to] = x, True, y, True
                for lag in range(-lags, lags + 1):
                    move = lag - int(o[k] - b[k]) * size  # the right block's place of the left block's first sample
                    lo, hi = max(0, -move), min(size, size - move)
                    if lo >= hi:
                        continue
                    both = here[lo:hi] & there[lo + move : hi + move]
                    if both.any():
                        u, v = a[lo:hi][both], b2[lo + move : hi + move][both]
                        rows.append((k, lag, float(u @ v), float(u @ u), float(v @ v)))
            index = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.float64()) for c in (2, 3, 4))],
                ["left", "right", "lag", "ab", "aa", "bb"],
            )

    made = met.mapInArrow(sums, StructType([met.schema["left"], met.schema["right"], *StructType.fromDDL("lag int, ab double, aa double, bb double")]))
    totals = made.groupBy("left", "right", "lag").agg(*[F.sum(c).alias(c) for c in ("ab", "aa", "bb")]).where("aa > 0 and bb > 0")
    scored = totals.withColumn("corr", F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), DIGITS))
    best = F.max_by(F.struct("lag", "corr"), F.struct("corr", -F.col("lag"))).alias("best")
    return scored.groupBy("left", "right").agg(best).select("left", "right", "best.lag", "best.corr")


def standard_scores(rows: DataFrame, by: list[str], value, name: str, guard: float = 1e-9) -> DataFrame:
    """A3: ``value`` less its mean over its deviation, by a sum that joins back; no task holds a signal."""
    made = rows.withColumn(name, value)
    stats = made.groupBy(*by).agg(F.avg(name).alias("_avg"), F.stddev_pop(name).alias("_std"))
    return made.join(stats, by).withColumn(name, (F.col(name) - F.col("_avg")) / (F.col("_std") + guard)).drop("_avg", "_std")


class _Tape:
    """The samples of a signal that are still needed; NaN where there is none."""

    def __init__(self) -> None:
        self.first, self.held = 0, np.zeros(0)

    @property
    def end(self) -> int:
        return self.first + len(self.held)

    def add(self, x: np.ndarray) -> None:
        self.held = np.concatenate([self.held, x])

    def span(self, lo: int, hi: int) -> np.ndarray:
        return self.held[lo - self.first : hi - self.first]

    def forget(self, upto: int) -> None:
        cut = min(max(upto - self.first, 0), len(self.held))
        self.first, self.held = self.first + cut, self.held[cut:]


class _Stretches:
    """One envelope at several lengths against a hay, both of which come in pieces from their begin on.

    A length's samples are drawn out a block at a time, when the envelope and the hay have come far enough; the products of
    spectra are added up for each block of lags.  Blocks are as long as the room for lags (LONGEST at most), so
    that work grows with the signals' lengths; the two tapes hold what the lengths' paces differ by.
    """

    def __init__(self, n: int, m: int, lengths: list[int], size: int):
        self.n, self.m, self.lengths = n, m, lengths
        room = m - min(lengths)
        self.size = max(size, min(LONGEST, 1 << room.bit_length()))
        self.outs = [(m - length) // self.size + 1 for length in lengths]
        self.done = [0] * len(lengths)
        self.products = [np.zeros((o, self.size + 1), complex) for o in self.outs]
        self.under = [np.zeros((o, self.size)) for o in self.outs]  # the hay under the needle, for its mean
        self.sums = np.zeros((len(lengths), 3))  # of samples, of their squares, their number
        self.own, self.hay, self.spectra = _Tape(), _Tape(), {}

    def _segment(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.spectra:
            x = np.zeros(2 * self.size)
            there = np.nan_to_num(self.hay.span(k * self.size, min((k + 2) * self.size, self.m)))
            x[: len(there)] = there
            self.spectra[k] = np.fft.rfft(x), np.concatenate([[0.0], np.cumsum(x)])
        return self.spectra[k]

    def advance(self) -> None:
        for j, length in enumerate(self.lengths):
            while (lo := self.done[j] * self.size) < length:
                hi = min(lo + self.size, length)
                at = np.array([lo, hi - 1]) * (self.n - 1) // (length - 1)
                if self.own.end < min(int(at[1]) + 2, self.n) or self.hay.end < min(lo + (self.outs[j] + 1) * self.size, self.m):
                    break
                self._block(j, lo, hi)
                self.done[j] += 1
        self.own.forget(min((d * self.size * (self.n - 1) // (length - 1) for d, length in zip(self.done, self.lengths, strict=True))))
        self.hay.forget(min(self.done) * self.size)
        self.spectra = {k: v for k, v in self.spectra.items() if k >= min(self.done)}

    def _block(self, j: int, lo: int, hi: int) -> None:
        length, size, p = self.lengths[j], self.size, self.done[j]
        place = np.arange(lo, hi) * (self.n - 1)
        left = place // (length - 1)
        v = self.own.held[left - self.own.first]
        after = self.own.held[np.minimum(left + 1, self.n - 1) - self.own.first]
        drawn = v + (place / (length - 1) - left) * (np.where(np.isnan(after), v, after) - v)
        known = ~np.isnan(drawn)
        drawn = np.where(known, drawn, 0.0)
        self.sums[j] += drawn.sum(), drawn @ drawn, known.sum()
        spectrum = np.conj(np.fft.rfft(drawn, 2 * size))
        mask = None if known.all() else np.conj(np.fft.rfft(known.astype(float), 2 * size))
        for o in range(self.outs[j]):
            hay, sums = self._segment(p + o)
            self.products[j][o] += spectrum * hay
            self.under[j][o] += sums[hi - lo : hi - lo + size] - sums[:size] if mask is None else np.fft.irfft(mask * hay, 2 * size)[:size]

    def best(self) -> list[tuple[int, float]]:
        """(lag, score) of each length; ties: the first lag."""
        out = []
        for j, length in enumerate(self.lengths):
            total, squares, n = self.sums[j]
            mean = total / max(n, 1)
            deviation = np.sqrt(max(squares / max(n, 1) - mean * mean, 0.0)) + 1e-9
            c = (np.fft.irfft(self.products[j], 2 * self.size)[:, : self.size] - mean * self.under[j]).ravel()[: self.m - length + 1]
            score = np.round(c / deviation / length, DIGITS) + 0.0
            at = int(np.argmax(score))
            out.append((at, float(score[at])))
        return out


def envelope_scales(pairs: DataFrame, envelopes: DataFrame, signal: str, value: str, start: int = 0, steps: int = 161, reach: float = 0.1, size: int = 512, least: int = 8) -> DataFrame:
    """(left, right, scale, pos, corr): how the left envelope, stretched, goes best into the right one.

    Both are standard scores of the logarithm.  The left one is drawn out linearly to every length that ``steps``
    scales around 1 give (scales that give one length are one candidate, the smallest) and met with the right one
    from ``start`` on.  Both travel in blocks of ``size`` hops, once for each of PARTS ranges of scales, and are
    stretched and correlated where they arrive, in order, so no task holds a signal and no stretched copy is
    written or shuffled.  Ties: the smaller scale, then the earlier place.  Null where no length fits.
    """
    scored = standard_scores(envelopes.select(signal, F.col("hop").cast("long").alias("hop"), F.col(value).alias("_rms")), [signal], F.log(F.col("_rms") + 1e-5), "z")
    scored = written(scored.select(signal, "hop", "z"), "scores")
    sizes = scored.groupBy(signal).agg(F.count("*").alias("_n"), (F.max("hop") + 1 - start).alias("_m")).where(F.col("_n") >= least)
    whole = sizes.select(F.col(signal).alias("right"), "_m")
    scale = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: 1 - reach + 2 * reach * k / (steps - 1))
    each = sizes.select(F.col(signal).alias("left"), "_n", F.explode(scale).alias("scale")).withColumn("length", F.greatest(F.lit(least), F.bround(F.col("_n") * F.col("scale"))).cast("long"))
    lengths = each.groupBy("left", "_n", "length").agg(F.min("scale").alias("scale"))
    part = F.least(F.floor((F.col("scale") - (1 - reach)) / (2 * reach) * PARTS), F.lit(PARTS - 1)).cast("int")
    asked = pairs.select("left", "right").distinct().join(lengths, "left").join(whole, "right").where(F.col("length") <= F.col("_m"))
    asked = written(asked.groupBy("left", "right", part.alias("part"), "_n", "_m").agg(F.sort_array(F.collect_list(F.struct("length", "scale"))).alias("lengths")), "lengths")

    def blocks(kind: int, name: str, pos) -> DataFrame:
        rows = scored.select(F.col(signal).alias(name), pos.alias("pos"), "z").where("pos >= 0")
        lists = rows.groupBy(name, div(F.col("pos"), size).alias("block")).agg(F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("at"), F.col("z").alias("x"))).alias("s"))
        return asked.join(lists, name).select("left", "right", "part", "block", F.lit(kind).alias("kind"), "_n", "_m", "lengths", "s")

    both = blocks(0, "left", F.col("hop")).unionByName(blocks(1, "right", F.col("hop") - start))
    keys, kinds = ["left", "right", "part"], [both.schema["left"], both.schema["right"]]
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "block", "kind")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def result() -> pa.RecordBatch:
            (_, left, right), scales, state = held
            state.advance()
            found = state.best()
            n = len(found)
            arrays = [pa.concat_arrays([left] * n), pa.concat_arrays([right] * n), pa.array(scales), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])]
            return pa.RecordBatch.from_arrays(arrays, ["left", "right", "scale", "lag", "score"])

        for batch in batches:
            kind, n, m = (batch.column(k).to_numpy() for k in (4, 5, 6))
            block, lists = batch.column(3).to_numpy(), batch.column(8)
            ends, flat = lists.offsets.to_numpy(), lists.flatten()
            ends = ends - ends[0]
            at, x = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                key = tuple(batch.column(c)[k].as_py() for c in range(3))
                if held is None or held[0][0] != key:
                    if held is not None:
                        yield result()
                    asked = batch.column(7)[k].as_py()
                    state = _Stretches(int(n[k]), int(m[k]), [a["length"] for a in asked], size)
                    held = ((key, batch.column(0).slice(k, 1), batch.column(1).slice(k, 1)), [a["scale"] for a in asked], state)
                long = int(m[k] if kind[k] else n[k])
                own = np.full(min(size, long - int(block[k]) * size), np.nan)
                own[at[ends[k] : ends[k + 1]]] = x[ends[k] : ends[k + 1]]
                (state.hay if kind[k] else state.own).add(own)
                state.advance()
        if held is not None:
            yield result()

    found = dealt.mapInArrow(met, StructType([*kinds, *StructType.fromDDL("scale double, lag bigint, score double")]))
    best = F.max(F.struct("score", (-F.col("scale")).alias("_scale"), (-F.col("lag")).alias("_lag"))).alias("b")
    made = found.groupBy("left", "right").agg(best)
    own = envelopes.select(signal).distinct()
    every = pairs.select("left", "right").join(own.withColumnRenamed(signal, "left"), "left").join(own.withColumnRenamed(signal, "right"), "right")
    out = every.join(made, ["left", "right"], "left")
    return out.select("left", "right", (-F.col("b._scale")).alias("scale"), (start - F.col("b._lag")).alias("pos"), F.col("b.score").alias("corr"))
