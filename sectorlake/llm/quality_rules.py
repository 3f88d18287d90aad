"""Quality classifier: a sparse rule ensemble over text statistics, compiled to column expressions.

Trees are grown on residuals, their paths become conjunctive rules, a lasso logistic regression keeps
few of them (Friedman and Popescu, "Predictive Learning via Rule Ensembles", 2008), and what remains is
one Spark expression over the statistics' columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sectorlake.llm import words as W
from sectorlake.llm.tables import materialize

#: Labelled rows that the model is fitted on at most, picked by hash.  Scores cover all rows.
TRAINING_ROWS = 10_000
TREES, DEPTH, BINS = 24, 3, 32
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
FOLDS = 5

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stress": b"!?",
    "symbol": b"#$%&*+<=>@^_`|~/\\{}[]",
    "mark": b".,;:'\"()-",
    "space": b" \t\n\r\x0b\x0c",
    "line": b"\n",
    "wide": range(128, 256),
}
_IN = {}
for _name, _bytes in _CLASSES.items():
    _IN[_name] = np.zeros(256, np.int32)
    _IN[_name][list(_bytes)] = 1

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "commonest_word", "words_per_line",
    *(f"{name}_share" for name in _CLASSES),
]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in W.segments(batch.column(1)):
            n = len(words.offsets) - 1
            size = np.diff(words.offsets)
            some = np.maximum(size, 1)
            count = words.counts
            length = words.ends - words.starts
            doc = words.documents()
            order = np.lexsort((words.hashes, doc))
            h, d = words.hashes[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(new)
            commonest = np.zeros(n, np.int64)
            np.maximum.at(commonest, d[first], np.diff(np.append(first, len(h))))
            longest = np.zeros(n, np.int64)
            np.maximum.at(longest, doc, length)
            per_word = np.maximum(count, 1)
            totals = {}
            for name, inside in _IN.items():
                sums = np.zeros(len(words.data) + 1, np.int64)
                np.cumsum(inside[words.data], out=sums[1:])
                totals[name] = np.diff(sums[words.offsets])
            columns = [
                np.log1p(size), np.log1p(count), np.bincount(doc, length, n) / per_word, np.log1p(longest),
                np.bincount(d[first], minlength=n) / per_word, commonest / per_word, np.log1p(count / (totals["line"] + 1)),
                *(totals[name] / some for name in _CLASSES),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.lo, n), *(pa.array(c.astype(np.float64)) for c in columns)], ["doc_id", *STATISTICS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) of every row's whole text; a null text counts as empty, which gives zeros."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_statistics, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_above, cut) and its weight in the log-odds."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, prefix: str = "") -> Column:
        held = F.lit(True)
        for name, above, cut in self.tests:
            held = held & (F.col(prefix + name) > cut if above else F.col(prefix + name) <= cut)
        return held.cast("double") * self.weight

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for name, above, cut in self.tests:
            x = values[:, STATISTICS.index(name)]
            out &= x > cut if above else x <= cut
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def column(self, prefix: str = "") -> Column:
        """The probability of label 1 as a Spark expression over the statistics' columns, named with ``prefix``."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column(prefix)
        return 1 / (1 + F.exp(-total))

    def predict(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((r.weight * r.holds(values) for r in self.rules), np.zeros(len(values))))))


def _grow(codes: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: list) -> np.ndarray:
    """Split greedily by squared error over binned statistics; record each node's path; return fitted values."""
    fitted = np.full(len(rows), residual[rows].mean() if len(rows) else 0.0)
    if depth == 0 or len(rows) < 40:
        return fitted
    best = (1e-12, None, None)
    total, n = residual[rows].sum(), len(rows)
    for f in range(codes.shape[1]):
        c = codes[rows, f]
        sums = np.cumsum(np.bincount(c, residual[rows], BINS + 1))[:-1]
        counts = np.cumsum(np.bincount(c, minlength=BINS + 1))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums**2 / counts + (total - sums) ** 2 / (n - counts) - total**2 / n
        gain[(counts < 10) | (n - counts < 10)] = 0
        b = int(np.argmax(gain))
        if gain[b] > best[0] and b < len(cuts[f]):
            best = (gain[b], f, b)
    if best[1] is None:
        return fitted
    _, f, b = best
    above = codes[rows, f] > b
    for side in (False, True):
        own = (*path, (STATISTICS[f], side, float(cuts[f][b])))
        paths.append(own)
        fitted[above == side] = _grow(codes, cuts, residual, rows[above == side], depth - 1, own, paths)
    return fitted


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradients; the bias is free."""
    n = len(y)
    z = np.column_stack([np.ones(n), x])
    step = 4.0 / max(np.linalg.eigvalsh(z.T @ z / n)[-1], 1e-9)
    shrink = np.r_[0.0, np.full(x.shape[1], penalty * step)]
    w = look = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        gradient = z.T @ (1 / (1 + np.exp(-(z @ look))) - y) / n
        after = look - step * gradient
        after = np.sign(after) * np.maximum(np.abs(after) - shrink, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = after + (t - 1) / s * (after - w)
        w, t = after, s
    return float(w[0]), w[1:]


def fit_rules(values: np.ndarray, labels: np.ndarray, seed: int = 0) -> RuleModel:
    """A rule model of 0/1 ``labels``; with no rows or one label only, a smoothed share and no rules."""
    n, ones = len(labels), int(labels.sum())
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if n < 40 or ones in (0, n):
        return RuleModel(prior, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(values[:, f], np.arange(1, BINS) / BINS)) for f in range(values.shape[1])]
    codes = np.column_stack([np.searchsorted(c, values[:, f], "left") for f, c in enumerate(cuts)])
    paths: list[tuple] = []
    score = np.full(n, prior)
    for _ in range(TREES):
        rows = np.sort(rng.choice(n, max(n // 2, min(n, 40)), replace=False))
        residual = labels - 1 / (1 + np.exp(-score))
        own: list[tuple] = []
        _grow(codes, cuts, residual, rows, DEPTH, (), own)
        paths += own
        # The whole tree moves all rows by the mean residual of its leaves.
        leaves = [p for p in own if not any(q[: len(p)] == p and q != p for q in own)]
        for leaf in leaves:
            at = Rule(leaf, 0.0).holds(values)
            if at.any():
                score[at] += 1.5 * residual[at].mean() / max(np.mean((s := 1 / (1 + np.exp(-score[at]))) * (1 - s)), 0.02) * 0.3
    paths = list(dict.fromkeys(paths))
    distinct: dict[bytes, tuple] = {}  # rules that hold on the same rows count once
    for path in paths:
        held = Rule(path, 0.0).holds(values)
        if 0 < held.sum() < n:
            distinct.setdefault(np.packbits(held).tobytes(), path)
    if not distinct:
        return RuleModel(prior, ())
    paths = list(distinct.values())
    x = np.column_stack([np.unpackbits(np.frombuffer(k, np.uint8), count=n) for k in distinct]).astype(float)
    check = np.arange(n) % 4 == 0
    loss = {}
    for penalty in PENALTIES:
        bias, w = _lasso(x[~check], labels[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-(bias + x[check] @ w))), 1e-6, 1 - 1e-6)
        loss[penalty] = -np.mean(labels[check] * np.log(p) + (1 - labels[check]) * np.log(1 - p))
    bias, w = _lasso(x, labels, min(loss, key=loss.get))
    return RuleModel(bias, tuple(Rule(path, float(v)) for path, v in zip(paths, w, strict=True) if abs(v) > 1e-4))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_labels(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(label_id, label): about ``rows`` distinct labels at most outside the held-out fold, picked by hash.

    ``labels`` has (doc_id, quality); rows with nulls are left out.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label")).where("label_id is not null and label is not null")
    known = known.where(~held_out(F.col("label_id"))).distinct()
    share = min(1.0, rows / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(statistics: DataFrame, picked: DataFrame, rows: int = TRAINING_ROWS) -> RuleModel:
    """Fit on the rows of ``statistics`` (doc_id, ...) that have a label in ``picked``, about ``rows`` at most.

    Rows equal in id, statistics and label count once, so repeated rows don't add up; of what is left,
    as where many texts share an id, a share is picked by hash.
    """
    joined = statistics.join(picked, F.col("doc_id") == F.col("label_id")).select("doc_id", "label", *STATISTICS).distinct()
    joined = materialize(joined, "training-rows")
    share = min(1.0, rows / max(joined.count(), 1))
    chosen = joined.where(F.pmod(F.xxhash64(F.lit(7), *joined.columns), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = chosen.toPandas().sort_values(["doc_id", *STATISTICS, "label"])
    return fit_rules(table[STATISTICS].to_numpy(float), (table["label"].to_numpy(float) > 0).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    ``score`` in (0, 1) estimates that ``labels.quality`` is 1, from statistics of the whole text alone;
    ``predicted`` is 1 from ``threshold`` on.  Null and empty texts are scored by their zeros.  Ids
    only tell which labels to learn from.  Without usable labels the score is one constant.  An empty
    table gives no rows; other columns are ignored.
    """
    statistics = materialize(text_statistics(docs), "text-statistics")
    model = fit(statistics, training_labels(labels, rows), rows)
    scored = statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``.

    Rows are scored as by ``score_quality``, by the compiled column; only labelled rows are measured for
    learning.  Repeated rows, null ids and null texts are judged like any other; columns may have any
    name.
    """
    picked = training_labels(labels, rows)
    labelled = docs.select("doc_id", "text").join(picked.select(F.col("label_id").alias("doc_id")), "doc_id", "left_semi")
    model = fit(text_statistics(labelled), picked, rows)
    place = docs.columns.index("text")
    prefix = "_"
    while any(prefix + s in docs.columns for s in STATISTICS):
        prefix += "_"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], ["doc_id", "text"])
            for part in _statistics(iter([plain])):
                own = batch.take(part.column(0))
                yield pa.RecordBatch.from_arrays([*own.columns, *part.columns[1:]], [*own.schema.names, *(prefix + s for s in STATISTICS)])

    schema = StructType([*docs.schema, *(StructField(prefix + s, DoubleType()) for s in STATISTICS)])
    return docs.mapInArrow(measured, schema).where(model.column(prefix) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
