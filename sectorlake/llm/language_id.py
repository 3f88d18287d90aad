"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net penalties (McMahan et al., "Ad Click
Prediction: a View from the Trenches", 2013), and one temperature makes the probabilities honest (Guo et
al., "On Calibration of Modern Neural Networks", 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlake.llm.tables import materialize

#: Labelled texts that the weights are fitted on at most, in all and of one language, picked by hash.
TRAINING_ROWS, LANGUAGE_ROWS = 12_000, 2_000
#: Languages that are learned at most: the commonest.
LANGUAGES = 256
#: Documents are dealt into so many folds by CRC-32 of their id; one isn't learned from.
FOLDS, HELD_OUT = 3, 1
BUCKETS = 1 << 15
#: Characters that are worked on at once (or one longer word).
SLICE_CHARS = 1 << 20
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
EPOCHS, BATCH = 4, 32
UNKNOWN = "und"

# Odd multipliers of the n-grams' hash, drawn once.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of all n-grams of one to three characters, and each text's number of letters.

    Texts are lower-cased; what lies between runs of letters counts as one mark, which also stands before and
    behind each text; an n-gram has letters and at most a mark at either end.
    """
    parts = ["\0" + (t or "").lower() + "\0" for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(code), bool)
    first[np.cumsum([0, *map(len, parts[:-1])])] = True
    is_letter = _letters()[code]
    kept = is_letter | first
    kept[1:] |= is_letter[:-1]
    doc = (np.cumsum(first) - 1)[kept]
    c = np.where(is_letter, code, 0)[kept].astype(np.uint64)
    inner = c > 0
    n_letters = np.bincount(doc[inner], minlength=len(texts))
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    places, buckets = [], []
    for n in (1, 2, 3):
        if len(c) < n:
            break
        m = len(c) - n + 1
        # Marks of neighbouring texts meet, so no n-gram of letters reaches over a text's end.
        held = inner if n == 1 else (inner[:m] | inner[1 : m + 1]) if n == 2 else inner[1 : m + 1]
        at = np.flatnonzero(held)
        h = np.full(len(at), n, np.uint64) * _FACTORS[3]
        for k in range(n):
            h = (h + c[at + k]) * _FACTORS[k]
            h ^= h >> np.uint64(29)
        places.append(at)
        buckets.append(((h * _FACTORS[3]) >> shift).astype(np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
    at = np.concatenate(places)
    return np.concatenate(buckets), doc[at], n_letters


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_CHARS, "right")))
        yield lo, texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(number, piece) of each text; long ones are cut at blanks, over which no n-gram reaches, so their pieces' n-grams add up."""
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while len(text) - at > SLICE_CHARS and (cut := text.rfind(" ", at + 1, at + SLICE_CHARS)) > 0:
            yield k, text[at:cut]
            at = cut
        yield k, text[at:]


def _gram_batches(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, text, letters by text) of ``texts``, some megabytes of n-grams at a time."""
    held: list[tuple[int, str]] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = np.array([k for k, _ in held])
        bucket, doc, letters = _grams([t for _, t in held])
        return bucket, of[doc], np.bincount(of, letters, len(texts)).astype(np.int64)

    for piece in _pieces(texts):
        if held and size + len(piece[1]) > SLICE_CHARS:
            yield made()
            held, size = [], 0
        held.append(piece)
        size += len(piece[1])
    if held:
        yield made()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of texts that hold each bucket, one set of rows a task; bucket BUCKETS counts the texts."""
    found = np.zeros(BUCKETS + 1, np.int64)
    block = 256
    for batch in batches:
        for _, texts in _slices(batch.column(0)):
            for lo in range(0, len(texts), block):
                own = texts[lo : lo + block]
                seen = np.zeros((len(own), BUCKETS), bool)
                for bucket, doc, _ in _gram_batches(own):
                    seen[doc, bucket] = True
                found[:BUCKETS] += seen.sum(axis=0)
                found[BUCKETS] += len(own)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, turn, buckets, shares): shares of a text's n-grams in hundredths."""
    for batch in batches:
        for lo, texts in _slices(batch.column(2)):
            parts = [np.unique(doc * BUCKETS + bucket, return_counts=True) for bucket, doc, _ in _gram_batches(texts)]
            key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in parts]), len(key))
            doc = key // BUCKETS
            size = np.bincount(doc, minlength=len(texts))
            total = np.bincount(doc, n, len(texts))
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((key % BUCKETS).astype(np.int32), (100 * n / total[doc]).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), batch.column(1).slice(lo, len(texts)), *lists], ["lang", "turn", "buckets", "shares"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their biases, IDF times weight of each (bucket, language), and the temperature that logits are divided by."""

    languages: tuple[str, ...]
    bias: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits before calibration, and the numbers of letters."""
        total, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        sums = np.zeros((len(texts), len(self.languages)))
        for bucket, doc, found in _gram_batches(texts):
            total += np.bincount(doc, minlength=len(texts))
            letters += found
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(doc, self.weights[bucket, k], len(texts))
        return self.bias + 100 * sums / np.maximum(total, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability; ``und`` and 0 without letters or languages."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, letters = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        known = letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def _learn(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(bias, weights) by FTRL-proximal over mini-batches; the bias isn't penalised."""
    z, seen = np.zeros((BUCKETS + 1, n_languages)), np.zeros((BUCKETS + 1, n_languages))
    l1, l2 = np.full((BUCKETS + 1, 1), L1), np.full((BUCKETS + 1, 1), L2)
    l1[BUCKETS] = l2[BUCKETS] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1[at], 0.0, -(own - np.sign(own) * l1[at]) / ((BETA + np.sqrt(seen[at])) / ALPHA + l2[at]))

    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            own = [rows[k] for k in order[lo : lo + BATCH]]
            at, inverse = np.unique(np.concatenate([[BUCKETS], *(r[0] for r in own)]), return_inverse=True)
            x = np.zeros((len(own), len(at)))
            x[np.repeat(np.arange(len(own)), [len(r[0]) for r in own]), inverse[1:]] = np.concatenate([r[1] * idf[r[0]] for r in own])
            x[:, -1] = 1.0  # the bias has the largest place
            w = weights(at)
            error = _softmax(x @ w)
            error[np.arange(len(own)), [r[2] for r in own]] -= 1.0
            gradient = x.T @ error / len(own)
            grown = seen[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(seen[at])) / ALPHA * w
            seen[at] = grown
    learned = weights(np.arange(BUCKETS + 1))
    return learned[BUCKETS], learned[:BUCKETS]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log-loss, by ever finer grids; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(6):
        grid = np.linspace(lo, hi, 9)
        k = int(np.argmin([loss(np.exp(g)) for g in grid]))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, 8)]
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text is of the fold that isn't learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def training_texts(docs: DataFrame, rows: int = TRAINING_ROWS, of_one: int = LANGUAGE_ROWS, languages: int = LANGUAGES) -> DataFrame:
    """(lang, turn, text): distinct texts of the learning folds, about ``rows`` at most and ``of_one`` of a language, in hashed turn.

    Texts are counted and picked by their hash, so copies are one; of more languages the commonest are kept.
    """
    known = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("turn"))
    sizes = known.select("lang", "turn").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return known.select("lang", "turn", "text").limit(0)
    most = min(of_one, rows // len(sizes))
    parts = 1 << 30
    shares = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(parts, most * parts // r["n"]))])
    picked = known.where(F.pmod(F.xxhash64(F.lit(11), "turn"), F.lit(parts)) < F.try_element_at(shares, F.col("lang")))
    return picked.groupBy("lang", "turn").agg(F.any_value("text").alias("text"))


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from (doc_id, text, lang): document frequencies of all texts of the learning folds, weights of a bounded sample.

    A fifth of the sample, by hash, isn't trained on and sets the temperature.  Rows with a null lang, text or
    doc_id aren't learned from; without any the model knows no language.
    """
    learned = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null")
    found = learned.select("text").mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sample = materialize(training_texts(docs).mapInArrow(_features, "lang string, turn bigint, buckets array<int>, shares array<float>"), "language-sample")
    rows = sample.where(F.size("buckets") > 0).toArrow().sort_by([("turn", "ascending"), ("lang", "ascending")]).combine_chunks()
    named = rows.column("lang").to_pylist()
    languages = tuple(sorted(set(named)))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((BUCKETS, 0)), 1.0)
    n = np.zeros(BUCKETS + 1)
    n[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    idf = np.log((1 + n[BUCKETS]) / (1 + n[:BUCKETS])) + 1
    code = {lang: k for k, lang in enumerate(languages)}
    known = [(b.values.to_numpy(), x.values.to_numpy(), code[lang]) for b, x, lang in zip(rows.column("buckets"), rows.column("shares"), named, strict=True)]
    check = [k % 5 == 0 for k in range(len(known))] if len(known) >= 50 else [False] * len(known)
    bias, weights = _learn([r for r, c in zip(known, check, strict=True) if not c], idf, len(languages))
    scaled = weights * idf[:, None]
    kept = [r for r, c in zip(known, check, strict=True) if c]
    logits = np.array([bias + r[1] @ scaled[r[0]] for r in kept]).reshape(len(kept), len(languages))
    return LanguageModel(languages, bias, scaled.astype(np.float32), _temperature(logits, np.array([r[2] for r in kept], int)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` from its whole text alone.

    ``score`` is the calibrated probability of ``lang_pred``.  A text that is null or has no letter is ``und``
    with score 0.  Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _slices(batch.column(1)):
                lang, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(judged, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
