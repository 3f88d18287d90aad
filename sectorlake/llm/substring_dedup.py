"""Substring dedup: recurring passages are confirmed, and sharded automata locate every occurrence.

A window is WINDOW consecutive words of one document.  A word goes if a window covers it whose word
sequence also starts earlier: in a document of smaller doc_id, or earlier in the same one.

1. Documents are written once with a row number and dealt to shards of bounded size by it, so that no id
   and no text gathers in one of them.  A document that is a whole copy of one before it is decided by a
   join, without its text.
2. Each window picks the smallest hash among its PHRASE-word phrases (winnowing), so equal windows
   pick equal phrases.  Picked phrases are counted over the corpus; those met twice are recurring.
3. Each shard spells the phrases that it picked and the corpus' count confirms, compiles them into an
   Aho-Corasick automaton over word codes and streams all its documents through it, which finds every
   occurrence, picked or not; every window around one is a candidate.
4. Each shard reports the first place of each candidate window, by 122 bits; the first over all shards keeps it.
5. Documents with candidates meet the windows that their shard lost, and words are cut.

No step gathers a document group, a phrase's occurrences or a dictionary in one place: an automaton is
bounded by its shard's own text, and a window has one row a shard, which is aggregated, never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sectorlake.llm import words as W
from sectorlake.llm.tables import drop, materialize

WINDOW = 20
PHRASE = 10
#: Text bytes of a shard; more text makes more shards.
SHARD_BYTES = 4 << 20
#: Null doc_ids come after all others.
LAST = (1 << 63) - 1


def _picked(words: W.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, document) of the phrase places that some window picks."""
    hashes, at, doc = words.windows(phrase)
    span = window - phrase + 1
    if len(hashes) < span:
        return hashes[:0], at[:0], doc[:0]
    lowest = W.sliding_minimum(hashes, span)
    inside = doc[: len(lowest)] == doc[span - 1 :]
    # A place is picked if its hash is the minimum of some window over it.
    best = np.zeros(len(hashes) + span - 1, np.uint64)
    best[span - 1 : span - 1 + len(lowest)] = np.where(inside, lowest, 0)
    highest = ~W.sliding_minimum(~best, span)
    chosen = hashes == highest[: len(hashes)]
    return hashes[chosen], at[chosen], doc[chosen]


#: A word is LETTERS letters of six bits of its hash: nodes of an automaton have few branches, and two
#: phrases of ten words agree by chance once in 2**120.
LETTERS = 2


def _letters(hashes: np.ndarray) -> bytes:
    bits = hashes[:, None] >> (np.uint64(6) * np.arange(LETTERS, dtype=np.uint64))
    return ((bits & np.uint64(63)).astype(np.uint8) + np.uint8(48)).tobytes()


def _phrases(window: int, phrase: int):
    """(phrase, shard, n): phrases that some window of the shard's documents picks, and at how many places."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column(0).to_numpy()
            for words in W.segments(batch.column(1)):
                hashes, _, doc = _picked(words, window, phrase)
                own = shard[words.lo + doc]
                order = np.lexsort((own, hashes))
                h, s = hashes[order], own[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(s[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["phrase", "shard", "n"])

    return per_batch


_DONE = "text string, n_words bigint, n_removed bigint, kept_sha256 string"


def _kept(words: W.Words, doc: int, gone: np.ndarray | None, with_text: bool) -> tuple[str | None, str]:
    """(text, digest): the words that stay, with the white space behind each; digest over single spaces."""
    a, b = words.first[doc], words.first[doc + 1]
    raw = words.data[words.offsets[doc] : words.offsets[doc + 1]].tobytes()
    if gone is None or not gone.any():
        return raw.decode() if with_text else None, hashlib.sha256(b" ".join(raw.split())).hexdigest()
    stay = np.flatnonzero(~gone)
    base = words.offsets[doc]
    begins = words.starts[a:b] - base
    joined = b" ".join(raw[s:e] for s, e in zip(begins[stay].tolist(), (words.ends[a:b] - base)[stay].tolist(), strict=True))
    text = None
    if with_text:
        upto = np.append(begins[1:], len(raw))
        text = b"".join(raw[s:e] for s, e in zip(begins[stay].tolist(), upto[stay].tolist(), strict=True)).decode()
    return text, hashlib.sha256(joined).hexdigest()


def _with(docs: pa.Table, made: list, schema: pa.Schema) -> pa.Table:
    """The documents' own columns, as far as ``schema`` has them, and the made ones behind."""
    own = list(schema)[: len(schema) - len(made)]
    new = list(schema)[len(own) :]
    arrays = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, new, strict=True)]
    return pa.Table.from_arrays([*(docs[f.name].cast(f.type) for f in own), *arrays], schema=schema)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_key", "ascending"), ("h1", "ascending"), ("h2", "ascending")]).combine_chunks()


def _firsts(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Positions, in order, at which a pair of hashes stands for the first time."""
    order = np.lexsort((np.arange(len(h1)), h2, h1))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return np.sort(order[new])


def _locate(window: int, phrase: int, with_text: bool, schema: pa.Schema):
    """Per shard: the documents, and the recurring phrases (kind 0) and whole copies (kind 1) that concern them."""

    def per_shard(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = _ordered(docs)
        is_copy = side["kind"].to_numpy() == 1
        value = side["value"].to_numpy()
        copy = np.isin(docs["row"].to_numpy(), value[is_copy])
        confirmed = np.sort(value[~is_copy].astype(np.int64).view(np.uint64))
        parts = list(W.segments(docs["text"]))
        automaton = ahocorasick.Automaton()
        for words in parts:  # each confirmed phrase is spelled where the shard picked it
            hashes, at, _ = _picked(words, window, phrase)
            met, one = np.unique(hashes, return_index=True)
            letters = _letters(words.hashes).decode("latin-1")
            for p in (LETTERS * at[one[np.isin(met, confirmed)]]).tolist():
                automaton.add_word(letters[p : p + LETTERS * phrase], 1)
        if len(automaton):
            automaton.make_automaton()
        rows, found_one, found_two, found_row = [], [], [], []
        for words in parts:
            letters = _letters(words.hashes).decode("latin-1")
            one, window_at, _ = words.windows(window)
            two = None
            for d, n in enumerate(words.counts.tolist()):
                row, first_word = words.lo + d, int(words.first[d])
                if n >= window and copy[row]:
                    rows.append(("" if with_text else None, n, n, hashlib.sha256(b"").hexdigest()))
                    continue
                ends = np.zeros(0, np.int64)
                if n >= window and len(automaton):
                    stretch = letters[LETTERS * first_word : LETTERS * (first_word + n)]
                    ends = np.array([e for e, _ in automaton.iter(stretch)], np.int64) + 1
                    ends = ends[ends % LETTERS == 0]  # in step with the words
                if len(ends):
                    p = ends // LETTERS - phrase
                    delta = np.zeros(n + 2, np.int64)
                    np.add.at(delta, np.maximum(p - (window - phrase), 0), 1)
                    np.add.at(delta, p + 1, -1)
                    candidate = np.flatnonzero(np.cumsum(delta)[: n - window + 1] > 0)
                    if two is None:
                        two = words.windows(window, 1)[0]
                    at = np.searchsorted(window_at, first_word) + candidate
                    found_one.append(one[at])
                    found_two.append(two[at])
                    found_row.append(np.full(len(candidate), len(rows)))
                    # the text is carried on, for the cut
                    rows.append((words.data[words.offsets[d] : words.offsets[d + 1]].tobytes().decode(), n, None, None))
                    continue
                text, digest = _kept(words, d, None, with_text)
                rows.append((text, n, 0, digest))
        # The first place of each candidate window in this shard, listed with its document.
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        h1, h2, owner = join(found_one, np.uint64), join(found_two, np.uint64), join(found_row, np.int64)
        at = _firsts(h1, h2)
        offsets = pa.array(np.searchsorted(owner[at], np.arange(len(rows) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[at].view(np.int64))) for x in (h1, h2)]
        return _with(docs, [*zip(*rows, strict=True), *lists], schema)

    return per_shard


def _cut(window: int, with_text: bool, schema: pa.Schema):
    """Per shard: documents with candidate windows, and the windows whose first place is elsewhere."""

    def per_shard(docs: pa.Table, lost: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = _ordered(docs)
        away = [lost[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("w1", "w2")]
        parts = list(W.segments(docs["text"]))
        every = [(*p.windows(window)[:2], p.windows(window, 1)[0]) for p in parts]
        join = lambda k: np.concatenate([np.zeros(0, np.uint64), *(e[k] for e in every)])
        # Windows that are first elsewhere stand before all others, so that none of them is first here.
        h1, h2 = np.concatenate([away[0], join(0)]), np.concatenate([away[1], join(2)])
        repeated = np.ones(len(h1), bool)
        repeated[_firsts(h1, h2)] = False
        repeated = repeated[len(away[0]) :]
        rows, done = [], 0
        for words, (h, at, _) in zip(parts, every, strict=True):
            delta = np.zeros(len(words.hashes) + 1, np.int64)
            hit = at[repeated[done : done + len(h)]]
            done += len(h)
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + window, -1)
            gone = np.cumsum(delta)[:-1] > 0
            for d, n in enumerate(words.counts.tolist()):
                own = gone[words.first[d] : words.first[d + 1]]
                text, digest = _kept(words, d, own, with_text)
                rows.append((text, n, int(own.sum()), digest))
        return _with(docs, list(zip(*rows, strict=True)), schema)

    return per_shard


def dedup_substrings(
    docs: DataFrame, with_text: bool = True, carry: tuple[str, ...] = (), window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, carried columns, text, n_words, n_removed, kept_sha256).

    ``text`` (null unless ``with_text``) is the input's where nothing goes, else the kept words with
    the white space behind each.  A null text has no words; texts under ``window`` words stay.  Null
    doc_ids come after all others; of rows that share a doc_id the one of smaller text hash is first,
    and of identical rows one.  An empty table gives no rows.  Columns not named in ``carry`` are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    extra = F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    numbered = docs.select(key.alias("doc_key"), "doc_id", extra.alias("extra"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    keyed = materialize(
        numbered.select(
            F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "doc_key", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"),
            "doc_id", "extra", "text",
        ),
        "substring-docs",
    )

    phrases = materialize(keyed.select("shard", "text").mapInArrow(_phrases(window, phrase), "phrase bigint, shard int, n bigint"), "phrases")
    recurring = phrases.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1").select("phrase")
    wanted = phrases.join(recurring, "phrase", "left_semi").select("shard", F.lit(0).alias("kind"), F.col("phrase").alias("value"))

    texts = keyed.select("shard", "row", "doc_key", "h1", "h2")
    firsts = texts.groupBy("h1", "h2").agg(F.min(F.struct("doc_key", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = texts.join(firsts, ["h1", "h2"]).where("row != first.row")
    side = materialize(wanted.unionByName(copies.select("shard", F.lit(1).alias("kind"), F.col("row").alias("value"))), "phrases-and-copies")
    drop(phrases)

    made = spark.createDataFrame([], _DONE).schema
    head = keyed.drop("text").schema
    located_sql = StructType([*head, *made, *spark.createDataFrame([], "w1 array<bigint>, w2 array<bigint>").schema])
    located = materialize(
        keyed.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(_locate(window, phrase, with_text, to_arrow_schema(located_sql)), located_sql),
        "substring-located",
    )
    drop(side)
    open_ = located.where("n_removed is null")
    # Each shard has one row for a window.  Those that only one shard has are left out first, by half of
    # their hash, so that only contested windows travel whole; the least place of all shards keeps one.
    listed = open_.select("shard", "doc_key", "h1", F.explode(F.arrays_zip("w1", "w2")).alias("w")).select("w.w1", "w.w2", "shard", "doc_key", "h1")
    several = materialize(listed.groupBy("w1").agg(F.count("*").alias("n")).where("n > 1").select("w1"), "shared-windows")
    contested = materialize(listed.join(several, "w1", "left_semi"), "contested-windows")
    first = contested.groupBy("w1", "w2").agg(F.min(F.struct("doc_key", "h1", "shard")).alias("first"), F.count("*").alias("n")).where("n > 1")
    lost = materialize(contested.join(first, ["w1", "w2"]).where("shard != first.shard").select("shard", "w1", "w2"), "lost-windows")
    drop(several)
    drop(contested)

    cut_sql = StructType([head["doc_id"], head["extra"], *made])
    waiting = open_.select("shard", "doc_key", "h1", "h2", "doc_id", "extra", "text")
    cut = waiting.groupBy("shard").cogroup(lost.groupBy("shard")).applyInArrow(_cut(window, with_text, to_arrow_schema(cut_sql)), cut_sql)
    names = ["doc_id", *(F.col("extra")[c].alias(c) for c in carry), "text", "n_words", "n_removed", "kept_sha256"]
    return located.where("n_removed is not null").select(*names).unionByName(cut.select(*names))
