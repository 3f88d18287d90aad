"""Packing: documents' tokens are concatenated and cut into fixed windows by two-pass prefix sums."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectorlake.llm import words as W
from sectorlake.llm.tables import materialize

WINDOW = 1024
END_ID = 0
#: Units whose ids a Python worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000
#: Unknown units are encoded in joined texts of JOINED units, BATCHED texts at a time.
JOINED, BATCHED = 256, 32
#: White space beyond ASCII's six; a text with any is encoded whole.
ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class UnitTokenizer:
    """Ids of whole texts by a public tokenizer file, with a bounded memory of units seen.

    A unit is a word with the white space before it, cut where marks follow a letter, or white space at
    a text's end.  A byte-level pre-tokenizer never joins a character to white space behind it, nor a
    letter to marks (an apostrophe aside) behind it, so a text's ids are those of its units; equal
    units of a batch are found by hash, compared byte by byte and looked up once.  Texts that hold other white
    space or an added token, and files with any other pre-tokenizer or a normalizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id: one character a byte
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.memory: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), BATCHED):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo : lo + BATCHED], add_special_tokens=False)]
        return out

    def _learn(self, units: list[bytes]) -> None:
        """Encode new units, those between words joined, and cut the ids where the units' bytes end."""
        inner = [u for u in units if u[0] in WHITE and u[-1] not in WHITE]
        outer = [u for u in units if u[0] not in WHITE or u[-1] in WHITE]
        self.memory.update(zip(outer, self._encode([u.decode() for u in outer]), strict=True))
        joined = [inner[lo : lo + JOINED] for lo in range(0, len(inner), JOINED)]
        for own, ids in zip(joined, self._encode([b"".join(own).decode() for own in joined]), strict=True):
            upto = np.cumsum(self.width[np.frombuffer(ids, "<u4")])
            ends = 4 * (np.searchsorted(upto, np.cumsum([len(u) for u in own])) + 1)
            begin = 0
            for unit, end in zip(own, ends.tolist(), strict=True):
                self.memory[unit] = ids[begin:end]
                begin = end

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded whole."""
        if not self.by_unit:
            return np.ones(len(texts), bool)
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        return odd.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, tokens of each text, ids of all) for stretches of ``texts``, ``end_id`` behind each text."""
        texts = pc.fill_null(texts, "")
        every_odd = self._whole(texts)
        for words in W.segments(texts, hashed=False):
            n, data, offsets = len(words.counts), words.data, words.offsets
            odd = every_odd[words.lo : words.lo + n]
            cut = LETTER[data[:-1]] & MARK[data[1:]]
            cut[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
            stops = np.sort(np.r_[words.ends, np.flatnonzero(cut) + 1], kind="stable")
            first = np.searchsorted(stops, offsets, "right")
            counts = np.diff(first)
            doc = np.repeat(np.arange(n), counts)
            begin = np.r_[0, stops[:-1]][: len(stops)]
            some = counts > 0
            begin[first[:-1][some]] = offsets[:-1][some]
            tail = offsets[:-1].copy()  # where the last unit ends
            tail[some] = stops[first[1:][some] - 1]
            stay = ~odd[doc]
            begin, stop, doc = begin[stay], stops[stay], doc[stay]
            tailed = np.flatnonzero((tail < offsets[1:]) & ~odd)
            # Units in order: a text's words, its tail or its whole, its end.
            counts = np.where(odd, 0, counts)
            last = np.zeros(n, np.int64)
            last[tailed] = 1
            last[odd] = 1
            base = np.cumsum(counts + last + 1) - (counts + last + 1)
            at = base[doc] + np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
            begins, stops = np.r_[begin, tail[tailed]], np.r_[stop, offsets[1:][tailed]]
            _, one, which = np.unique(W.byte_spans(data, begins, stops), return_index=True, return_inverse=True)
            # Equal hashes are not taken for equal bytes: a unit that differs from its like stands for itself.
            differs = np.flatnonzero(~same_bytes(data, begins, stops, one[which]))
            which[differs] = len(one) + np.arange(len(differs))
            one = np.r_[one, differs]
            raw = data.tobytes()
            units = [raw[a:b] for a, b in zip(begins[one].tolist(), stops[one].tolist(), strict=True)]
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            self._learn([u for u in units if u not in self.memory])
            ids = [self.memory[u] for u in units]
            wholes = np.flatnonzero(odd)
            ids += self._encode([texts[words.lo + int(d)].as_py() for d in wholes])
            ids.append(np.array([end_id], "<u4").tobytes())
            order = np.full(int((counts + last + 1).sum()), len(ids) - 1)
            order[at] = which[: len(doc)]
            order[(base + counts)[tailed]] = which[len(doc) :]
            order[(base + counts)[wholes]] = len(units) + np.arange(len(wholes))
            flat = np.frombuffer(b"".join(ids), "<u4")
            size = np.array([len(x) // 4 for x in ids])
            where = np.cumsum(size) - size
            each = size[order]
            upto = np.cumsum(each)
            tokens = flat[np.repeat(where[order] - (upto - each), each) + np.arange(upto[-1])]
            yield words.lo, np.diff(np.r_[0, upto[base + counts + last]]), tokens


def same_bytes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, like: np.ndarray) -> np.ndarray:
    """For each span of ``data`` whether it holds the same bytes as span number ``like``."""
    size = stops - begins
    same = size == size[like]
    own = np.flatnonzero(same & (like != np.arange(len(like))))
    length = size[own]
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    wrong = np.flatnonzero(data[np.repeat(begins[own], length) + at] != data[np.repeat(begins[like[own]], length) + at])
    same[own[np.searchsorted(ends, wrong, "right")]] = False
    return same


LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
WHITE = b" \t\n\x0b\x0c\r"


@cache
def tokenizer(path: str) -> UnitTokenizer:
    return UnitTokenizer(path)


def _tokenize(path: str | None, end_id: int):
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            encoder = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            encoder = tokenizer(path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, n, ids in encoder.encode(batch.column(1), end_id):
                local = before + np.cumsum(n) - n
                before += len(ids)
                offsets = np.r_[0, 4 * np.cumsum(n)].astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), batch.column(0).slice(lo, len(n)), pa.array(local), pa.array(n.astype(np.int64)), lists],
                    ["part", "doc_id", "local", "tokens", "ids"],
                )

    return per_partition


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its text's ids (null text: none) and ``end_id``.  All documents form one stream in
    the order of the input's partitions, which is cut every ``window`` ids: a document that crosses a
    cut has a record on each side of it, and only the last sequence is padded.  ``ids`` are
    little-endian unsigned 32-bit numbers.  ``tokenizer_path`` None means the public 50k byte-level
    vocabulary as installed on each executor.  Rows are packed as they are, repeated and null doc_ids
    too; an empty table gives no rows; other columns are ignored.

    The first pass tokenizes in place, without a shuffle, and writes ids and positions within the
    partition.  Totals of partitions (one row each) are summed up to global offsets; the second pass
    reads the written ids.
    """
    kind = dict(docs.dtypes)["doc_id"]
    tokens = materialize(
        docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer_path, end_id), f"part int, doc_id {kind}, local bigint, tokens bigint, ids binary"),
        "packing-ids",
    )
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))  # a row per input partition
    placed = tokens.join(F.broadcast(offsets), "part").withColumn("at", F.col("base") + F.col("local"))
    first = F.expr(f"at div {window}")
    last = F.expr(f"(at + tokens - 1) div {window}")

    def piece(w):
        start = F.greatest(w * window - F.col("at"), F.lit(0))
        stop = F.least((w + 1) * window - F.col("at"), F.col("tokens"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
            w.alias("sequence_id"), (F.col("at") + start - w * window).alias("offset"),
        )

    return placed.select("doc_id", F.col("tokens").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"
    )
