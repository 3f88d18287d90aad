import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sectorlake.llm import packing
from tests.llm.fixtures import SCHEMA, odd_texts
from tests.llm.test_words import thue_morse

ODD = ["a  b", "a \n b", "don't it's ''s", "x_y _x!! 12ab a1. é's", "<|endoftext|> hi there", "\x1c x y", "日本語。 日本 語", " lead and trail ", "a.\tb, c\r\nd ", "ok..., (so) [it] is"]


def test_ids_equal_the_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, ours = Tokenizer.from_file(path), packing.tokenizer(path)
    rng = random.Random(4)
    texts = ODD + [r[1] or "" for r in odd_texts()] + ["".join(rng.choice("ab'é .,!\n\t_1٣ 日👍-\u2003\x1c") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for _ in range(2):  # the second time from memory
        got = []
        for _, n, ids in ours.encode(pa.array(texts), 0):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_stream_is_cut_without_loss(spark):
    rows = odd_texts() + [(100 + i, t, *odd_texts()[0][2:]) for i, t in enumerate(ODD)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), window=64).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, pieces = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], ids))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
        assert at == 64 or s == len(sequences) - 1
    want = {}
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.setdefault((r[0], len(ids)), []).append(ids)
    assert {k: sum(len(i) for _, i in v) for k, v in pieces.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    single = [k for k, v in want.items() if len(v) == 1]
    assert all([x for _, i in sorted(pieces[k]) for x in i] == want[k][0] for k in single)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_hashes_are_not_taken_for_equal_units(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    word = thue_morse(2048)
    texts = ["x " + word + " " + word.translate(str.maketrans("ab", "ba")), "one two three one four", "", "tail  "]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(packing.W, "byte_spans", lambda values, starts, ends: (ends - starts).astype(np.uint64))
        got = []
        for _, n, ids in packing.UnitTokenizer(path).encode(pa.array(texts), 0):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
