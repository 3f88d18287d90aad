import hashlib
import random

import pytest

from sectorlake.llm import substring_dedup
from tests.llm.fixtures import SCHEMA, odd_texts, row, split, words


def brute(rows, window):
    """kept words by position in the order (doc_id, text); rows may repeat."""
    seen, out = {}, []
    for at, (_, text) in enumerate(rows):
        w = split(text)
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), (at, i))
    for at, (i_, text) in enumerate(rows):
        w = split(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] != (at, i):
                gone |= set(range(i, i + window))
        out.append((i_, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 22, 900])
def test_against_brute_force(spark, shard_bytes):
    rng = random.Random(shard_bytes)
    pieces = [words(300 + i, n) for i, n in enumerate([5, 19, 20, 21, 25, 40, 80])]
    rows = [r for r in odd_texts() if r[0] is not None]
    for i in range(120):
        parts = [rng.choice(pieces) if rng.random() < 0.6 else words(9000 + i, rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        rows.append(row(200 + i, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rows += [row(900 + i, "he said so " * 40) for i in range(4)] + [rows[-1]]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), shard_bytes=shard_bytes).collect()
    want = brute(sorted([(r[0], r[1]) for r in rows], key=lambda r: (r[0], r[1] or "")), 20)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r["n_removed"] == 0:
            assert r["text"] == (texts[r["doc_id"]] or "")
        assert hashlib.sha256(" ".join(split(r["text"])).encode()).hexdigest() == r["kept_sha256"]


def test_carried_columns_null_ids_and_empty(spark):
    text = " ".join(words(1, 50))
    rows = [row(None, text), row(3, text), row(None, None)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), carry=("lang", "hash", "n_chars"))
    assert got.columns == ["doc_id", "lang", "hash", "n_chars", "text", "n_words", "n_removed", "kept_sha256"]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["hash"]) for r in got.collect()) == [("3", 50, 0, "h"), ("None", 0, 0, "h"), ("None", 50, 50, "h")]
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_id_and_one_text_hold_most_rows(spark):
    """Rows are dealt by their number: neither null ids nor copies gather in a shard."""
    shared = words(5, 60)
    rows = [row(None, " ".join([*words(100 + i, 40), *shared])) for i in range(120)] + [row(7, " ".join(shared))] * 90 + [row(i, " ".join(words(i, 50))) for i in range(50)]
    rows += [row(None, rows[0][1])] * 40 + [row(8, "short text")] * 3
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), shard_bytes=3000).collect()
    order = sorted([(1 << 62 if r[0] is None else r[0], r[1]) for r in rows], key=lambda r: r[0])
    # Among null ids the order is by hash, so only what is certain is compared.
    certain = [r for r in brute(order, 20) if r[0] < 1 << 62]
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None) == sorted(certain)
    removed = sorted(r["n_removed"] for r in got if r["doc_id"] is None)
    assert removed[120:] == [100] * 40 and all(60 <= n < 70 for n in removed[:120])  # a word before may be shared by chance
