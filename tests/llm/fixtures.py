"""Small documents with every odd case, and brute-force helpers."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, bucket string, n int, shard int, hash string, key string, line string, `part` int"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(["the", "an", "er", "on", "re", "ti", "ou", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def row(doc_id, text):
    return (doc_id, text, "en", "src0", len(text or ""), 7, "b", 1, 2, "h", "k", "l", 3)


def odd_texts() -> list[tuple]:
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(2, 70)
    out = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"), (9, "one two"),
        (10, " ".join(words(3, 30) + passage + words(4, 30))), (11, "\n".join(words(5, 10) + passage + words(6, 10))),
        (12, "la " * 500), (13, " ".join(words(7, 20_000))), (14, "x" * 100_000), (15, "é ü 日本 ñ " * 12), (16, " ".join(base).upper()),
        (1, " ".join(base)), (None, "a null id and a text of its own that is long enough to matter"), (None, None), (17, "tail  of\x0bodd\x0cspace \r\n"),
    ]
    return [row(i, t) for i, t in out]


def split(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)
