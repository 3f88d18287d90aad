import random
import re
from collections import Counter, defaultdict

import pytest

from sectorlake.llm import divergence
from tests.llm.fixtures import SCHEMA, odd_texts, words


def plain(rows, least=3, top=200):
    """All parts by the definition: every group's share of every kept term, pairs term by term."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        distance = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(distance(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(distance(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or k < top:
                        out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def made(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["src0", "src0", "src0", "a", "b", "", None, "é"])
        own = words(i, rng.randint(0, 30)) + words(1000 + rng.randint(0, 9), 12) + ["The"] * rng.randint(0, 5)
        out.append((i, " ".join(own), rng.choice(["en", "en", "fr", None, "", "日本"]), source, 0, 7, "b", 1, 2, "h", "k", "l", 3))
    return out


@pytest.mark.parametrize("bounds", [(8 << 20, 1 << 19), (400, 16)])
def test_audit_equals_the_definition(spark, monkeypatch, bounds):
    monkeypatch.setattr(divergence, "SLICE_BYTES", bounds[0])
    monkeypatch.setattr(divergence, "PAIRS", bounds[1])
    monkeypatch.setattr(divergence, "HELD", 2 * bounds[1])
    rows = made(150) + odd_texts() + [(None, "same words here", "en", "src0", 1, 7, "b", 1, 2, "h", "k", "l", 3)] * 40
    rows += [(900, "only once", "xx", s, 1, 7, "b", 1, 2, "h", "k", "l", 3) for s in ("p", "q", None)]  # a language without kept terms
    rows += [(901, t, "yy", s, 1, 7, "b", 1, 2, "h", "k", "l", 3) for s, t in (("p", "w w"), ("p", "w"), ("q", "w"), ("r", None), ("s", "12 34"))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(docs, top=7).collect())
    assert got == plain([(r[2], r[3], r[1]) for r in rows], top=7)


def test_small_batches_leave_runs_open(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = made(60, 5)
        docs = spark.createDataFrame(rows, SCHEMA)
        assert sorted(tuple(r) for r in divergence.audit(docs, least=2).collect()) == plain([(r[2], r[3], r[1]) for r in rows], least=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
