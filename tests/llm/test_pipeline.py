"""The pipeline's stages one by one over a small corpus, each held against what it must do, and the registration."""

import random
from fractions import Fraction

import corpus_pipeline
from sectorlake.llm import queries
from tests.llm.fixtures import row, split, words
from tests.llm.test_decontamination import bare, greedy
from tests.llm.test_near_dedup import brute
from tests.llm.test_substring_dedup import brute as cut_brute


def corpus(spark, folder):
    rng = random.Random(0)
    rows, labels = [], []
    shared, item = words(1, 60), words(2, 30)
    for i in range(240):
        w = words(i + 10, rng.randint(30, 120))
        bad = i % 4 == 0
        if i % 10 == 1:
            w = w[:10] + shared + w[10:]
        if i % 30 == 2:
            w = w[:15] + item + w[15:]
        if i % 12 == 3 and rows:
            w = rows[i - 1][1].split()
            w[len(w) // 2] = "edited"
        rows.append(row(i, " ".join(x.upper() + "!!" for x in w) if bad and i % 12 != 3 else " ".join(w))[:5])
        labels.append((i, 0 if rows[-1][1].endswith("!!") else 1, 0))
    rows += [(1000, None, "en", "s", None), (1001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: q for i, q, _ in labels}


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    quality = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '-')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        seen.append(name)
        if name == "quality classifier":
            kept = {r["doc_id"] for r in after}
            assert all((i in kept) == bool(q) for i, q in quality.items())
        elif name == "MinHash near-dedup":
            roots = brute(before, 5, Fraction(8, 10))
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, root in roots.items() if i == root)
        elif name == "substring dedup":
            want = {i: (n, gone) for i, n, gone, _ in cut_brute(sorted(before), 20)}
            assert {r["doc_id"]: len(split(r["text"])) for r in after} == {i: n - gone for i, (n, gone) in want.items()}
            assert any(gone for _, gone in want.values())
            assert all(r["n_chars"] == len(r["text"]) for r in after if want[r["doc_id"]][1])
        elif name == "benchmark decontamination":
            item = bare(spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"])
            leaks = {i for i, t in before if sum(x[2] for x in greedy(item, bare(t), 5)) >= 0.8 * len(item)}
            assert leaks and sorted(r["doc_id"] for r in after) == sorted(i for i, _ in before if i not in leaks)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(seen) == 5
    whole = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert sum(r[2] for r in whole) == sum(r["length"] for r in after) and {r[0] for r in whole} == {r["doc_id"] for r in after}


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, log_bytes int, shard string, `row` int, rest string"


def odd_corpus(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(5)] if rows else []
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(None, None), (1, ""), (2, " ".join(words(55, 30))), (2, " ".join(words(55, 30)))] if rows else []
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    line = lambda i, t: (i, t, None, "s", None if t is None else len(t), "w", 5, "h", 6, "r")
    text, other, leak = " ".join(words(1, 80)), " ".join(words(2, 80)), " ".join(words(3, 9) + words(55, 30))
    rows = [line(1, text), line(1, text), line(1, other), line(None, None), line(None, None), line(None, text), line(2, ""), line(3, " \n "), line(None, leak), line(4, " ".join(words(4, 30_000))), line(5, "x" * 200_000)]
    odd_corpus(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        left[name] = sorted((str(r["doc_id"]), (r["text"] or "")[:12]) for r in docs.collect()) if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == [c.strip("` ").split()[0].strip("`") for c in SCHEMA.split(", ")]
            assert docs.where("n_words = 'w' and log_bytes = 5 and shard = 'h' and `row` = 6 and rest = 'r'").count() == docs.count()
    assert len(left["quality classifier"]) == len(rows)
    near = [("1", text[:12]), ("1", other[:12]), ("2", ""), ("3", " \n "), ("4", rows[9][1][:12]), ("5", "x" * 12), ("None", ""), ("None", leak[:12])]
    assert left["MinHash near-dedup"] == sorted(near) == left["substring dedup"]
    assert left["benchmark decontamination"] == sorted(n for n in near if n[1] != leak[:12])
    assert {str(r["doc_id"]) for r in left["packing"]} == {"1", "2", "3", "4", "5", "None"}


def test_empty_tables(spark, tmp_path):
    odd_corpus(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in names if n.startswith("op")] == list(queries.QUERIES)
    assert len(queries.QUERIES) == 13 and set(queries.ORACLES) <= set(queries.QUERIES)
