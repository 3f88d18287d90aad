import random
import zlib

import numpy as np

from sectorlake.llm import language_id
from tests.llm.fixtures import SCHEMA, odd_texts

SYLLABLES = {"en": "the ing and th er ou sh".split(), "de": "sch ung ein ich er en ü".split(), "fr": "eau é ai ment que la oi".split(), "日本": "日 本 語 の は を に".split()}


def text(lang, seed, n=30):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def row(i, t, lang):
    return (i, t, lang, "src0", len(t or ""), 7, "b", 1, 2, "h", "k", "l", 3)


def labelled(n, size=30):
    return [row(i, text(lang := list(SYLLABLES)[i % 4], i, size), lang) for i in range(n)]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def judged(spark, rows, model=None):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return language_id.identify(docs, model or language_id.fit(docs)).collect()


def test_held_out_accuracy_and_calibration(spark):
    rows = labelled(800, 3)
    got = {r["doc_id"]: r for r in judged(spark, rows)}
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    out = [(got[r[0]]["lang_pred"] == r[2], got[r[0]]["score"]) for r in rows if held(r[0])]
    accuracy = np.mean([ok for ok, _ in out])
    assert len(out) > 200 and accuracy > 0.97
    assert abs(accuracy - np.mean([s for _, s in out])) < 0.05


def test_weights_are_sparse_and_only_learning_folds_count(spark):
    rows = labelled(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs)
    assert model.languages == tuple(sorted(SYLLABLES)) and 0 < np.mean(model.weights != 0) < 0.1
    spoiled = [row(r[0], "nonsense of one kind " * 9, "xx") if held(r[0]) else r for r in rows] + [row(None, "eau eau eau " * 9, "en"), row(3000, None, "en"), row(3001, "the the", None)]
    again = language_id.fit(spark.createDataFrame(spoiled, SCHEMA))
    known = [r[1] for r in rows]
    assert again.languages == model.languages and np.allclose(model.predict(known)[1], again.predict(known)[1], atol=1e-9)
    assert language_id.fit(docs.repartition(7)).predict(known)[0] == model.predict(known)[0]


def test_odd_texts(spark):
    model = language_id.fit(spark.createDataFrame(labelled(200), SCHEMA))
    rows = odd_texts() + [row(50, "12 34 !!", "en"), row(51, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "en"), row(52, "\0", "en"), row(53, "DIE ÜBUNG", None)]
    got = judged(spark, rows, model)
    assert len(got) == len(rows)
    for r in got:
        t = dict((x[0], x[1]) for x in rows)[r["doc_id"]] if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), r
            assert (r["score"] == 0) == (r["lang_pred"] == "und")
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {True}


def test_one_language_none_and_empty(spark):
    one = judged(spark, [row(i, text("en", i), "en") for i in range(60)])
    assert {r["lang_pred"] for r in one} == {"en"} and all(r["score"] == 1 for r in one)
    none = judged(spark, [row(1, "some words", None), row(2, None, "en")])
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert judged(spark, []) == []


def test_slices_don_t_change_scores(spark, monkeypatch):
    model = language_id.fit(spark.createDataFrame(labelled(200), SCHEMA))
    rows = labelled(60)
    first = sorted(map(tuple, judged(spark, rows, model)))
    texts = [r[1] for r in rows]
    lang, score = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert lang == [a[0][0] for a in alone] and np.allclose(score, [a[1][0] for a in alone]) and lang == [r[2] for r in first]


def test_samples_are_bounded_and_copies_count_once(spark):
    rows = labelled(400) + [row(9000 + i, "the same text again and again", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    picked = language_id.training_texts(docs, rows=100, of_one=1000).collect()
    assert len({r["lang"] for r in picked}) == 4 and 50 < len(picked) < 160
    everything = language_id.training_texts(docs).collect()
    assert sum(r["text"] == "the same text again and again" for r in everything) == 1
    assert len({r["lang"] for r in language_id.training_texts(docs, languages=2).collect()}) == 2


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeéñß日.1") for _ in range(rng.randint(1, 9))) for _ in range(4000)), None, "", "x" * 5000, "a b " * 3000, "\n".join(["ab", "cd"] * 999)]

    def counts():
        found, letters = {}, np.zeros(len(texts), int)
        for bucket, text_, own in language_id._gram_batches(texts):
            letters += own
            for key in zip(text_.tolist(), bucket.tolist(), strict=True):
                found[key] = found.get(key, 0) + 1
        return found, letters.tolist()

    whole = counts()
    monkeypatch.setattr(language_id, "SLICE_CHARS", 700)
    assert counts() == whole and whole[1] == [sum(c.isalpha() for c in t or "") for t in texts]
