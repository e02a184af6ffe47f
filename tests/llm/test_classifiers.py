"""The random field against enumeration of all labellings, and both classifiers on held-out rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from lamella.llm import lang_id, quality_classifier, quality_rules

SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["sch", "ung", "ü", "keit"], "cc": ["ción", "los", "que", "ar"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        lang = rng.choice(sorted(SYLLABLES))
        bad = rng.random() < 0.3
        text = sentence(rng, lang, rng.choice([30, 60, 200]))
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(f"{w}$$$ |" for w in text.split())
        rows.append((i, text, lang, f"src{i % 4}", len(text), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")


def test_posteriors_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(lang_id, "STEPS", 3)
    n = 3
    model = lang_id.Crf(list("abc"), np.zeros((4, n)), np.zeros(0, np.uint64), np.zeros((0, n)), np.eye(n), rng.normal(size=(n, n)))
    starts = np.array([0, 5, 5, 6, 13])
    e = rng.normal(size=(13, n)) * 3
    got = model.posteriors(e, starts)
    for a, b in itertools.pairwise(starts):
        total = np.zeros((b - a, n))
        for y in itertools.product(range(n), repeat=int(b - a)):
            w = np.exp(sum(e[a + i, k] for i, k in enumerate(y)) + sum(model.move[p, q] for p, q in itertools.pairwise(y)))
            for i, k in enumerate(y):
                total[i, k] += w
        if b > a:
            assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True), atol=1e-6)
    unary, pair = lang_id._expectations(model, e[:5], np.array([0, 5]))
    assert np.allclose(unary, got[:5], atol=1e-6) and abs(pair.sum() - 4) < 1e-6


def test_held_out_accuracy(spark, docs):
    model = lang_id.train(docs, per_lang=120)
    got = {r["doc_id"]: r for r in lang_id.predict(docs, model).collect()}
    rows = docs.select("doc_id", "lang", lang_id.held_out(docs["doc_id"]).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    aside = [r for r in rows if r["h"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in aside]) > 0.98
    rng = random.Random(1)
    mixed = sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 60)
    w = lang_id.word_features([mixed])
    word = model.posteriors(model.emissions(w), w.starts).argmax(axis=1)
    assert (word[:55] == 0).mean() > 0.9 and (word[65:] == 1).mean() > 0.9
    ((lang, score),) = model.label([mixed + " " + sentence(rng, "bb", 60)])
    assert lang == "bb" and 0.5 < score < 0.8


def test_language_of_hard_rows(spark, docs, hard):
    model = lang_id.train(docs, per_lang=20)
    got = lang_id.predict(hard, model).collect()
    assert len(got) == hard.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (1, 2, 3)) and all(0 <= r["score"] <= 1 for r in got)
    more = spark.createDataFrame([(1, "12 34 …— \U0001f600"), (2, "中文")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] != "und" for r in lang_id.predict(more, model).collect()} == {1: False, 2: True}
    empty = lang_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in lang_id.predict(hard, empty).collect()} == {"und"} and lang_id.predict(hard.limit(0), empty).count() == 0


def test_quality(spark, docs):
    labels = docs.where("doc_id % 3 = 0").select("doc_id", "quality")
    model = quality_classifier.train(docs, labels, max_labelled=250, max_pseudo=300)
    rows = {r["doc_id"]: r for r in quality_classifier.score(docs, model).collect()}
    unseen = [r for r in docs.collect() if r["doc_id"] % 3]
    good, bad = ([rows[r["doc_id"]] for r in unseen if r["quality"] == q] for q in (1, 0))
    assert np.mean([r["kept"] for r in good]) > 0.98 and np.mean([r["kept"] for r in bad]) < 0.05
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}


@pytest.mark.parametrize("signal", [1.0, 0.15])
def test_views_teach_each_other(signal):
    """Metadata that say everything lift a text view that has hardly any labels or says little."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    text = rng.normal(size=(600, quality_classifier.GRAMS)).astype(np.float32) * 0.05
    text[:, 0] += y * signal
    meta = np.zeros((600, quality_classifier.META), dtype=np.float32)
    meta[np.arange(600), y] = 1
    dense = np.zeros((600, len(quality_classifier.DENSE)), np.float32)
    right = []
    for rounds in (0, 1):
        trainer = quality_classifier.CoTrainer(text[:80], dense[:80], meta[:80], y[:80])
        trainer.fit()
        for _ in range(rounds):
            a, b = trainer.calibration(1)
            p = quality_classifier.sigmoid(a * trainer.odds(1, meta[80:400]) + b)
            sure = np.flatnonzero(abs(p - 0.5) > 0.2)
            trainer.tell(0, text[80:400][sure], dense[sure], meta[sure], (p[sure] > 0.5).astype(int))
            trainer.fit()
        model = trainer.model(0.005)
        p = model.scores(model.expand(text[400:], dense[400:]), meta[400:])
        right.append([((x > 0.5) == (y[400:] > 0)).mean() for x in p])
    assert right[1][1] > 0.95 and right[1][2] > 0.95
    assert right[1][0] > 0.95 if signal == 1.0 else right[1][0] > right[0][0] + 0.05


def test_repeated_ids_are_one_row(spark, docs, monkeypatch):
    """10,000 rows of one id: what comes to the driver is bounded by ids, and columns may have any names."""
    many = docs.unionByName(spark.range(10_000).selectExpr("0 doc_id", "concat('the ing and ', id) text", "'aa' lang", "'src0' source", "5L n_chars", "1 quality")).selectExpr("*", "1 _id", "2 _lang", "3 _y", "4 _q", "5 _rank", "6 odds0", "7 _lamella_row")
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []

    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (seen.append(len(rows)), rows)[1])(collect(self)))
    lang_id.train(many, per_lang=50)
    assert max(seen) <= 3 * 50
    seen.clear()
    labels = many.where("doc_id % 3 = 0").select("doc_id", "quality")
    quality_classifier.train(many, labels, max_labelled=200, max_pseudo=50)
    assert max(seen) <= 200
    seen.clear()
    assert len(quality_rules.labelled_statistics(many, labels, 100)) == 100 and max(seen) <= 100


def test_quality_of_hard_rows(spark, docs, hard):
    blank = quality_classifier.train(docs.limit(0), docs.limit(0).select("doc_id", "quality"))
    assert {r["kept"] for r in quality_classifier.score(hard, blank).collect()} == {True}
    model = quality_classifier.train(docs, docs.select("doc_id", "quality").where("doc_id < 200"), max_pseudo=50)
    assert quality_classifier.score(hard, model).count() == hard.count() and quality_classifier.keep_good(hard, model).columns == hard.columns
    assert quality_classifier.score(hard.limit(0), model).count() == 0
    bare = hard.selectExpr("doc_id", "text", "cast(null as string) source", "cast(null as string) lang", "cast(null as long) n_chars")
    assert quality_classifier.score(bare, model).count() == hard.count()
