"""Language identification and quality: held-out accuracy, and odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import language, quality
from lumenfold.llm.common import fold_of

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, fold_of(F.col("doc_id"), 4) != 2)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold_of(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert {m[0] for m in model.pairs} == {"family", "germanic", "romance"}


def test_language_whole_text_in_blocks():
    text = "Das ist ein langer Text mit äöü. " * 400
    for h, g in zip(language.hashes_of(text), language.hashes_of(text)):
        assert (h == g).all()
    whole = sum(np.bincount(h, minlength=language.WIDTH) for h in language.hashes_of(text))
    parts = sum(np.bincount(h, minlength=language.WIDTH) for h in language.hashes_of(text, 1000))
    assert (whole == parts).all()


def test_language_vote_by_hand(spark):
    """The score of each text as a plain sum over its grams, one vote for each pair of classes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, fold_of(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    rows = docs.select("doc_id", "text").limit(30).collect()

    def winner(text, level, names):
        x = language.features_of(text)
        margin = {(a, b): float(x @ model.table[:, k]) + model.bias[k] for k, (at, a, b) in enumerate(model.pairs) if at == level}
        score = {g: (sum((m >= 0) == (g == a) for (a, b), m in margin.items() if g in (a, b)), sum(m if g == a else -m for (a, b), m in margin.items() if g in (a, b))) for g in names}
        return min(names, key=lambda g: (-score[g][0], -score[g][1], g))

    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            family = winner(r.text, "family", model.families)
            assert got[r.doc_id] == winner(r.text, family, [g for g in model.langs if model.family[g] == family])


def test_language_odd(spark, odd_docs, no_docs):
    learned = spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of with", "en"), (3, "words", None), (4, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(learned, F.lit(True))
    assert language.predict(no_docs, model).count() == 0
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd_docs, model).collect() if r.doc_id}
    assert got[3] == got[4] == got[7] == ("und", 0.0)
    assert got[1][0] == "en" and got[6][0] in ("de", "en")
    nothing = language.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in language.predict(odd_docs, nothing).collect()} == {"und"}
    one = language.fit(learned.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in language.predict(learned, one).collect()} == {"de", "und"}


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, fold_of(F.col("doc_id"), 3) != 1)
    got = quality.score(docs, model).join(labels, "doc_id").where(fold_of(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score(docs, model).where("score >= 0.5").count()


def test_quality_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality.Model(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    by_hand = []
    for row in x[:20]:
        logit = model.intercept + sum(t[(e <= v).sum()] for e, t, v in zip(model.edges, model.tables, row))
        logit += sum(t[(model.pair_edges[i] <= row[i]).sum(), (model.pair_edges[j] <= row[j]).sum()] for i, j, t in model.pairs)
        by_hand.append(1 / (1 + np.exp(-logit)))
    assert np.allclose(by_hand, model.score(x[:20]))


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels, F.lit(True))
    got = quality.score(odd_docs, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(no_docs, model).count() == 0
    empty = quality.fit(odd_docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(odd_docs, empty).collect()} == {0.5}
