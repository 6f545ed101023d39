"""Languages of held-out documents and of code-switched text."""

import numpy as np

from pagelake.llm.holdout import held_out
from pagelake.llm.language import features_of, fit_language_model, identified, learned_model, words_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identified(docs, learned_model(docs), keep=["lang"]).withColumn("held", held_out()).where("held").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98


def test_words_of_switched_text():
    english, french = "the cat and the dog were there with them".split(), "le chat et la chienne étaient avec nous".split()
    model = fit_language_model(["en"] * 40 + ["fr"] * 40, [english] * 40 + [french] * 40)
    words = english + french
    best = model.word_marginals(words, np.array([0, len(words)])).argmax(1)
    assert [model.languages[k] for k in best] == ["en"] * len(english) + ["fr"] * len(french)


def test_edge_cases(spark):
    rows = [(1, "the cat sat on the mat " * 5, "en"), (2, "le chat est sur la table " * 5, "fr"), (3, None, "en"), (4, "123 !?", "fr"), (5, "", None), (None, "the cat", "en"), (1, "the cat sat on the mat " * 5, "en"), (6, "the cat " * 30_000, None), (7, "² ³ 4", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = identified(docs, learned_model(docs), keep=["lang"], keep_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text)))
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in identified(docs, learned_model(docs.limit(0))).collect()} == {"und"}
    assert identified(docs.limit(0), None).collect() == []
    assert words_of("L'été 2020, ÜBER_alles") == ["l", "été", "über", "alles"]


def test_words_scored_together_score_as_their_features_do():
    windows = [["das", "haus", "straße", "über"], ["the", "house", "street", "over"], ["дом", "улица", "над", "дом"]] * 4
    model = fit_language_model(["de", "en", "ru"] * 4, windows)
    words = ["haus", "a", "дома", "x" * 300, "öß", "漢字", "\U00010400b", "streets", "\ud800", "the"]
    want = [sum((model.weights[model.features[f]] for f in [*features_of(w), "=" + w] if f in model.features), np.zeros(3)) for w in words]
    assert np.allclose(model.emissions(words), want)
    assert np.abs(want).sum() > 0
