"""Word labels of code-switched text, and held-out accuracy on given tables."""

import random

from xpanel.llm import language_id


def test_words_of_switched_text_are_labelled(spark):
    r = random.Random(2)
    tongues = {"x": ["the", "of", "thing", "shore", "wharf", "hither"], "y": ["ñu", "éçala", "lêsça", "pâté", "où", "çéda"]}
    rows = [(i, " ".join(r.choices(words, k=60)), lang, "en") for i, (lang, words) in enumerate(list(tongues.items()) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, word string")
    model = language_id.train(docs)
    mixed = spark.createDataFrame([(1, "the of thing 12 éçala-lêsça pâté où, shore wharf hither the"), (1, "çéda"), (2, None), (3, " 12 !"), (4, "")], "doc_id long, text string")
    got = sorted((x.doc_id, x.place, x.word, x.lang) for x in language_id.label_words(mixed, model).collect() if x.word != "çéda")
    assert [g[2] for g in got] == ["the", "of", "thing", "éçala", "lêsça", "pâté", "où", "shore", "wharf", "hither", "the"]
    assert [g[3] for g in got] == ["x"] * 3 + ["y"] * 4 + ["x"] * 4 and [g[1] for g in got] == list(range(11))
    every = language_id.label_words(mixed, model).collect()
    assert len(every) == 12 and all(0.5 < x.score <= 1 for x in every)
    assert language_id.label_words(mixed, None).count() == 0 and language_id.label_words(mixed.limit(0), model).count() == 0
    clash = mixed.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "word")
    assert language_id.label_words(clash, model, "a.b", "word").columns == ["a.b", "place", "word", "lang", "score"]


def test_held_out_accuracy_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = language_id.digest(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert len(got) > 150 and sum(x.lang_pred == x.lang for x in got) >= 0.97 * len(got)
