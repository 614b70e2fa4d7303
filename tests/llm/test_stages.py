"""Stages on clashing and dotted names, scopes of intermediates, and the classifier's sample."""

import random

import numpy as np
from pyspark.sql import functions as F

from xpanel.llm import components, near_dedup, quality, shared, stages, substring_dedup

NAMES = ("kept", "n_removed", "text_", "a.b", "score", "rejected", "row", "c0", "h", "covers", "r", "k", "class_key", "spans")


def say(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))


def tables(spark, folder):
    r = random.Random(9)
    texts = [say(r, 90) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", texts[2].rsplit(" ", 40)[0] + " " + say(r, 60), None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in NAMES})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[5].split()[10:40]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = tables(spark, tmp_path)
    seen = docs
    for name, stage in stages.STAGES[:-1]:
        seen = shared.stored(stage(spark, seen, str(tmp_path)), "test")
        assert seen.columns == docs.columns, name
        assert all(r[c] == c for r in seen.collect() for c in NAMES), name
    left = {r.doc_id for r in seen.collect()}
    assert 5 not in left and len(left & {0, 12}) == 1 and len(left & {15, 16}) == 1
    assert {r.doc_id: (r.n_chars, len((r.text or "").split())) for r in seen.collect()}[14][1] == 60


def test_a_run_leaves_others_tables_alone(spark, tmp_path):
    tables(spark, tmp_path)
    mine = shared.stored(spark.range(5).toDF("x"), "mine")
    with shared.scope() as outer:
        held = shared.stored(spark.range(7).toDF("x"), "held")
        out = shared.finished(spark, "run", lambda: stages.run(spark, str(tmp_path)))
    assert len(outer) == 1 and mine.count() == 5 and held.count() == 7 and out.count() > 0  # the inner tables belonged to the inner scope
    shared.discard(spark, outer[:1])
    assert mine.count() == 5 and out.count() > 0


def test_sample_holds_at_any_size_and_with_copies(spark):
    r = random.Random(2)
    texts = [say(r, 8) for _ in range(40)]
    docs = spark.createDataFrame([(i, texts[i % 40] if i % 3 else texts[0]) for i in range(900)], "doc_id long, text string")
    few = [x.text for x in quality.sample(docs, 10).collect()]
    assert len(few) == len(set(few)) == 10
    assert sorted(few) == sorted(x.text for x in quality.sample(docs.union(docs).union(docs).repartition(5), 10).collect())
    assert sorted(x.text for x in quality.sample(docs, 10_000).collect()) == sorted(set(texts)) and quality.sample(docs.limit(0), 10).count() == 0


def test_label_model_maximises_the_likelihood():
    """EM against direct sums over classes: the likelihood of the patterns never falls, and posteriors are Bayes' rule."""
    r = np.random.default_rng(3)
    pattern = np.unique(r.integers(0, 3, (60, len(quality.LABELLERS))), axis=0)
    count = r.integers(1, 50, len(pattern))

    def joint(model, row):
        return [model["share"][c] * np.prod([model["table"][c, i, v] for i, v in enumerate(row)]) for c in range(len(model["share"]))]

    def likelihood(model):
        return sum(n * np.log(sum(joint(model, row))) for row, n in zip(pattern, count, strict=True))

    grown = [likelihood(quality.fit_label_model(pattern, count, rounds)) for rounds in (1, 3, 10, 60)]
    assert grown == sorted(grown)
    model = quality.fit_label_model(pattern, count)
    want = [1 - joint(model, row)[0] / sum(joint(model, row)) for row in pattern]
    assert np.allclose(quality.posterior(model, pattern), want)


def test_hub_of_many_copies_is_one_component(spark):
    edges = spark.range(1, 4000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(4000, 4010).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")))
    found = components.components(edges)
    assert found.count() == 4010 and found.select("component").distinct().count() == 1


def test_hub_of_near_copies(spark):
    r = random.Random(6)
    base = say(r, 200).split()
    near = [" ".join([*base[:i], "zz", *base[i + 1 :]]) for i in range(200)] * 5
    rows = [(i, t) for i, t in enumerate([" ".join(base), *near, say(r, 200)])]
    got = {x.doc_id: (x.class_id, x.class_size) for x in near_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(len(rows) - 1)} == {(0, len(rows) - 1)} and got[len(rows) - 1] == (len(rows) - 1, 1)


def test_short_items_are_found_as_whole_texts(spark):
    from xpanel.llm import decontaminate

    docs = spark.createDataFrame([(1, "Two  Words"), (2, "two words more"), (3, "one"), (4, "a b c d"), (5, None), (6, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two words"), (8, "ONE"), (9, ""), (10, "a b c d e")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.shared, r.item_size) for r in decontaminate.digest(docs, items).collect()) == [(1, 7, 1, 1), (3, 8, 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items, most_local=0).collect()) == [2, 4, 5, 6]


def test_removal_of_nothing_and_texts_without_repeats(spark):
    docs = spark.createDataFrame([(1, "a  b\tc", 9)], "doc_id long, text string, n_chars int")
    assert [tuple(r) for r in substring_dedup.remove(docs).collect()] == [(1, "a  b\tc", 9)] and substring_dedup.remove(docs.limit(0)).count() == 0
