"""The language model: its base columns against brute force, its probabilities' sum, its gradient, and what it learns."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from xpanel.llm import maxent
from xpanel.llm.words import U


def texts(n=200):
    r = random.Random(4)
    tongues = [["the", "of", "And", "thing", "shore"], ["die", "und", "ver", "ein", "zwei"], ["ñu", "éa", "ço", "lês", "pâ"]]
    made = []
    for _ in range(n):
        words = r.choice(tongues)
        made.append(" ".join(r.choice(words) + ("" if r.random() < 0.7 else r.choice("abcde") * r.randint(1, 3)) for _ in range(r.choice([1, 5, 60, 200]))))
    return [*made, "", None, " \t", "one\x0btwo\x00 x", "the " * 50_000, "y" * 70_000]


def test_base_scores_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, texts()[3]), (3, "other text")]
    docs = spark.createDataFrame([(*r, 9, 0.1) for r in rows], "doc_id long, text string, n_known long, row double").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in maxent.digest(docs).collect()), key=str)
    want = sorted(maxent.brute_base(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    held = [g for g in got if g[1] and g[2] < 300]
    assert len(held) > 10 and sum(g[6] for g in held) > sum(g[5] for g in held) + 0.1 * sum(g[2] for g in held)
    carried = maxent.score(docs, ["n_known", "row", "doc_id"])
    assert carried.columns == ["row", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert carried.filter("held_out").count() == 0 and carried.count() == len(rows)


def fitted():
    t = maxent._Tokens(pa.array(texts(60)))
    c = np.bincount(t.token)
    order = np.argsort(-c, kind="stable")[: maxent.HEADS]
    rest = np.setdiff1d(np.arange(len(c)), order)
    counts, words = np.bincount(t.begins[rest], c[rest], 1 << 16), np.bincount(t.begins[rest], minlength=1 << 16)
    return maxent.Model(t.words[order], c[order], np.arange(1 << 16), counts.astype(np.int64), words), t, c


def test_probabilities_add_up_to_one():
    model, t, c = fitted()
    model.weights[:] = np.random.default_rng(2).normal(size=model.weights.shape)
    kind = model.classes(t.words, t.begins)
    place = np.concatenate([np.arange(n) for n in t.many])
    p = model.probabilities([r[:50] for r in model.features(t.words, kind, t.token, place)])
    inside = np.bincount(kind, c + 1.0, maxent.CLASSES) / model.mass
    unseen = np.r_[np.zeros(len(model.heads)), 1 / model.mass[len(model.heads) :]]
    assert np.allclose(p.sum(1), 1, atol=1e-5) and np.allclose(p @ (inside + unseen), 1, atol=1e-5)


def test_step_follows_the_gradient():
    model, t, _ = fitted()
    kind = model.classes(t.words, t.begins)
    place = np.concatenate([np.arange(n) for n in t.many])
    rows, y = [r[:3000] for r in model.features(t.words, kind, t.token, place)], kind[t.token][:3000]

    def loss():
        return float(np.log(model.probabilities(rows)[np.arange(3000), y]).sum())

    p = model.probabilities(rows).astype(float)
    hot = np.eye(maxent.CLASSES)[y]
    gradient, observed = np.zeros((maxent.ROWS, maxent.CLASSES)), np.zeros((maxent.ROWS, maxent.CLASSES))
    for r in rows:
        np.add.at(gradient, r, hot - p)
        np.add.at(observed, r, hot)
    at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
    before = loss()
    model.weights[at] += 0.01
    assert (loss() - before) / 0.01 == pytest.approx(gradient[at], rel=0.05)
    model.weights[at] -= 0.01
    some = np.flatnonzero(observed.sum(1))
    model.update(some, observed[some], (observed - gradient)[some])
    assert loss() > before + 100


def test_packed_rows_are_written_and_read_a_few_at_a_time(spark):
    docs = spark.range(0, 100_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))  # ten batches, so ten rows of one file
    blocks, _ = maxent._prepared(maxent._rows(docs, ["doc_id"], "false", "doc_id", "text"))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    held = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(held) == 10 and max(held) <= maxent._ROWS


def test_pieces_of_a_long_text_have_the_features_of_the_whole(spark):
    r = random.Random(7)
    text = " ".join(r.choice(["the", "of", "and", "thing", "shore", "boat", "x"]) for _ in range(2 * maxent._PIECE + 9))
    rows = maxent._rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], "false", "doc_id", "text")
    blocks, _ = maxent._prepared(rows)
    model, _, _ = fitted()
    t = maxent._Tokens(pa.array([text]))
    whole = model.features(t.words, model.classes(t.words, t.begins), t.token, np.arange(len(t.token)))
    some = np.arange(5, len(t.token), 7)
    at = model.features(t.words, model.classes(t.words, t.begins), t.token, np.arange(len(t.token)), some)
    assert all((x[some] == y).all() for x, y in zip(whole, at, strict=True))
    got = blocks.mapInArrow(maxent._gradients(model, rows.first().step), "row int, n double, shares binary").collect()
    want = np.bincount(np.concatenate(whole), minlength=maxent.ROWS)
    assert {g.row: g.n for g in got} == {i: want[i] for i in np.flatnonzero(want)}


def test_layout_does_not_matter(spark):
    docs = spark.createDataFrame(list(enumerate(texts(80)[:90])), "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in maxent.digest(docs.repartition(n)).collect()} for n in (1, 7))
    assert all(abs(one[k] - many[k]) < 1e-2 * abs(one[k]) for k in one)


def test_scores_of_nothing_and_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert maxent.digest(empty).collect() == []
    r = maxent.score(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), ["doc_id"], "true").collect()
    assert [(x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in r] == [(True, 3, 0, 0, 0.0)]
    assert U(0) == maxent.END
