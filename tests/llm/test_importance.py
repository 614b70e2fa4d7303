"""Importance resampling against a brute-force version."""

import random
import zlib

import numpy as np
import pyarrow as pa

from xpanel.llm import importance
from xpanel.llm.words import Words, folded


def texts():
    r = random.Random(8)
    words = ["The", "of", "naïve", "x9", "ça", "BIG", "a" * 70, "z" * 200, "q"] + ["".join(r.choices("abcdé", k=4)) for _ in range(60)]
    return [" ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 19, 20, 21, 80]))) for _ in range(160)] + [None, "", "  .-\x00 ", "a\x00b_c-D\x7fe f\tg\n", "the of " * 20_000, "ü" * 5000]


def test_crcs_of_words_and_runs():
    t = pa.array(texts())
    w = Words(folded(t, importance._FOLD))
    assert importance.word_crcs(w).tolist() == [zlib.crc32(x) for x in w.texts(0, len(w.start))]
    r = np.random.default_rng(1)
    for n in (0, 1, 64, 65, 66, 300, 100_003):
        a = r.bytes(9)
        b = r.bytes(n)
        assert importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)
    assert importance.word_crcs(Words(pa.array([], pa.string()))).tolist() == []


def check(spark, rows, target):
    docs = spark.createDataFrame([(*r, "w", 0.5) for r in rows], "doc_id long, text string, weight string, part double").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    want = sorted(importance.brute_force(rows, target), key=str)
    assert sorted((tuple(r) for r in importance.digest(docs, aim).collect()), key=str) == want
    return docs, aim, want


def test_resampling_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs, aim, want = check(spark, rows, [texts()[0], texts()[5], None, "unseen words here"])
    drawn = importance.resample(docs, aim)
    assert drawn.columns == ["doc_id", "text", "part", "weight", "score", "rank"]
    assert sorted((r.doc_id, r.rank) for r in drawn.collect()) == sorted((w[0], w[4]) for w in want if w[4])
    assert sum(w[4] is not None for w in want) >= 2


def test_repeated_rows_null_keys_and_many_salts(spark):
    long_ = " ".join(f"w{i}" for i in range(30))
    rows = [(7, long_)] * 60 + [(None, long_)] * 3 + [(8, "short")]
    check(spark, rows, [])
    docs = spark.createDataFrame([(i, f"a{i} b c " * 9) for i in range(1500)], "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame([("a1 b",)], "text string")
    few = importance.resample(docs, aim, per_salt=1).select("doc_id", "weight", "score", "rank").collect()
    assert sorted(few) == sorted(importance.resample(docs, aim).select("doc_id", "weight", "score", "rank").collect()) and len(few) == 75


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.digest(empty, empty.select("text")).collect() == []
