"""Fill-in-middle against a brute-force version, and back."""

import hashlib

from xpanel.llm import fill_in_middle

ODD = ["", None, "a", " ", "<P>", "ab <S", "x<M>y", "Hello, wörld\n\x00 a1 ẞ\U0001f600z", "<<P<S><", "a" * 300_000, "é, " * 100_000, "'; \\ $salt {key} <p>"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_fill_in_middle_equals_brute_force(spark):
    rows = [(i, ODD[i % len(ODD)], "k", "s") for i in range(12 * 17)] + [(None, "no id here", "k", "s"), (5, ODD[5], "k", "s"), (-3, "minus three", "k", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, seed string")
    want = sorted(((r[0], *fill_in_middle.brute_force(r[0], r[1])) for r in rows), key=str)
    made = fill_in_middle.fill_in_middle(docs)
    assert sorted((tuple(r) for r in made.collect()), key=str) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = sorted((tuple(r) for r in fill_in_middle.restore(made).collect()), key=str)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=str)
    got = sorted((tuple(r) for r in fill_in_middle.digest(docs).collect()), key=str)
    assert got == sorted(((r[0], *fill_in_middle.brute_force(r[0], r[1])[:4], sha(fill_in_middle.brute_force(r[0], r[1])[4]), sha(r[1] or "")) for r in rows), key=str)


def test_fill_in_middle_takes_any_names(spark):
    docs = spark.createDataFrame([("x", "some text of words", "c"), ("y", None, "c")], "`a.b` string, body string, output string")
    made = fill_in_middle.fill_in_middle(docs, "a.b", "body", changed=100)
    assert made.columns == ["a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(tuple(r) for r in fill_in_middle.restore(made, "a.b").collect()) == [("x", "some text of words"), ("y", "")]


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
