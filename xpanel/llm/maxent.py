"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class after the tokens before it, times its own within the class. Classes are the most
frequent tokens, each by itself, and ranges of the first two bytes of all other words, of equal mass; so every word has a class,
seen or not. A class is drawn by a softmax over the weights of hashed features: the token before (n-gram), the classes of the two
before (n-gram), and the class three before (skip). Within a class a seen word has (c + 1) of the class's mass and all unseen ones
together 1, so probabilities add up to one.

Tasks pack a block of texts, once, into a row: its different words by frequency with their counts in the training documents, and
its tokens as their numbers. These rows are written and read a few at a time. Counts of all words come from one exchange of
blocks' different words by word, so that no word has more rows than there are blocks. Weights are trained by distributed gradient updates: in each of STEPS steps the training documents of that
step are read, every task sums the observed and expected counts of features by class, sparsely by hashed row, a shuffle by row adds
them up, and each weight moves by its gradient (observed less expected) over the geometric mean of both counts. Every training
document is used in one step. The model (ROWS x CLASSES weights, 65,536 ranges) has the same size for every input and is sent to
the tasks; whatever grows with the corpus is shuffled. Texts are scored block by block with the blocks' own counts.

A null text counts as empty: it has one token, the end. Documents are told apart by their rows, whatever their ids; a null
id is not held out. Equal texts have equal scores. Without training documents every count is 0, the base score is 0 and all classes are
alike. Words are told apart by 64-bit hashes. Columns other than those carried and the text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .words import U, Words, folded, groups, mix

CLASSES, HEADS = 48, 24
BITS = 13
ROWS = 1 << BITS
STEPS = 4
RATE, PRIOR = 0.5, 5.0
_BLOCK = 1 << 23  # bytes of text packed into a row
_CHUNK = 1 << 13  # tokens whose class probabilities are held at a time
_PIECE = 16 * _CHUNK  # tokens whose features are held at a time
_ROWS = 4  # packed rows that a writer or reader of their table holds at a time
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
END = U(0)  # the token that ends a text; no word has this hash


class Model:
    """Classes of words, their masses, and the weights of hashed features by class."""

    def __init__(self, heads: np.ndarray, head_counts: np.ndarray, begins: np.ndarray, counts: np.ndarray, words: np.ndarray):
        """heads: hashes of the most frequent tokens; counts and words: of each of 65,536 beginnings, without the heads, all counts and different words."""
        order = np.argsort(heads)
        self.heads, self.head_class = heads[order], order.astype(np.int64)
        before = np.cumsum(counts) - counts / 2
        share = before / max(1, counts.sum())
        self.range = HEADS + np.minimum((share * (CLASSES - HEADS)).astype(np.int64), CLASSES - HEADS - 1)
        seen = np.bincount(self.range, counts, CLASSES)
        self.mass = seen + np.bincount(self.range, words, CLASSES) + 1.0
        seen[: len(heads)] = head_counts
        self.mass[: len(heads)] = head_counts + 1.0
        self.bias = np.log(seen + 1.0)
        self.bias[len(heads) : HEADS] = -100.0  # classes of no token
        self.bias = (self.bias - self.bias.max()).astype(np.float32)
        self.weights = np.zeros((ROWS, CLASSES), np.float32)
        self.n, self.v = int(counts.sum() + head_counts.sum()), int(words.sum() + len(heads))

    def classes(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out = self.range[begins]
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, words), len(self.heads) - 1)
            mine = self.heads[at] == words
            out[mine] = self.head_class[at[mine]]
        return out

    def features(self, words: np.ndarray, kind: np.ndarray, token: np.ndarray, place: np.ndarray, at: np.ndarray | None = None) -> list[np.ndarray]:
        """The hashed row of each feature of every token, or of those at the positions given. place: tokens before it in its text."""
        at = np.arange(len(token)) if at is None else at
        first = place[at]

        def before(x: np.ndarray, k: int, none: np.generic) -> np.ndarray:
            return np.where(first < k, none, x[token[np.maximum(at - k, 0)]])

        y1, y2, y3 = (before(kind, k, np.int64(CLASSES)) for k in (1, 2, 3))
        pair = _row(np.arange((CLASSES + 1) ** 2).astype(U), 2)
        skip = _row(np.arange(CLASSES + 1).astype(U), 3)
        return [_row(before(words, 1, U(0x5BD1E995)), 1), pair[y1 * (CLASSES + 1) + y2], skip[y3]]

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        s = self.bias + self.weights[rows[0]]
        for r in rows[1:]:
            s += self.weights[r]
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def update(self, row: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        """One step along the gradient, each weight on the scale of its counts."""
        self.weights[row] += (RATE * (observed - expected) / np.sqrt((observed + PRIOR) * (expected + PRIOR))).astype(np.float32)


def _row(x: np.ndarray, template: int) -> np.ndarray:
    return (mix(x * U(0x9E3779B97F4A7C15) + U(template)) >> U(64 - BITS)).astype(np.int64)


class _Tokens:
    """The tokens of a block: local numbers of different words, the most frequent first."""

    def __init__(self, texts: pa.Array):
        w = Words(folded(texts, _SMALL))
        h = w.hashes()
        h[h == END] = U(1)
        many = np.diff(w.at) + 1
        at = np.r_[0, np.cumsum(many)]
        inner = np.ones(int(at[-1]), bool)
        inner[at[1:] - 1] = False
        all_, begin = np.full(len(inner), END, U), np.zeros(len(inner), np.uint16)
        all_[inner] = h
        second = np.where(w.end - w.start > 1, w.data[np.minimum(w.start + 1, max(0, len(w.data) - 1))] if len(w.data) else 0, 0)
        begin[inner] = w.data[w.start].astype(np.uint16) * np.uint16(256) + second.astype(np.uint16)
        key, first, back, count = np.unique(all_, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.begins, self.token, self.many = key[order], begin[first[order]], rank[back], many


def _packed(row: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.struct([("row", row), ("held_out", pa.bool_()), ("step", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in groups(batch, "text", _BLOCK):
                t = _Tokens(part["text"])
                used = np.repeat(~part["held_out"].to_numpy(zero_copy_only=False).astype(bool), t.many)
                trained = np.bincount(t.token[used], minlength=len(t.words))
                docs = pa.StructArray.from_arrays([part["row"], part["held_out"], part["step"], pa.array(t.many)], fields=list(kind))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), one(docs), one(pa.array(t.words.view(np.int64))), one(pa.array(t.begins.astype(np.int32))), one(pa.array(trained.astype(np.int32))), pa.array([(t.token & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([(t.token >> 16).astype("<u2").tobytes()], pa.binary())],
                    names=["block", "docs", "words", "begins", "trained", "low", "high"],
                )
                block += 1

    return run


class _Block:
    """A packed row."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        column = lambda name: batch[name][i].values
        self.words, self.begins = column("words").to_numpy().view(U), column("begins").to_numpy().astype(np.int64)
        self.docs = column("docs")
        self.token = _unpacked(batch["low"][i].as_py(), batch["high"][i].as_py())
        self.many = self.docs.field("n").to_numpy()
        self.doc = np.repeat(np.arange(len(self.many), dtype=np.int32), self.many)
        self.place = np.arange(len(self.token), dtype=np.int32) - np.repeat((np.cumsum(self.many) - self.many).astype(np.int32), self.many)


def _unpacked(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int32) + (np.frombuffer(high, "<u2").astype(np.int32) << 16)


def _gradients(model: Model, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Observed and expected counts of each hashed row by class, over the training documents of a step; as shares of n in half precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        observed, expected = np.zeros((ROWS, CLASSES)), np.zeros((ROWS, CLASSES))
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i)
                mine = (b.docs.field("step").to_numpy() == step) & ~b.docs.field("held_out").to_numpy(zero_copy_only=False)
                at = np.flatnonzero(mine[b.doc])
                kind = model.classes(b.words, b.begins)
                for j in range(0, len(at), _PIECE):
                    mine = at[j : j + _PIECE]
                    y, rows = kind[b.token[mine]], model.features(b.words, kind, b.token, b.place, mine)
                    for k in range(0, len(mine), _CHUNK):
                        here = [r[k : k + _CHUNK] for r in rows]
                        p = model.probabilities(here)
                        for r in here:
                            order = np.argsort(r.astype(np.uint16), kind="stable")
                            sorted_ = r[order]
                            cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                            expected[sorted_[cut]] += np.add.reduceat(p[order], cut)
                    for r in rows:
                        observed += np.bincount(r * CLASSES + y, minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)
        n = observed.sum(1)
        some = np.flatnonzero(n)
        share = (np.concatenate([observed[some], expected[some]], axis=1) / n[some, None]).astype("<f2")
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array([x.tobytes() for x in share], pa.binary())], names=["row", "n", "shares"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the rows dealt to a task, added up."""
    row, total = np.zeros(0, np.int64), np.zeros((0, 2 * CLASSES))
    for batch in batches:
        more = np.frombuffer(b"".join(batch["shares"].to_pylist()), "<f2").reshape(-1, 2 * CLASSES).astype(np.float64) * batch["n"].to_numpy()[:, None]
        row, where = np.unique(np.r_[row, batch["row"].to_numpy()], return_inverse=True)
        both = np.zeros((len(row), 2 * CLASSES))
        np.add.at(both, where, np.concatenate([total, more]))
        total = both
    yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array([x.astype("<f4").tobytes() for x in total], pa.binary())], names=["row", "counts"])


def _class_scores(model: Model, row: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document the logarithms of its classes' probabilities, less those of their masses, beside its tokens."""
    kind = pa.struct([("row", row), ("held_out", pa.bool_()), ("n", pa.int64()), ("score", pa.float64())])
    mass = np.log10(model.mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i)
                classes = model.classes(b.words, b.begins)
                log = np.empty(len(b.token))
                for k in range(0, len(log), _CHUNK):
                    at = np.arange(k, min(k + _CHUNK, len(log)))
                    y = classes[b.token[at]]
                    p = model.probabilities(model.features(b.words, classes, b.token, b.place, at))
                    log[at] = np.log10(np.maximum(p[np.arange(len(p)), y], 1e-30)) - mass[y]
                score = np.bincount(b.doc, log, len(b.many))
                docs = pa.StructArray.from_arrays([b.docs.field("row"), b.docs.field("held_out"), b.docs.field("n"), pa.array(score)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch["block"][i : i + 1], pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), batch["low"][i : i + 1], batch["high"][i : i + 1]], names=["block", "docs", "low", "high"])

    return run


def _scores(n: int, v: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's documents with what their words' counts add."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for i in range(left.num_rows):  # one
            docs, token = left["docs"][i].values, _unpacked(left["low"][i].as_py(), left["high"][i].as_py())
            count = np.zeros(int(token.max(initial=-1)) + 1, np.int64)
            count[right["word_at"].to_numpy()] = right["c"].to_numpy()
            many = docs.field("n").to_numpy()
            doc = np.repeat(np.arange(len(many)), many)
            own = np.bincount(doc, np.log10(count + 1.0)[token], len(many))
            known = np.bincount(doc, (count > 0)[token], len(many)).astype(np.int64)
            columns = [docs.field("row"), docs.field("held_out"), pa.array(many), pa.array(known), pa.array(np.full(len(many), n)), pa.array(own - many * math.log10(n + v + 1)), pa.array(docs.field("score").to_numpy() + own)]
            found.append(pa.Table.from_arrays(columns, names=["row", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(found) if found else _NONE

    return run


_NONE = pa.table({"row": pa.nulls(0), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})


def _model(counted: DataFrame) -> Model:
    """The classes, from the counts of all words; 65,536 beginnings and HEADS words come to the driver."""
    seen = counted.filter("word is not null")
    top = seen.orderBy(F.desc("c"), "word").limit(HEADS).select("word", "c", "begin").toArrow()
    sums = seen.groupBy("begin").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    counts, words = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    counts[sums["begin"].to_numpy()], words[sums["begin"].to_numpy()] = sums["c"].to_numpy(), sums["n"].to_numpy()
    np.subtract.at(counts, top["begin"].to_numpy(), top["c"].to_numpy())
    np.subtract.at(words, top["begin"].to_numpy(), 1)
    return Model(top["word"].to_numpy().astype(np.int64).view(U), top["c"].to_numpy().astype(np.int64), np.arange(1 << 16), counts, words)


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of texts, and the count in training documents of every different word of every block. rows: row, held_out, step, text."""
    kind = rows.schema["row"].dataType.simpleString()
    arrow = rows.select("row").limit(0).toArrow().schema.field(0).type
    columns = f"block long, docs array<struct<row:{kind},held_out:boolean,step:int,n:long>>, words array<long>, begins array<int>, trained array<int>, low binary, high binary"
    blocks = stored(rows.mapInArrow(_packed(arrow), columns), "blocks", _ROWS)
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "begins", "trained")).alias("word_at", "x")).select("block", "word_at", F.col("x.words").alias("word"), F.col("x.begins").alias("begin"), F.col("x.trained").alias("n"))
    by_word = Window.partitionBy("word")  # a row for each block at most
    known = each.withColumns({"c": F.sum("n").over(by_word), "first": F.min("block").over(by_word)}).filter("c > 0")
    return blocks, stored(known.select("block", "word_at", "c", "begin", F.when(F.col("first") == F.col("block"), F.col("word")).alias("word")), "counts")


def _trained(blocks: DataFrame, counted: DataFrame) -> Model:
    model = _model(counted)
    for step in range(STEPS):
        sums = blocks.select("block", "docs", "words", "begins", "low", "high").mapInArrow(_gradients(model, step), "row int, n double, shares binary")
        found = sums.repartition("row").mapInArrow(_summed, "row int, counts binary").toArrow()  # ROWS rows at most
        counts = np.frombuffer(b"".join(found["counts"].to_pylist()), "<f4").reshape(-1, 2 * CLASSES).astype(np.float64)
        model.update(found["row"].to_numpy(), counts[:, :CLASSES], counts[:, CLASSES:])
    return model


def _rows(docs: DataFrame, carry: list[str], held_out: str, key: str, text: str) -> DataFrame:
    crc = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).alias("row")
    return docs.select(row, F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), F.coalesce(F.pmod(F.floor(crc / 7), F.lit(STEPS)), F.lit(0)).cast("int").alias("step"), F.col(f"`{text}`").cast("string").alias("text"))


def score(docs: DataFrame, carry: list[str], held_out: str = "false", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The carried columns with held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out: a condition on the columns; rows that meet it are scored and not learned from. Of carried columns with the names of
    made ones, the made ones stay.
    """
    rows = _rows(docs, carry, held_out, key, text)
    blocks, counted = _prepared(rows)
    model = _trained(blocks, counted)
    kind = rows.schema["row"].dataType.simpleString()
    arrow = rows.select("row").limit(0).toArrow().schema.field(0).type
    left = blocks.mapInArrow(_class_scores(model, arrow), f"block long, docs array<struct<row:{kind},held_out:boolean,n:long,score:double>>, low binary, high binary")
    right = counted.select("block", "word_at", "c")
    made = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    out = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_scores(model.n, model.v), f"row {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(carry) if c not in made), *made)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id with its scores; documents whose crc32(doc_id) mod 7 is 2 are held out."""
    return score(docs, ["doc_id"], "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")


def brute_base(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score of each document, for tests."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), c.total(), sum(math.log10((c[w] + 1) / (c.total() + len(c) + 1)) for w in t)) for (i, _), t, h in zip(docs, tokens, held, strict=True)]
