"""Quality classifier by weak labels: EM over heuristic labellers, then a hashed linear scorer.

Labellers look at whole texts and vote reject (2), keep (1) or abstain (0): capitals, exclamation, symbols,
bars, stuttered words, and words of a lexicon. The lexicon holds word beginnings of 4 to 8 bytes that,
in one, two or three different words, and whole words of fewer bytes that `labels` shows almost only in toxic texts of a
bounded sample (`most_labels` rows): in 4 or more, and in 25 for each other text. Different texts are counted, each
toxic if most of its labels say so, so copies add nothing. All such entries are kept. The label model has
one latent class that keeps and one for each kind of fault, with a table of vote probabilities per labeller; EM
runs over the counts of vote patterns of all documents (at most 3 to the number of labellers rows, whatever the input). Its posteriors label
a bounded sample (the `most_rows` different texts of the smallest hashes), on which a logistic scorer over hashed beginnings and shapes of
words is fitted; the votes are not among its features, so it judges texts by what it learned. Every whole text is then
scored; a document is rejected at a score of `cut` or more.

Null texts count as empty; an empty text gets all abstentions and is kept. Rows with null or repeated doc_id
are scored by text. Labels with nulls are not used, and no labels at all leave the lexicon empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, Words, groups, mix, span_hashes

LABELLERS = ("capitals", "exclamation", "symbols", "bars", "stutter", "lexicon", "lexicon_density")
FAULTS = ((0, 1), (2,), (3,), (4,), (5, 6))  # labellers by the fault they look for
BITS = 18
WIDTH = 1 << BITS
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = 3  # an entry may ask for so many different words with its beginning
_UPPER, _LETTER, _SYMBOL = np.zeros(256, np.int8), np.zeros(256, np.int8), np.zeros(256, np.int8)
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_SYMBOL[[ord(c) for c in "#$%&*"]] = 1


def _beginnings(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the words of at least so many bytes, and the hashes of their beginnings; shorter words are taken whole."""
    h, at, done = np.zeros(len(w.start), U), np.arange(len(w.start)), 0
    for k in (*range(1, PREFIXES[0]), *PREFIXES):
        enough = w.end[at] - w.start[at] >= k
        h, at = h[enough], at[enough]
        for i in range(done, k):
            h = h * U(0x100000001B3) + w.data[w.start[at] + i].astype(U) + U(1)
        done = k
        whole = w.end[at] - w.start[at] == k if k < PREFIXES[0] else slice(None)
        yield at[whole], mix(h[whole] + U(k))


def _entries(word: np.ndarray, beginning: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, beginning) pairs with the number of their different words, and each row's pair."""
    order = np.lexsort((word, beginning, doc))
    b, d, x = beginning[order], doc[order], word[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (d[1:] != d[:-1])] if len(b) else np.zeros(0, bool)
    fresh = new | np.r_[True, x[1:] != x[:-1]][: len(b)]
    pair = np.cumsum(new) - 1
    where = np.empty(len(b), np.int64)
    where[order] = pair
    return np.flatnonzero(new), np.bincount(pair, fresh).astype(np.int64), np.stack([where, order]) if len(b) else np.zeros((2, 0), np.int64)


class Lexicon:
    """Entries (beginning, level) that mark a document; a bitmap passes over most words."""

    def __init__(self, beginning: np.ndarray, level: np.ndarray):
        self.code = np.sort(mix(beginning + level.astype(U)))
        self.map = np.zeros(1 << 20, bool)
        self.map[beginning >> U(44)] = True

    def hits(self, w: Words, h: np.ndarray) -> np.ndarray:
        """Whether each word is covered by an entry that holds in its document."""
        out = np.zeros(len(h), bool)
        if not len(self.code) or not len(h):
            return out
        maybe = [(at[m], b[m]) for at, b in _beginnings(w) for m in [self.map[b >> U(44)]]]
        at, b = (np.concatenate(x) for x in zip(*maybe, strict=True))
        if len(at):
            doc = np.searchsorted(w.at, at, "right") - 1
            _, many, (where, _) = _entries(h[at], b, doc)
            for level in range(1, LEVELS + 1):
                code = mix(b + U(level))
                known = self.code[np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)] == code
                out[at[known & (many[where] >= level)]] = True
        return out


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[at[1:]] - total[at[:-1]]


def _vote(x: np.ndarray, keep_below: float, reject_from: float, some: np.ndarray) -> np.ndarray:
    return np.where(some, np.where(x >= reject_from, 2, np.where(x < keep_below, 1, 0)), 0)


def votes(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, Words, np.ndarray]:
    """texts x labellers; and the lower-cased words with their hashes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = Words(texts)
    n = np.diff(raw.at)
    some, per = n > 0, np.maximum(n, 1)
    byte_at = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))]
    count = lambda table: _sums(table[raw.data], byte_at)
    bang, bar = np.zeros(256, np.int8), np.zeros(256, np.int8)
    bang[ord("!")] = bar[ord("|")] = 1
    w = Words(pc.utf8_lower(texts))
    h = w.hashes()
    same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
    first = w.at[:-1][np.diff(w.at) > 0]
    same[first] = False
    hit = _sums(lexicon.hits(w, h), w.at)
    letters = count(_LETTER)
    table = np.stack([
        _vote(count(_UPPER) / np.maximum(letters, 1), 0.3, 0.5, letters >= 20),
        _vote(count(bang) / per, 0.1, 0.3, some),
        _vote(count(_SYMBOL) / per, 0.1, 0.3, some),
        _vote(count(bar) / per, 0.1, 0.3, some),
        _vote(_sums(same, w.at) / per, 0.1, 0.3, n >= 10),
        np.where(hit > 0, 2, 1) * some,
        _vote(hit / per, 0.0002, 0.004, some),
    ], axis=1)
    return table.astype(np.int64), w, h


def _code(table: np.ndarray) -> np.ndarray:
    return table @ (3 ** np.arange(table.shape[1]))


def _decode(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit_label_model(pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> dict[str, np.ndarray]:
    """EM over vote patterns (rows of 0, 1, 2) and their counts.

    Latent classes: class 0 keeps; every other one rejects for one kind of fault, at first by its own labellers'
    votes. Returns the classes' shares and table[class, labeller, vote], the labellers' estimated accuracies;
    an abstention tells nothing, so its entries are 1.
    """
    share = np.r_[0.8, np.full(len(FAULTS), 0.2 / len(FAULTS))]
    table = np.empty((len(share), pattern.shape[1], 3))
    table[:] = (1, 0.99, 0.01)
    for c, own in enumerate(FAULTS, 1):
        table[c, list(own)] = (1, 0.2, 0.8)
    belief = table[:, :, 1:] * 2  # pseudo-counts, so that rare faults keep their meaning
    hot = np.eye(3)[pattern][:, :, 1:]
    for _ in range(rounds):
        p = _classes({"share": share, "table": table}, pattern) * count[:, None]
        seen = np.einsum("pc,plv->clv", p, hot) + belief
        table[:, :, 1:] = seen / seen.sum(2, keepdims=True)
        share = (p.sum(0) + 1e-3) / (p.sum() + 1e-3 * len(share))
    return {"share": share, "table": table}


def _classes(model: dict, pattern: np.ndarray) -> np.ndarray:
    label = np.arange(pattern.shape[1])
    odds = np.log(model["share"]) + np.log(model["table"])[:, label, pattern].sum(2).T
    p = np.exp(odds - odds.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def posterior(model: dict, pattern: np.ndarray) -> np.ndarray:
    """The probability that a document is to be rejected, for whatever fault."""
    return 1 - _classes(model, pattern)[:, 0]


_KIND = np.zeros(256, np.uint8)  # a byte's kind in the shape of a word; other ASCII bytes stand for themselves
_KIND[:128] = np.arange(128)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = ord("A"), ord("a"), ord("0"), ord("x")


def _shapes(w: Words) -> np.ndarray:
    """The hash of every word's shape: the kinds of its bytes, repeats of one kind written once."""
    kind = _KIND[w.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.start] = True
    at = np.r_[0, np.cumsum(keep)]
    return span_hashes(kind[keep], at[w.start], at[w.end])


def _features(raw: Words, w: Words, h: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed column and value of texts, none of them a vote; wanted: only these columns.

    Distinct beginnings of words (whole, if short) are present or absent; shapes of words, and words that repeat the one
    before, have the square root of their share of the text.
    """
    n = len(w.at) - 1
    owner = np.repeat(np.arange(n), np.diff(w.at))
    found = [(owner[at], (b >> U(64 - BITS)).astype(np.int64)) for at, b in _beginnings(w)]
    if wanted is not None:
        found = [(d[m], c[m]) for d, c in found for m in [wanted[c]]]
    code = np.unique(np.concatenate([d * WIDTH + c for d, c in found]))
    row, column, value = [code >> BITS], [code & ((1 << BITS) - 1)], [np.ones(len(code))]
    same = np.flatnonzero(np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])][: len(h)])
    doc = np.repeat(np.arange(n), np.diff(raw.at))
    shape = np.r_[mix(_shapes(raw) + U(1)), np.full(len(same), mix(np.array([2], U))[0])]
    code, many = np.unique(np.r_[doc, owner[same]] * (1 << BITS) + (shape >> U(64 - BITS)).astype(np.int64), return_counts=True)
    row.append(code >> BITS)
    column.append(code & ((1 << BITS) - 1))
    value.append(np.sqrt(many / np.maximum(np.diff(raw.at), 1)[row[-1]]))
    return np.concatenate(row), np.concatenate(column), np.concatenate(value)


def fit_scorer(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, steps: int = 150, support: int = 3, sparse: float = 0.003, screen: float = 3.0) -> np.ndarray:
    """Logistic weights by accelerated proximal gradient steps with an L1 penalty, which leaves chance columns at 0.

    Both sides of the target weigh alike; columns are scaled by their own curvature. Columns of fewer than `support` rows
    stay at 0, as do those whose gradient at weights of 0 is below `screen` times the penalty. The last weight is the bias.
    """
    weight = np.zeros(WIDTH + 1)
    high = np.clip(target.sum(), 1e-3, len(target) - 1e-3)
    scale = np.where(target > 0.5, 0.5 / high, 0.5 / (len(target) - high))
    name, column = np.unique(column, return_inverse=True)
    often = np.bincount(column) >= support
    used = often[column]
    row, column, value = row[used], (np.cumsum(often) - 1)[column[used]], value[used]
    name = name[often]
    curve = np.sqrt(np.bincount(column, scale[row] * value**2, len(name))) + 1e-6
    value = value / curve[column]
    first = np.bincount(column, ((target - (target * scale).sum()) * scale)[row] * value, len(name))
    worth = np.abs(first) >= screen * sparse
    used = worth[column]
    row, column, value = row[used], (np.cumsum(worth) - 1)[column[used]], value[used]
    name, curve = name[worth], curve[worth]
    many = len(name)
    times = lambda w: np.bincount(row, w[column] * value, len(target))
    back = lambda e: np.bincount(column, e[row] * value, many)
    v = np.ones(many) / max(1, many) ** 0.5
    top = 1.0
    for _ in range(12):  # the largest curvature, by powers
        u = back(times(v) * scale)
        top = max(float(np.linalg.norm(u)), 1e-9)
        v = u / top
    w, bias, ahead, ahead_bias, t = np.zeros(many), 0.0, np.zeros(many), 0.0, 1.0
    rate = 4 / (1.1 * top + 1)
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(times(ahead) + ahead_bias, -40, 40))) - target) * scale
        new = ahead - rate * back(error)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparse, 0)
        new_bias = ahead_bias - rate * error.sum()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_bias = new + (was - 1) / t * (new - w), new_bias + (was - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    weight[name], weight[-1] = w / curve, bias
    return weight


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other labelled documents have each word beginning in so many different words or more."""
    for batch in batches:
        for part in groups(batch, "text"):
            w = Words(pc.utf8_lower(pc.fill_null(part["text"].cast(pa.large_string()), "")))
            h = w.hashes()
            toxic = part["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            for at, b in _beginnings(w):
                doc = np.searchsorted(w.at, at, "right") - 1
                first, many, (_, order) = _entries(h[at], b, doc)
                pair = order[first]
                for level in range(1, LEVELS + 1):
                    mine = pair[many >= level]
                    key, inverse = np.unique(b[mine], return_inverse=True)
                    bad = toxic[doc[mine]]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), level, np.int32)), pa.array(np.bincount(inverse, bad, len(key)).astype(np.int64)), pa.array(np.bincount(inverse, ~bad, len(key)).astype(np.int64))], names=["beginning", "level", "toxic", "other"])


def lexicon(docs: DataFrame, labels: DataFrame, most_labels: int = 10_000) -> Lexicon:
    """The word beginnings that mark toxic documents."""
    some = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_labels)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most most_labels rows
    known = known.groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("k")).agg(F.first("text").alias("text"), (F.avg(F.col("toxic").cast("int")) > 0.5).alias("toxic"))
    counts = known.select("text", "toxic").mapInArrow(_counted, "beginning long, level int, toxic long, other long").groupBy("beginning", "level").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    marks = counts.filter("toxic >= 4 and other * 25 <= toxic").select("beginning", "level").toArrow()
    return Lexicon(marks["beginning"].to_numpy().astype(np.int64).view(U), marks["level"].to_numpy())


def _patterns(entries: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text"):
                code, many = np.unique(_code(votes(part["text"], entries)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(many)], names=["pattern", "n"])

    return run


def _scores(entries: Lexicon, model: dict, weight: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = weight[:-1] != 0
        for batch in batches:
            for part in groups(batch, "text"):
                table, w, h = votes(part["text"], entries)
                row, column, value = _features(_raw(part["text"]), w, h, wanted)
                z = np.bincount(row, weight[column] * value, part.num_rows) + weight[-1]
                z[np.diff(w.at) == 0] = -40.0  # nothing speaks against a text without words
                made = [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), pa.array(posterior(model, table)), pa.array(_code(table))]
                yield pa.RecordBatch.from_arrays([part[c] for c in part.schema.names] + made, names=[*part.schema.names, "score", "weak_label", "votes"])

    return run


def _raw(texts: pa.Array) -> Words:
    return Words(pc.fill_null(texts.cast(pa.large_string()), ""))


def _sampled(entries: Lexicon, model: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The weak label and the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text"):
                table, w, h = votes(part["text"], entries)
                row, column, value = _features(_raw(part["text"]), w, h)
                order = np.argsort(row, kind="stable")
                at = pa.array(np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x[order].astype(k))) for x, k in ((column, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array(posterior(model, table)), *lists], names=["target", "column", "value"])

    return run


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scorer's weights other than 0, from all rows of the sample."""
    row, column, value, target = [], [], [], []
    n = 0
    for batch in batches:
        many = np.diff(batch["column"].offsets.to_numpy())
        row.append(np.repeat(np.arange(n, n + batch.num_rows, dtype=np.int32), many))
        column.append(batch["column"].flatten().to_numpy())
        value.append(batch["value"].flatten().to_numpy())
        target.append(batch["target"].to_numpy())
        n += batch.num_rows
    if n:
        weight = fit_scorer(*(np.concatenate(x) for x in (row, column, value, target)))
        some = np.unique(np.r_[np.flatnonzero(weight), WIDTH])  # the bias always
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(weight[some])], names=["column", "weight"])


def sample(docs: DataFrame, most_rows: int) -> DataFrame:
    """The most_rows different texts of the smallest hashes (all, if fewer), whatever the number of rows and of copies."""
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    least = keyed.select("h").distinct().orderBy("h").limit(most_rows).agg(F.max("h").alias("h")).first().h
    return keyed.filter(F.col("h") <= F.lit(least if least is not None else 0)).groupBy("h").agg(F.min("text").alias("text")).select("text")


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 10_000, most_rows: int = 8_000) -> tuple[Lexicon, dict, np.ndarray]:
    """The lexicon, the label model and the scorer's weights.

    Features of the sample are made where its texts lie; one task, which `most_rows` bounds, fits the scorer, so the
    driver gets only counts of vote patterns and weights.
    """
    entries = lexicon(docs, labels, most_labels)
    counts = docs.select("text").mapInArrow(_patterns(entries), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    pattern, count = counts["pattern"].to_numpy().astype(np.int64), counts["n"].to_numpy()
    model = fit_label_model(_decode(pattern), count)
    made = sample(docs, most_rows).mapInArrow(_sampled(entries, model), "target double, column array<int>, value array<float>")
    found = made.repartition(1).mapInArrow(_fitted, "column long, weight double").toArrow()
    if len(pattern) and not found.num_rows:
        raise RuntimeError("there are documents, but the scorer was fitted on none")
    weight = np.zeros(WIDTH + 1)
    weight[found["column"].to_numpy().astype(np.int64)] = found["weight"].to_numpy()
    return entries, model, weight


def score(docs: DataFrame, labels: DataFrame, carry: list[str], cut: float = 0.5) -> DataFrame:
    """The carried columns (text among them) with score, weak_label (the label model's posterior), votes and rejected."""
    entries, model, weight = fit(docs, labels)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]
    made = docs.select(*carry).mapInArrow(_scores(entries, model, weight), ", ".join([*names, "score double, weak_label double, votes long"]))
    return made.withColumn("rejected", F.col("score") >= cut)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels, ["doc_id", "text"]).select("doc_id", "score", "weak_label", "votes", "rejected")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")
    kept = score(docs.select(row, "doc_id", "text"), labels, ["row", "text"]).filter(~F.col("rejected"))
    return kept.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
