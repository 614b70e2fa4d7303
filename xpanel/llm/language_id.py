"""Language identification of words by a linear-chain conditional random field.

Each word has features from its letters (lower case): beginnings and endings of 1 to 4 letters, inner 2- and
3-grams, its length and whether it is in the lexicon of a language (frequent training words, nearly all in
that language: at least five, and 95 of 100). Emission weights of hashed features and a transition matrix are fitted by maximum
likelihood with forward-backward and Adam, on sequences that switch between texts of different languages, so
that transitions are learned. A text's words get posterior label probabilities by forward-backward over
the whole text; a document's language is the label with the largest mean posterior, its score that mean.

The chain is computed exactly in blocks: transfer matrices of all blocks at once, a scan over each text's
blocks, then all blocks again from their borders. Fitting uses the `per_language` different whole texts of
each language with the smallest hashes, or all if there are fewer; every language takes part, so the model grows with
their number. Every run of letters is a word of the chain. Words without letters are skipped; a text without a letter or null is `und` with
score 0. With nothing to learn from, every text is `und`. Null and repeated doc_ids are kept as rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, Words, groups, mix

BITS, CHAIN = 16, 16
_LETTERS = regex.compile(r"\p{L}+")
MOST = 1_000_000  # words whose emissions a worker process keeps


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words of letters: the word's index and the slot of each."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U)
    size = np.array(list(map(len, words)), np.int64)
    end = np.cumsum(size)
    start = end - size
    every = np.arange(len(words))
    rows, slots = [every], [mix(np.minimum(size, 12).astype(U) + U(1 << 40))]

    def add(row: np.ndarray, at: np.ndarray, k: int, tag: int) -> None:
        h = np.full(len(at), tag, U)
        for i in range(k):
            h = (h ^ code[at + i]) * U(1099511628211)
        rows.append(row)
        slots.append(mix(h))

    for k in (1, 2, 3, 4):
        enough = every[size >= k]
        add(enough, start[enough], k, 1)
        add(enough, end[enough] - k, k, 2)
    owner = np.repeat(every, size)
    for k in (2, 3):
        at = np.flatnonzero(np.arange(len(code)) + k <= end[owner])
        add(owner[at], at, k, 3)
    return np.concatenate(rows), (np.concatenate(slots) >> U(64 - BITS)).astype(np.int64)


def cores(piece: str) -> list[str]:
    """Every run of letters of a piece, lower case."""
    piece = piece.lower()
    if piece.isalpha():
        return [piece]
    if piece[:-1].isalpha():
        return [piece[:-1]]
    return _LETTERS.findall(piece)


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        n = len(labels)
        self.emit, self.known, self.bias, self.move = np.zeros((1 << BITS, n)), np.zeros((n, n)), np.zeros(n), np.zeros((n, n))

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows and slots, and lexicon labels (-1: in none) of words."""
        return *features(words), np.array([self.lexicon.get(w, -1) for w in words], np.int64)

    def scores(self, row: np.ndarray, slot: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(row, self.emit[slot, c], len(known)) for c in range(len(self.labels))], 1) + self.bias
        out[known >= 0] += self.known[known[known >= 0]]
        return out


def marginals(score: np.ndarray, move: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of each word; text i has the words at[i]:at[i + 1]."""
    return forward_backward(score, move, at)[0]


def forward_backward(score: np.ndarray, move: np.ndarray, at: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As marginals, and with pairs the expected number of each transition: the posteriors of neighbouring words' labels, summed.

    A text's first word has no transition. Computed in blocks.
    """
    n, k = score.shape
    joint = np.zeros((k, k))
    if not n:
        return score, joint
    emit = np.exp(score - score.max(1, keepdims=True))
    step = np.exp(move - move.max())
    many = np.diff(at)
    blocks = -(-many // CHAIN)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    text = np.repeat(np.arange(len(many)), blocks)
    lo = at[:-1][text] + (np.arange(total) - first[text]) * CHAIN
    pos = lo[:, None] + np.arange(CHAIN)
    real = pos < at[1:][text][:, None]
    e = np.where(real[:, :, None], emit[np.minimum(pos, n - 1)], 1.0)
    depth = np.arange(total) - first[text]
    enter = np.where((depth == 0)[:, None, None], 1.0, step)  # into a block's first word
    through = np.broadcast_to(np.eye(k), (total, k, k))
    for t in range(CHAIN):  # the transfer of a block: step into each word, times its emission
        nxt = (through @ step if t else enter) * e[:, t, None, :]
        through = np.where(real[:, t, None, None], nxt / nxt.sum((1, 2), keepdims=True), through)
    left, right = np.full((total, k), 1 / k), np.ones((total, k))
    order = np.argsort(depth, kind="stable")
    cut = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(depth.max()):
        now = order[cut[d + 1] : cut[d + 2]]
        v = np.einsum("bi,bij->bj", left[now - 1], through[now - 1])
        left[now] = v / v.sum(1, keepdims=True)
    back = blocks[text] - 1 - depth
    order = np.argsort(back, kind="stable")
    cut = np.searchsorted(back[order], np.arange(back.max() + 2))
    for d in range(back.max()):
        now = order[cut[d + 1] : cut[d + 2]]
        v = np.einsum("bij,bj->bi", through[now + 1], right[now + 1])
        right[now] = v / v.sum(1, keepdims=True)
    ahead = np.empty((total, CHAIN, k))
    v = left
    for t in range(CHAIN):
        v = (v @ step if t else np.einsum("bi,bij->bj", v, enter)) * e[:, t]
        v = v / v.sum(1, keepdims=True)
        ahead[:, t] = v
    v = right
    out = np.empty((total, CHAIN, k))
    for t in range(CHAIN - 1, -1, -1):
        p = ahead[:, t] * v
        out[:, t] = p / p.sum(1, keepdims=True)
        b = e[:, t] * v
        if pairs:
            some = real[:, t] & ((depth > 0) if t == 0 else True)
            both = (ahead[some, t - 1] if t else left[some])[:, :, None] * step * b[some][:, None, :]
            joint += (both / both.sum((1, 2), keepdims=True)).sum(0)
        w = b @ step.T
        v = np.where(real[:, t, None], w / w.sum(1, keepdims=True), v)
    return out[real], joint


def fit(samples: list[tuple[str, str]], epochs: int = 30, seed: int = 1) -> Model | None:
    """samples: (language, text). Adam over the full batch."""
    labels = sorted({lang for lang, _ in samples})
    if not labels:
        return None
    texts = [(labels.index(lang), [w for piece in text.split() for w in cores(piece)]) for lang, text in samples]
    counts = [Counter() for _ in labels]
    for lang, words in texts:
        counts[lang].update(words)
    total = sum(counts, Counter())
    lexicon = {w: c for c, mine in enumerate(counts) for w, n in sorted(mine.items()) if n >= 5 and n >= 0.95 * total[w]}
    model = Model(labels, lexicon)
    random = np.random.default_rng(seed)
    spans = [(lang, words[i : i + size]) for lang, words in texts for size in [int(random.integers(8, 40))] for i in range(0, len(words), size)]
    random.shuffle(spans)
    gold = np.array([lang for lang, words in spans for _ in words], np.int64)
    words = [w for _, ws in spans for w in ws]
    if not words:
        return None
    ends = np.cumsum([len(ws) for _, ws in spans])
    groups_of = ends[2::3] if len(ends) > 3 else ends[-1:]
    at = np.unique(np.r_[0, groups_of, ends[-1]])
    vocabulary, index = np.unique(np.array(words), return_inverse=True)
    row, slot, known = model.table(vocabulary.tolist())
    hot = np.eye(len(labels))[gold]
    inner = np.ones(len(gold), bool)
    inner[at[:-1]] = False
    seen_pairs = np.zeros((len(labels), len(labels)))
    np.add.at(seen_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    seen = {name: [np.zeros_like(getattr(model, name)), np.zeros_like(getattr(model, name))] for name in ("emit", "known", "bias", "move")}
    for epoch in range(1, epochs + 1):
        score = model.scores(row, slot, known)[index]
        p, joint = forward_backward(score, model.move, at, pairs=True)
        gap = np.stack([np.bincount(index, hot[:, c] - p[:, c], len(vocabulary)) for c in range(len(labels))], 1)
        emit = np.stack([np.bincount(slot, gap[row, c], 1 << BITS) for c in range(len(labels))], 1)
        lex = np.zeros_like(model.known)
        np.add.at(lex, known[known >= 0], gap[known >= 0])
        grads = {"emit": emit - 0.5 * model.emit, "known": lex - 0.5 * model.known, "bias": gap.sum(0), "move": seen_pairs - joint - 0.5 * model.move}
        for name, g in grads.items():
            g = g / len(gold)
            m, v = seen[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            getattr(model, name)[...] += 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return model


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of each of the runs of so many."""
    return np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)


class _Labeller:
    """Emissions of the letter runs of different words, kept by the word's hash in a bounded table of the worker process."""

    def __init__(self, model: Model):
        self.model = model
        self.key, self.first, self.many = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros((0, len(model.labels)))

    def look(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The emissions of every letter run of the words in turn, and each word's number of runs."""
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, key)
        have = (at < len(self.key)) & (self.key[np.minimum(at, max(0, len(self.key) - 1))] == key) if len(self.key) else np.zeros(len(key), bool)
        new = np.flatnonzero(~have)
        found = [cores(w.data[w.start[i] : w.end[i]].tobytes().decode()) for i in first[new]]
        many = np.zeros(len(key), np.int64)
        many[have], many[new] = self.many[at[have]], [len(c) for c in found]
        start = np.cumsum(many) - many
        score = np.zeros((int(many.sum()), len(self.model.labels)))
        score[_spread(start[have], many[have])] = self.score[_spread(self.first[at[have]], many[have])]
        runs = [c for each in found for c in each]
        if runs:
            made = self.model.scores(*self.model.table(runs))
            score[_spread(start[new], many[new])] = made
        if len(new) and len(self.key) + len(new) <= MOST and len(self.score) + len(runs) <= MOST:
            keys = np.concatenate([self.key, key[new]])
            order = np.argsort(keys, kind="stable")
            self.key = keys[order]
            self.first = np.concatenate([self.first, len(self.score) + np.cumsum(many[new]) - many[new]])[order]
            self.many = np.concatenate([self.many, many[new]])[order]
            if runs:
                self.score = np.concatenate([self.score, made])
        return score[_spread(start[back], many[back])], many[back]


def _room(model: Model) -> int:
    """Bytes of text labelled at a time: transfer matrices take the square of the number of languages, so more languages get less text."""
    return max(1 << 16, (1 << 26) // max(16, len(model.labels) ** 2))


def _labelled(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model) if model else None
        for batch in batches:
            for part in groups(batch, "text", _room(model) if model else 1 << 22):
                n = part.num_rows
                lang, mean = np.full(n, "und", object), np.zeros(n)
                if labeller:
                    w = Words(pc.fill_null(part["text"].cast(pa.large_string()), ""))
                    score, letters = labeller.look(w, w.hashes())
                    doc = np.repeat(np.repeat(np.arange(n), np.diff(w.at)), letters)
                    at = np.searchsorted(doc, np.arange(n + 1))
                    p = marginals(score, model.move, at)
                    many = np.diff(at)
                    sums = np.stack([np.bincount(doc, p[:, c], n) for c in range(len(model.labels))], 1)
                    some = many > 0
                    lang[some] = np.array(model.labels, object)[sums.argmax(1)[some]]
                    mean[some] = np.minimum(1.0, sums.max(1)[some] / many[some])
                carried = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in carried), pa.array(lang, pa.string()), pa.array(mean)], names=[*carried, "lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _smallest(many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each language's smallest different hashes of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            h, code = batch["h"].to_numpy(), pc.dictionary_encode(batch["lang"])
            index, names = code.indices.to_numpy(), code.dictionary.to_pylist()
            for i, lang in enumerate(names):
                kept[lang] = np.unique(np.concatenate([kept.get(lang, h[:0]), h[index == i]]))[:many]
        for lang, h in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h, pa.int64())], names=["lang", "h"])

    return run


def train(docs: DataFrame, per_language: int = 150) -> Model | None:
    """docs has lang and text, null lang not used; of each language the per_language different texts of the smallest hashes are drawn."""
    keyed = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    least = keyed.select("lang", "h").mapInArrow(_smallest(per_language), "lang string, h long")
    picked = least.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set("h")), 1, per_language).alias("h")).select("lang", F.explode("h").alias("h"))
    rows = keyed.join(F.broadcast(picked), ["lang", "h"]).select("lang", "text").distinct().collect()  # per_language rows a language
    return fit(sorted(map(tuple, rows)))


def _words_labelled(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model) if model else None
        for batch in batches:
            for part in groups(batch, "text", _room(model)) if model else ():
                w = Words(pc.fill_null(part["text"].cast(pa.large_string()), ""))
                score, letters = labeller.look(w, w.hashes())
                piece = np.repeat(np.arange(len(letters)), letters)
                doc = np.repeat(np.arange(part.num_rows), np.diff(w.at))[piece]
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                p = marginals(score, model.move, at)
                words = [c for i in np.flatnonzero(letters) for c in cores(w.data[w.start[i] : w.end[i]].tobytes().decode())]
                place = np.arange(len(doc)) - at[doc] if len(doc) else doc
                lang = np.array(model.labels, object)[p.argmax(1)] if len(doc) else np.zeros(0, object)
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(doc)), pa.array(place.astype(np.int64)), pa.array(words, pa.string()), pa.array(lang, pa.string()), pa.array(np.minimum(p.max(1), 1.0) if len(doc) else np.zeros(0))], names=["key", "place", "word", "lang", "score"])

    return run


def label_words(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place, word, lang, score: every run of letters of every text, in order, with its likeliest language and that language's posterior.

    The chain runs over the whole text, so a word in a stretch of another language is labelled by its neighbours too. Texts without
    letters, null ones and a model of nothing give no rows; rows with equal keys each give theirs.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    made = rows.mapInArrow(_words_labelled(model), f"key {rows.schema['key'].dataType.simpleString()}, place long, word string, lang string, score double")
    return made.withColumnRenamed("key", key)


def digest(docs: DataFrame, per_language: int = 150) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned only from documents that are not held out."""
    model = train(docs.filter(~held_out()).select("lang", "text"), per_language)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_labelled(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
    return made
