"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document's elements are its distinct runs of five words (lower case; fewer words make one run), with
weight 1 + ln(count). Every element emits a Poisson process of arrivals whose rate is its weight; each
arrival falls on one of the registers, and a register keeps the element that arrives first. Arrivals
are drawn round by round up to a horizon by which all registers are likely full, and drawing stops
there: a later arrival can win nothing. Two documents agree in a register with the probability
Jaccard similarity. Registers are cut into bands, and equal bands propose links.

Repeated runs can press the probability Jaccard similarity far below that of the sets, which decides. So a document
with repeats has a second signature of unit weights, and its bands too; without repeats both signatures are one. Any two
documents thus meet by signatures whose agreement is the Jaccard similarity of their sets.

Candidates are verified by the exact Jaccard similarity of the sets of runs. Equal texts are one
vertex, so copies are never compared. Elements that no other candidate text holds cannot be shared, so a
text or pair with too many of them is left out without loss. Each bucket proposes only links to its
most central member (the one in the largest buckets). What then lies in buckets of several components is
compared across them by exact prefix filtering. A class is a component of the verified links.

Null texts count as empty; documents without words form classes with equal texts only. Rows with a null or
repeated doc_id are kept and classed by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import stored
from .words import U, Words, grams, groups, mix, runs, signed

SHINGLE, ROWS, BANDS = 5, 4, 22


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def shingles(texts: pa.Array, k: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each lower-cased text, repeats included, and their text's index.

    short: a text of fewer words is one run.
    """
    w = Words(pc.utf8_lower(texts.cast(pa.large_string())))
    h, n = w.hashes(), np.diff(w.at)
    many = np.where(n >= k, n - k + 1, np.minimum(n, int(short)))
    doc = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(doc)) - (np.cumsum(many) - many)[doc] + w.at[doc]
    few = np.flatnonzero((n > 0) & (n < k))
    out = np.zeros(len(doc), U)
    full = n[doc] >= k
    out[full] = grams(h, k)[at[full]]
    if short and len(few):
        out[~full] = runs(h, w.at[few], w.at[few + 1])
    return out, doc


def weighted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct elements with weight 1 + ln(count)."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, int)
    return h[cut], d[cut], 1 + np.log(np.diff(np.r_[cut, len(h)]))


def prob_min_hash(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers of winning elements; rows of documents without elements are 0."""
    best = np.full(docs * registers, np.inf)
    won = np.zeros(docs * registers, U)
    total = np.bincount(doc, weight, docs)
    horizon = registers * (np.log(registers) + 4) / np.maximum(total, 1e-9)
    e, d, w = element, doc, weight
    done, n = np.zeros(len(e)), np.zeros(len(e), U)
    while len(e):
        seed = mix(e + (n + U(1)) * U(0x9E3779B97F4A7C15))
        done = done - np.log(((seed >> U(11)).astype(float) + 0.5) / 2.0**53) / w
        n = n + U(1)
        early = done < horizon[d]  # the rest of an element's arrivals come later still
        hit, t, x = d[early] * registers + (mix(seed[early]) % U(registers)).astype(np.int64), done[early], e[early]
        order = np.lexsort((x, t))[::-1]  # the first arrival is written last; equal times go to the smaller element
        hit, t, x = hit[order], t[order], x[order]
        first = np.full(len(best), -1, np.int64) if len(hit) * 8 > len(best) else None
        if first is not None:
            first[hit] = np.arange(len(hit))
            pick = first[first >= 0]
        else:
            pick = len(hit) - 1 - np.unique(hit[::-1], return_index=True)[1]
        slot, t, x = hit[pick], t[pick], x[pick]
        better = (t < best[slot]) | ((t == best[slot]) & (x < won[slot]))
        best[slot[better]], won[slot[better]] = t[better], x[better]
        e, d, w, done, n = e[early], d[early], w[early], done[early], n[early]
        if not len(e):
            open_ = np.isinf(best.reshape(docs, registers)).any(1) & (total > 0)
            if open_.any():  # draw these documents again with a longer horizon
                again = open_[doc]
                horizon[open_] *= 2
                e, d, w = element[again], doc[again], weight[again]
                done, n = np.zeros(len(e)), np.zeros(len(e), U)
    return won.reshape(docs, registers)


def _keys(won: np.ndarray, rows: int, bands: int) -> np.ndarray:
    key = np.zeros((len(won), bands), U)
    for i in range(rows):
        key = mix(key * U(0x100000001B3) + won[:, i::rows])
    return mix(key + np.arange(1, bands + 1, dtype=U))


def _bands(rows: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text", 1 << 20):
                n = part.num_rows
                element, doc, weight = weighted(*shingles(part["text"]))
                size = np.bincount(doc, minlength=n)
                some = np.flatnonzero(size)
                repeats = np.bincount(doc, weight > 1, n) > 0
                own, nth = repeats[doc], np.cumsum(repeats) - 1
                key = _keys(prob_min_hash(element, doc, weight, n, rows * bands), rows, bands)[some]
                unit = _keys(prob_min_hash(element[own], nth[doc[own]], np.ones(own.sum()), int(repeats.sum()), rows * bands), rows, bands)
                flat = np.concatenate([key.reshape(-1), unit.reshape(-1)])
                owner = np.repeat(np.concatenate([some, np.flatnonzero(repeats)]), bands)
                order = np.lexsort((flat, owner))
                flat, owner = flat[order], owner[order]
                new = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])][: len(flat)])
                flat, owner = flat[new], owner[new]  # a band equal in both signatures counts once
                at = np.searchsorted(owner, np.r_[some, n]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["k"].take(pa.array(some)), pa.array(size[some]), pa.ListArray.from_arrays(pa.array(at), signed(flat))], names=["k", "size", "bands"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct elements, with its id as two numbers."""
    for batch in batches:
        for part in groups(batch, "text", 1 << 20):
            element, doc, _ = weighted(*shingles(part["text"]))
            key = np.frombuffer(b"".join(part["k"].to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)[doc]
            yield pa.RecordBatch.from_arrays([signed(element), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["element", "k1", "k2"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in groups(batch, "text", 1 << 20):
            element, doc, _ = weighted(*shingles(part["text"]))
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([signed(element), *(part[c].take(at) for c in ("id", "c", "size"))], names=["element", "id", "c", "size"])


def _own(texts: DataFrame) -> DataFrame:
    """k and own: how many of a text's elements occur in no other of the texts."""
    rows = texts.mapInArrow(_elements, "element long, k1 long, k2 long")
    single = rows.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2")).filter("n = 1")
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    return single.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("own")).select(F.unhex(F.concat(half("k1"), half("k2"))).alias("k"), "own")


def _may_link(least: float, most_a: str, size_a: str, most_b: str, size_b: str) -> Column:
    """The intersection holds no own elements; a similarity of `least` asks for this much of it."""
    return F.least(most_a, most_b) >= least / (1 + least) * (F.col(size_a) + F.col(size_b)) - 1e-6


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in groups(batch, "text_a", 1 << 20):
            sides = [weighted(*shingles(part[c]))[:2] for c in ("text_a", "text_b")]
            size = sum(np.bincount(d, minlength=part.num_rows) for _, d in sides)
            h, pair = (np.concatenate(x) for x in zip(*sides, strict=True))
            order = np.lexsort((h, pair))
            h, pair = h[order], pair[order]
            both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=part.num_rows) if len(h) else size
            yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(both / np.maximum(size - both, 1))], names=["a", "b", "similarity"])


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    left = pairs.join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(_jaccard, "a binary, b binary, similarity double")
    return found.filter(F.col("similarity") >= least)


def _across(docs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs a, b of docs (k, size, c, id) in different c that can reach the similarity, by prefix filtering.

    With the elements of every text in one order, rarest first, a pair that reaches it shares an element so early
    in both texts that what follows suffices. Rare elements have short lists; a list's largest c is never paired with itself.
    """
    rows = texts.join(docs, "k").mapInArrow(_placed, "element long, id long, c long, size long")
    # grouped sides are written first: joins of tables have both exchanges of their own, which adaptive execution can split
    df = stored(rows.groupBy("element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "elements")
    shared = rows.join(df, "element")
    by_doc = Window.partitionBy("id")
    place = F.col("size") - F.count(F.lit(1)).over(by_doc) + F.row_number().over(by_doc.orderBy("n", "element"))
    early = shared.withColumn("left", F.col("size") - place + 1).filter(F.col("left") >= least * F.col("size") - 1e-6)
    early = stored(early.select("element", "id", "c", "size", "left"), "prefixes")
    main = early.groupBy("element", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("element").agg(F.max(F.struct("n", "c")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("element", F.col("m.c").alias("main"))
    some = stored(early.join(stored(main, "main"), "element"), "prefixes")
    other = some.filter("c <> main").select("element", F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("size").alias("size2"), F.col("left").alias("left2"))
    able = F.least("left", "left2") >= least / (1 + least) * (F.col("size") + F.col("size2")) - 1e-6
    met = some.join(other, (some["element"] == other["element"]) & (F.col("c") != F.col("c2")) & able).select("id", "id2").distinct()
    name = docs.select("id", "k")
    return met.join(name.select("id", F.col("k").alias("a")), "id").join(name.select(F.col("id").alias("id2"), F.col("k").alias("b")), "id2").select("a", "b")


def links(docs: DataFrame, text: str = "text", least: float = 0.8, rows: int = ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) between ids of different texts, enough to connect every class; and node, component."""
    keyed = docs.select(text_id(F.col(text)).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = keyed.mapInArrow(_bands(rows, bands), "k binary, size long, bands array<long>").groupBy("k").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    made = stored(made, "signatures")
    buckets = made.select("k", "size", F.explode("bands").alias("band"))
    hot = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    full = stored(buckets.join(hot.select("band"), "band"), "buckets")
    texts = stored(keyed.groupBy("k").agg(F.first("text").alias("text")).join(full.select("k").distinct(), "k", "left_semi"), "texts")
    most = stored(full.select("k", "size").distinct().join(_own(texts), "k", "left").select("k", (F.col("size") - F.coalesce("own", F.lit(0))).alias("most"), "size").filter(F.col("most") >= least * F.col("size") - 1e-6), "linkable")
    members = full.select("k", "band").join(most, "k")
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(members.join(sizes, "band"), "members")
    central = members.groupBy("k").agg(F.sum("n").alias("central"))
    heads = members.join(central, "k").groupBy("band").agg(F.max(F.struct("central", "k", "most", "size")).alias("h"))
    head = heads.select("band", F.col("h.k").alias("b"), F.col("h.most").alias("most_b"), F.col("h.size").alias("size_b"))
    full = stored(members.select("band", F.col("k").alias("a"), "most", "size").join(head, "band"), "headed")
    stars = full.filter(F.col("a") != F.col("b")).filter(_may_link(least, "most", "size", "most_b", "size_b")).select("a", "b").distinct()
    stars = stored(stars, "candidates")
    found = stored(_verified(stars, texts, least), "links")
    label = components(found)
    labelled = full.join(label.select(F.col("node").alias("a"), "component"), "a", "left").select("band", "a", F.coalesce("component", "a").alias("c"), F.col("b").alias("head"), "most", "size")
    several = labelled.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band")
    open_ = labelled.join(several, "band").select(F.col("a").alias("k"), "size", F.xxhash64("c").alias("c")).distinct()
    pairs = _across(stored(open_.withColumn("id", F.monotonically_increasing_id()), "open"), texts, least)
    found = stored(found.union(_verified(pairs, texts, least)), "links")
    return found, components(found)


def _classed(whole: DataFrame, least: float = 0.8, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """whole (row, text) with k and class_key. Only class keys that differ from k are joined, and they are written first."""
    _, label = links(whole.select("text"), "text", least, rows, bands)
    keyed = whole.withColumn("k", text_id(F.col("text")))
    label = stored(label.filter("node <> component").select(F.col("node").alias("k"), "component"), "labels")
    return keyed.join(label, "k", "left").select("row", "text", "k", F.coalesce("component", "k").alias("class_key"))


def classes(docs: DataFrame, text: str = "text", least: float = 0.8, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Every row with class_key, equal for rows of one class of near or exact copies; a class_key of the input is replaced."""
    whole = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    made = _classed(whole, least, rows, bands)
    return made.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "class_key"), "class_key")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, the smallest doc_id of its class, and class_size."""
    named = stored(classes(docs.select("doc_id", "text"), "text").select("doc_id", "class_key"), "classes")
    least = stored(named.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "sizes")
    return named.join(least, "class_key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: the one with the smallest doc_id (null last), then the smallest text id.

    Rows with equal doc_id and text are one; the row that stays is the one whose columns have the smallest hash.
    """
    row_id = F.unhex(F.md5(F.concat_ws("|", F.hex(text_id(F.col("text"))), F.col("doc_id").cast("string")).cast("binary")))
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")
    whole = docs.select(row, row_id.alias("r"), "doc_id", "text")
    named = _classed(whole.select(F.struct("r", "doc_id").alias("row"), "text"))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.col("row.r").alias("r"))
    keep = stored(named.groupBy("class_key").agg(F.min(order).alias("x")).select("x.r"), "kept")
    one = whole.groupBy("r").agg(F.min_by("row", F.xxhash64("row")).alias("row")).join(keep, "r", "left_semi")
    return one.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT row_number() OVER (ORDER BY text) AS k, text, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)
), runs AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS run FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), sizes AS (
  SELECT k, count(*) AS n FROM runs GROUP BY k
), common AS (
  SELECT a.k AS a, b.k AS b, count(*) AS c FROM runs a JOIN runs b ON a.run = b.run AND a.k < b.k GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE c / (x.n + y.n - c) >= 0.8
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT k, k AS root FROM t UNION SELECT b, root FROM reach JOIN edges ON a = k
), classes AS (
  SELECT k, min(root) AS class FROM reach GROUP BY k
), named AS (
  SELECT doc_id, class FROM documents JOIN t ON t.text = coalesce(documents.text, '') JOIN classes USING (k)
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id, count(*) OVER (PARTITION BY class) AS class_size FROM named
"""
