"""Repeated word passages by seed and extend.

Seeds are winnowed anchors: of each window of WINDOW words, the 8-word run with the smallest hash.
Equal windows choose equal anchors at equal places, so any two equal windows meet under their
anchor. Consecutive windows that share an anchor form a run; its context hash covers all words of
the run, so runs with equal contexts are extended both ways at once. Only runs whose context is
unique, under an anchor that has other contexts, are extended word by word: their windows and those
of one run for each other context are compared by 128-bit hashes. No pairs are ever formed; hot
anchors and contexts are counted before they are shuffled and joined back by plain equi-joins, which
adaptive execution splits.

Semantics: a window is judged on the input, the document's own other windows included; a null text has
no words; copies of a text repeat all its windows; rows with equal texts get equal results; texts of
fewer words than a window lose nothing. Columns of the input other than the text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import Words, grams, groups, leftmost_minimum, runs, signed

ANCHOR = 8  # words of a seed


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that together stand for a whole text; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("_t1"), F.xxhash64(F.lit(7), whole).alias("_t2")]


def _keyed(docs: DataFrame, text: str, *carry: str) -> DataFrame:
    return docs.select(*carry, *text_key(F.col(text)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def _anchors(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "_text"):
                w = Words(part["_text"])
                h = w.hashes()
                n = np.diff(w.at)
                if not (n >= window).any():
                    continue
                doc = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
                first = np.cumsum(np.maximum(n - window + 1, 0)) - np.maximum(n - window + 1, 0)
                s = np.arange(len(doc)) - first[doc] + w.at[doc]  # every window's first word
                g = grams(h, ANCHOR)
                a = leftmost_minimum(g, window - ANCHOR + 1)[s]
                cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
                many = np.diff(np.r_[cut, len(s)])
                lo, d, a = s[cut], doc[cut], a[cut]
                context = runs(h, lo, lo + many - 1 + window)
                yield pa.RecordBatch.from_arrays(
                    [signed(g[a]), signed(context), part["_t1"].take(pa.array(d)), part["_t2"].take(pa.array(d)), pa.array((lo - w.at[d]).astype(np.int32)), pa.array(many.astype(np.int32))],
                    names=["anchor", "context", "_t1", "_t2", "at", "many"],
                )

    return run


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "_text"):
                w = Words(part["_text"])
                h = w.hashes()
                one, two = grams(h, window), grams(h ^ np.uint64(0x5851F42D4C957F2D), window)
                wanted = part["wanted"]
                many_of = np.diff(wanted.offsets.to_numpy())
                flat = wanted.flatten()
                d = np.repeat(np.arange(part.num_rows), many_of)
                at, many, alone = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                row = np.repeat(np.arange(len(at)), many)
                s = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                p = s + w.at[d[row]]
                yield pa.RecordBatch.from_arrays(
                    [signed(one[p]), signed(two[p]), part["_t1"].take(pa.array(d[row])), part["_t2"].take(pa.array(d[row])), pa.array(s.astype(np.int32)), pa.array(alone[row].astype(bool))],
                    names=["w1", "w2", "_t1", "_t2", "at", "alone"],
                )

    return run


def _spans(window: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "_text"):
                w = Words(part["_text"])
                out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept", "spans")}
                for i, covers in enumerate(part["covers"].to_pylist()):
                    lo, hi = w.at[i], w.at[i + 1]
                    n = int(hi - lo)
                    gone = np.zeros(n + 1, np.int32)
                    for c in covers or []:
                        gone[c["at"]] += 1
                        gone[c["at"] + c["many"] - 1 + window] -= 1
                    gone = np.cumsum(gone[:n]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    start, end = w.start[lo:hi][~gone], w.end[lo:hi][~gone]
                    out["n_words"].append(n)
                    out["n_removed"].append(int(gone.sum()))
                    out["kept"].append(b" ".join(w.data[a:b].tobytes() for a, b in zip(start, end, strict=True)).decode())
                    out["spans"].append([{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)])
                columns = [pa.array(v, schema.field(k).type) for k, v in out.items()]
                carried = [part[c] for c in part.schema.names if c not in ("_t1", "_t2", "_text", "covers")]
                yield pa.RecordBatch.from_arrays([*carried, *columns], names=[c for c in part.schema.names if c not in ("_t1", "_t2", "_text", "covers")] + list(out))

    return run


_OUT = "n_words long, n_removed long, kept string, spans array<struct<first:int,last:int>>"
_ARROW = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """For each row: its key, n_words, n_removed, kept (the words left, joined by a space), spans.

    spans are the stretches of removed words, as first and last word: unions of overlapping repeats of at least window words.
    """
    if window < ANCHOR:
        raise ValueError(f"window must be at least {ANCHOR}")
    texts = _keyed(docs, text, key)
    seen = _keyed(docs, text).mapInArrow(_anchors(window), "anchor long, context long, _t1 long, _t2 long, at int, many int")
    # grouped sides are written first: joins of tables have both exchanges of their own, which adaptive execution can split
    hot = stored(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "hot")
    seeds = stored(seen.join(hot, "anchor"), "seeds")
    classes = stored(seeds.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("_t1", "_t2", "at", "many"))), "classes")
    same = seeds.join(classes.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("_t1", "_t2", "at", "many").distinct()
    mixed = stored(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("anchor"), "mixed")
    wanted = stored(classes.join(mixed, "anchor").groupBy("_t1", "_t2").agg(F.collect_list(F.struct("at", "many", (F.col("n") == 1).alias("alone"))).alias("wanted")), "wanted")
    windows = stored(texts.join(wanted, ["_t1", "_t2"]).mapInArrow(_windows(window), "w1 long, w2 long, _t1 long, _t2 long, at int, alone boolean"), "windows")
    twice = stored(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("alone")).filter("n > 1 and alone").select("w1", "w2"), "twice")
    found = windows.filter("alone").join(twice, ["w1", "w2"]).select("_t1", "_t2", "at", F.lit(1).alias("many"))
    covers = stored(same.unionByName(found).groupBy("_t1", "_t2").agg(F.collect_list(F.struct("at", "many")).alias("covers")), "covers")
    kind = docs.schema[key].dataType.simpleString()
    return texts.join(covers, ["_t1", "_t2"], "left").mapInArrow(_spans(window, _ARROW), f"`{key}` {kind}, {_OUT}")


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    return repeats(docs, "doc_id", "text", window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def remove(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents with their columns; a text that holds repeats keeps its other words, joined by a space."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")
    found = repeats(docs.select(row, "text"), "row", "text", window)
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}

    def column(i: int, name: str) -> Column:
        old = F.col("row").getField(f"c{i}")
        return (F.when(F.col("n_removed") > 0, new[name].cast(docs.schema[name].dataType)).otherwise(old) if name in new else old).alias(name)

    return found.select(*(column(i, c) for i, c in enumerate(docs.columns)))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35
), twice AS (
  SELECT h FROM starts GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT rid, p FROM starts JOIN twice USING (h), unnest(range(i, i + 35)) AS t(p)
), words AS (
  SELECT rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid
), many AS (
  SELECT rid, count(*) AS n FROM gone GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN many USING (rid)
"""


def brute_force(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    """The same by comparing whole windows, for tests."""
    import re
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out
