"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of five-word runs (lower case). Items are partitioned by size. An item's signature is its bottom-k
MinHash sketch, the k = floor((1 - t) * n) + 1 smallest of its n hash values. A partition's ceiling is the largest value of
its items' signatures, and a document's signature for the partition holds the document's hash values up to that ceiling, so it
grows with the document and can hold a short item however long the document is. Signatures are matched: a document that
contains at least t of an item lacks fewer than k of its runs, hence holds one of the k of the signature, which is below the
ceiling and so in the document's signature: no pair is missed. Every candidate is then verified by the exact
containment |item & document| / |item| over all runs of both.

Items of at most `most_local` runs together (24 bytes a run) are sent to every task; beyond that signatures are joined as
tables, and candidates with their runs.

A text of one to four words is one run of its own length: such an item is found in documents whose whole text it is, and in no
other. Texts without words, empty or null, match nothing. Repeated
items and documents each give their own rows. Items are told apart by their text, so one without an id is searched
too: documents that hold it go, but a report by id has no row for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import SHINGLE, shingles
from .shared import stored
from .words import U, groups, mix, signed

_PAIR = "doc_key long, item_key long, shared long, item_size long"


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of full runs of SHINGLE words, sorted by text and hash, with their text's index."""
    h, doc = shingles(texts, SHINGLE, short=True)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return h[keep], doc[keep]


def sketch_size(size: np.ndarray, least: float) -> np.ndarray:
    return np.floor((1 - least) * size + 1e-9).astype(np.int64) + 1


def _sketches(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every run of every item with its MinHash value (signed order is not used: values are unsigned), marked if it is in the item's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text"):
                h, doc = _distinct(part["text"])
                n = np.bincount(doc, minlength=part.num_rows)
                order = np.lexsort((mix(h), doc))
                h, doc = h[order], doc[order]
                rank = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
                yield pa.RecordBatch.from_arrays([part["item_key"].take(pa.array(doc)), signed(h), pa.array(n[doc]), pa.array(rank < sketch_size(n[doc], least))], names=["item_key", "hash", "item_size", "sketched"])

    return run


class _Items:
    """Signatures by partition and all runs of the items."""

    def __init__(self, item_key: np.ndarray, hash_: np.ndarray, item_size: np.ndarray, sketched: np.ndarray):
        order = np.argsort(item_key, kind="stable")
        key, self.runs = item_key[order], hash_[order]
        self.key, first, self.size = np.unique(key, return_index=True, return_counts=True)
        self.at = np.r_[first, len(key)]
        item = np.searchsorted(self.key, item_key)
        partition = np.frexp(item_size.astype(float))[1]  # partition c has sizes 2^(c-1) .. 2^c - 1
        self.parts = []
        for c in np.unique(partition):
            mine = (partition == c) & sketched
            value = mix(hash_[mine])
            by = np.argsort(value, kind="stable")
            self.parts.append((value.max(), value[by], item[mine][by]))

    def candidates(self, value: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Pairs of a document and an item whose signatures share a value."""
        found = []
        for ceiling, table, item in self.parts:
            low = value <= ceiling  # the documents' signatures for this partition
            v, d = value[low], doc[low]
            lo = np.searchsorted(table, v, "left")
            hit = table[np.minimum(lo, len(table) - 1)] == v
            v, d, lo = v[hit], d[hit], lo[hit]
            many = np.searchsorted(table, v, "right") - lo
            row = np.repeat(np.arange(len(lo)), many)
            found.append(np.stack([d[row], item[lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]]))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)

    def contained(self, texts: pa.Array, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and number of common runs of every verified pair."""
        h, doc = shingles(texts, SHINGLE, short=True)
        pairs = self.candidates(mix(h), doc)
        out = []
        for d in np.unique(pairs[0]):
            own = np.unique(h[np.searchsorted(doc, d, "left") : np.searchsorted(doc, d, "right")])
            for i in pairs[1][pairs[0] == d]:
                runs = self.runs[self.at[i] : self.at[i + 1]]
                at = np.minimum(np.searchsorted(own, runs), len(own) - 1)
                shared = int((own[at] == runs).sum())
                if shared >= least * self.size[i] - 1e-9:
                    out.append((d, i, shared))
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _search(items: _Items, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text"):
                doc, item, shared = items.contained(part["text"], least)
                yield pa.RecordBatch.from_arrays([part["doc_key"].take(pa.array(doc)), pa.array(items.key[item]), pa.array(shared), pa.array(items.size[item])], names=["doc_key", "item_key", "shared", "item_size"])

    return run


def _clean(items: _Items, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows whose text contains no item, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[items.contained(part["text"], least)[0]] = False
                yield part.select(["row"]).filter(pa.array(keep))

    return run


def _runs(ceiling: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's different runs; with a ceiling, those of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "text"):
                h, doc = _distinct(part["text"])
                if ceiling is not None:
                    low = mix(h) <= U(ceiling)
                    h, doc = h[low], doc[low]
                yield pa.RecordBatch.from_arrays([part["doc_key"].take(pa.array(doc)), signed(h)], names=["doc_key", "hash"])

    return run


def _joined(docs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The same by joins, with the largest ceiling for all partitions."""
    top = sketches.filter("sketched").select("hash").mapInArrow(_largest, "top binary").collect()  # a row for each task
    ceiling = max((int.from_bytes(r.top, "little") for r in top), default=0)
    signature = docs.mapInArrow(_runs(ceiling), "doc_key long, hash long")
    pairs = stored(signature.join(sketches.filter("sketched"), "hash").select("doc_key", "item_key").distinct(), "candidates")
    wanted = stored(pairs.join(sketches.select("item_key", "hash", "item_size"), "item_key"), "wanted")
    own = stored(docs.join(stored(pairs.select("doc_key").distinct(), "documents"), "doc_key", "left_semi").mapInArrow(_runs(None), "doc_key long, hash long").distinct(), "runs")
    found = wanted.join(own, ["doc_key", "hash"]).groupBy("doc_key", "item_key", "item_size").agg(F.count(F.lit(1)).alias("shared"))
    return found.filter(F.col("shared") >= least * F.col("item_size") - 1e-9).select("doc_key", "item_key", "shared", "item_size")


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top = max((int(mix(b["hash"].to_numpy().astype(np.int64).view(U)).max()) for b in batches if b.num_rows), default=0)
    yield pa.RecordBatch.from_arrays([pa.array([top.to_bytes(8, "little")], pa.binary())], names=["top"])


def _prepared(items: DataFrame, least: float, most_local: int) -> tuple[DataFrame, _Items | None]:
    """All runs of the items as a table, and at hand if they are few enough."""
    made = items.select(F.col("item_key").cast("long"), "text").filter("item_key is not null").distinct()
    sketches = stored(made.mapInArrow(_sketches(least), "item_key long, hash long, item_size long, sketched boolean"), "sketches")
    if sketches.count() > most_local:
        return sketches, None
    local = sketches.toArrow()
    columns = {c: local[c].to_numpy(zero_copy_only=False) for c in local.column_names}
    return sketches, _Items(columns["item_key"].astype(np.int64), columns["hash"].astype(np.int64).view(U), columns["item_size"].astype(np.int64), columns["sketched"].astype(bool))


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8, most_local: int = 1_000_000) -> DataFrame:
    """doc_key, item_key, shared, item_size of every document that contains at least `least` of an item's runs.

    docs has doc_key and text, items item_key and text, with one text for each item_key; rows with a null item_key are left out.
    """
    docs = docs.select(F.col("doc_key").cast("long"), "text")
    sketches, local = _prepared(items, least, most_local)
    return _joined(docs, sketches, least) if local is None else docs.mapInArrow(_search(local, least), _PAIR)


def _by_text(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.xxhash64("text").alias("item_key"), "text").filter("text is not null").distinct()


def digest(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, shared, item_size; every item with an id is reported for its text."""
    pairs = contained(docs.select(F.col("doc_id").alias("doc_key"), "text"), _by_text(benchmark), least)
    names = benchmark.filter("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("item_key")).distinct()
    return pairs.join(names, "item_key").select(F.col("doc_key").alias("doc_id"), "item_id", "shared", "item_size").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, most_local: int = 1_000_000) -> DataFrame:
    """The documents that contain no item, ids or none; a null doc_id is judged by its text like any other. Few items need no exchange."""
    row = F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")
    sketches, local = _prepared(_by_text(benchmark), least, most_local)
    if local is None:
        whole = docs.select(row, F.xxhash64("text").alias("h"), "text")
        bad = stored(_joined(whole.select(F.col("h").alias("doc_key"), "text"), sketches, least).select(F.col("doc_key").alias("h")).distinct(), "contaminated")
        return whole.join(bad, "h", "left_anti").select("row.*")
    whole = docs.select(row, "text")
    return whole.mapInArrow(_clean(local, least), whole.select("row").schema).select("row.*")


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark
), runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS run FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), item_runs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS run FROM item_words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT item_id, count(*) AS item_size FROM item_runs GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS shared, item_size
FROM runs JOIN item_runs USING (run) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, item_size
HAVING count(*) >= 0.8 * item_size - 1e-9
"""
