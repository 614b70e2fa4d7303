"""Token-id files with a minimal perfect hash index.

Format: a Parquet folder `segments` whose rows are segments of raw ids, written by tasks of one ascending range
of doc_id each (a shard), and a folder `shards` with each shard's first id position and keys. A segment row holds
`payload` (unsigned 32-bit little-endian ids of its documents, nothing between them) and an index: `pilots`,
`prints`, `offsets`, `lengths` and `counts`. A key's bucket is a hash of the key; the bucket's pilot displaces its keys
to slots of their own, one for each key; `prints` has the key's fingerprint at its slot, so an absent key is
told apart, and `offsets` and `lengths` at the slot say where in the payload its ids are: two arithmetic steps, one
comparison and one slice, whatever the segment holds. The fingerprint is a bijection of the 64-bit key, so it also gives
the key back and never matches wrongly.

A whole task is written or not at all (Spark's committer), so a lost executor leaves no half file. Documents follow
by doc_id, null first, equal ones by text. Documents of equal keys in one segment follow one another: `counts` has their
number, and `more` the lengths of those after the first, as triples of slot, number and length; `loose` has offset and length of each
document without a key. Null texts count as empty. A segment is closed at `segment_ids` ids or `segment_docs`
documents, so a task holds one segment at a time; keys of one run may go on in the next segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoder import encoder
from .shared import folder
from .words import U, groups, mix

_GOLD = U(0x9E3779B97F4A7C15)
PER_BUCKET = 4


def fingerprint(key: np.ndarray) -> np.ndarray:
    return mix(key.view(U) + _GOLD)


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of words.mix."""
    undo = lambda v, s: v ^ (v >> U(s)) ^ (v >> U(2 * s))
    x = undo(x, 31) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = undo(x, 27) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return undo(x, 30)


def key_of(print_: np.ndarray) -> np.ndarray:
    return (_unmix(print_) - _GOLD).view(np.int64)


def slots(print_: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot of each fingerprint among n keys; two arithmetic steps whatever n is."""
    bucket = (print_ % U(len(pilots))).astype(np.int64)
    return (mix(print_ ^ (pilots[bucket].astype(U) * _GOLD)) % U(n)).astype(np.int64)


def build(print_: np.ndarray) -> np.ndarray:
    """Pilots of a minimal perfect hash of different fingerprints: largest buckets first, each takes the first pilot that fits."""
    n = len(print_)
    pilots = np.zeros(max(1, -(-n // PER_BUCKET)), np.uint32)
    bucket = (print_ % U(len(pilots))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=len(pilots))
    start = np.cumsum(size) - size
    taken = np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        mine = print_[order[start[b] : start[b] + size[b]]]
        first, step = 0, 64
        while True:
            pilot = np.arange(first, first + step, dtype=U)
            at = (mix(mine[None, :] ^ (pilot[:, None] * _GOLD)) % U(n)).astype(np.int64)
            good = ~taken[at].any(1)
            if len(mine) > 1:
                ranked = np.sort(at, 1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
            if good.any():
                i = int(np.argmax(good))
                pilots[b] = first + i
                taken[at[i]] = True
                break
            first, step = first + step, min(step * 2, 1 << 14)
    return pilots


_SEGMENT = "shard int, segment int, seg_start long, n_ids long, n_docs long, first_key long, last_key long, payload binary, pilots binary, prints binary, offsets binary, lengths binary, counts binary, more binary, loose binary"
_NAMES = [x.split()[0] for x in _SEGMENT.split(", ")]


def _segment(shard: int, segment: int, start: int, keys: list, parts: list[np.ndarray]) -> dict:
    length = np.array([len(p) for p in parts], np.int64)
    offset = np.cumsum(length) - length
    known = np.array([k is not None for k in keys])
    key = np.array([k if k is not None else 0 for k in keys], np.int64)
    where = np.flatnonzero(known)
    different, first, count = np.unique(key[where], return_index=True, return_counts=True)
    print_ = fingerprint(different)
    pilots = build(print_) if len(different) else np.zeros(1, np.uint32)
    slot = slots(print_, pilots, len(different)) if len(different) else np.zeros(0, np.int64)

    def place(v: np.ndarray, kind: str) -> bytes:
        out = np.zeros(len(different), kind)
        out[slot] = v
        return out.tobytes()

    begin = where[first] if len(where) else where
    extra = [(int(slot[i]), j, int(length[begin[i] + j])) for i in np.flatnonzero(count > 1) for j in range(1, count[i])]
    loose = np.stack([offset[~known], length[~known]], 1)
    return {
        "shard": shard, "segment": segment, "seg_start": start, "n_ids": int(length.sum()), "n_docs": len(keys),
        "first_key": int(key[where].min()) if len(where) else None, "last_key": int(key[where].max()) if len(where) else None,
        "payload": np.concatenate(parts).astype("<u4").tobytes(), "pilots": pilots.astype("<u4").tobytes(), "prints": place(print_, "<u8"),
        "offsets": place(offset[begin], "<u4"), "lengths": place(length[begin], "<u4"), "counts": place(count, "<u4"), "more": np.array(extra, "<u4").tobytes(), "loose": loose.astype("<u4").tobytes(),
    }


_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("seg_start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())] + [(n, pa.binary()) for n in _NAMES[7:]])


def _writer(path: str, end: int, segment_ids: int, segment_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path, "words"), TaskContext.get().partitionId()
        keys: list = []
        parts: list[np.ndarray] = []
        held = segment = start = 0
        for batch in batches:
            for part in groups(batch, "text"):
                ids, at = coder.encode(part["text"])
                for i, key in enumerate(part["doc_id"].to_pylist()):
                    if keys and (held >= segment_ids or len(keys) >= segment_docs):
                        yield pa.RecordBatch.from_pylist([_segment(shard, segment, start, keys, parts)], schema=_ARROW)
                        segment, start, held, keys, parts = segment + 1, start + held, 0, [], []
                    mine = np.append(ids[at[i] : at[i + 1]], np.uint32(end))
                    keys.append(key)
                    parts.append(mine)
                    held += len(mine)
        if keys:
            yield pa.RecordBatch.from_pylist([_segment(shard, segment, start, keys, parts)], schema=_ARROW)

    return run


def write(docs: DataFrame, out: str, path: str, end: int = 2, most_shards: int = 4096, segment_ids: int = 1 << 18, segment_docs: int = 4096) -> None:
    """Writes doc_id, text to the folder out. most_shards bounds the table of shards, whatever the input."""
    spark = docs.sparkSession
    shards = min(most_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = keyed.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    dealt.mapInArrow(_writer(path, end, segment_ids, segment_docs), _SEGMENT).write.option("compression", "zstd").parquet(f"{out}/segments")
    sums = spark.read.parquet(f"{out}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, most_shards at most
    sums.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{out}/shards")


class _Index:
    """A segment row's index: where the ids of a key are."""

    def __init__(self, row: dict):
        self.payload, self.pilots, self.offsets, self.lengths, self.counts = (np.frombuffer(row[c], "<u4") for c in ("payload", "pilots", "offsets", "lengths", "counts"))
        self.prints = np.frombuffer(row["prints"], "<u8").astype(U)
        self.more, self.loose = np.frombuffer(row["more"], "<u4").reshape(-1, 3), np.frombuffer(row["loose"], "<u4").reshape(-1, 2)
        self.base = row["shard_start"] + row["seg_start"]
        self.name = f"shard {row['shard']}, segment {row['segment']}"

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys that are there, and their slots."""
        if not len(self.prints) or not len(keys):
            return keys[:0], np.zeros(0, np.int64)
        print_ = fingerprint(keys)
        slot = slots(print_, self.pilots, len(self.prints))
        hit = self.prints[slot] == print_
        return keys[hit], slot[hit]

    def records(self, keys: np.ndarray, slot: np.ndarray) -> Iterator[tuple]:
        """Key, start among all ids, and ids of each document of the keys."""
        for key, s in zip(keys.tolist(), slot.tolist(), strict=True):
            at, n = int(self.offsets[s]), int(self.lengths[s])
            yield key, self.base + at, self.payload[at : at + n]
            if self.counts[s] > 1:
                for _, _, m in self.more[self.more[:, 0] == s].tolist():  # in order
                    at, n = at + n, m
                    yield key, self.base + at, self.payload[at : at + n]

    def unnamed(self) -> Iterator[tuple]:
        for at, n in self.loose.tolist():
            yield None, self.base + at, self.payload[at : at + n]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key of every segment, looked up through the segment's hash, with its ids."""
    for batch in batches:
        for row in batch.to_pylist():
            index = _Index(row)
            keys = key_of(index.prints)
            found, slot = index.slots(keys)
            if len(found) != len(keys):
                raise ValueError(f"the index of {index.name} is damaged")
            made = [(k, start, len(ids), zlib.crc32(ids.tobytes())) for part in (index.records(found, slot), index.unnamed()) for k, start, ids in part]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _segments(spark: SparkSession, out: str) -> DataFrame:
    start = spark.read.parquet(f"{out}/shards").select("shard", "shard_start")
    return spark.read.parquet(f"{out}/segments").join(F.broadcast(start), "shard")  # most_shards rows at most


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    return _segments(spark, out).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            index = _Index(row)
            found = list(index.records(*index.slots(np.array(row["keys"], np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2].tolist() for f in found], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])


def _shards_of(shard: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each key with the shards (more than one where a run of equal keys goes on) whose ascending ranges hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch["key"].to_numpy()
            first, last = np.searchsorted(hi, key, "left"), np.searchsorted(lo, key, "right")
            many = np.maximum(last - first, 0)
            row = np.repeat(np.arange(len(key)), many)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(shard[at].astype(np.int32))], names=["key", "shard"])

    return run


def lookup(keys: DataFrame, out: str) -> DataFrame:
    """doc_id, start, ids of each of the keys (a column doc_id) that is in the files; others give no row.

    A key finds its shard by two searches in the shards' ranges (at most most_shards), its segment among the shard's own, and its
    ids through the segment's hash. Only segments that are asked for are joined.
    """
    spark = keys.sparkSession
    ranges = spark.read.parquet(f"{out}/shards").filter("first_key is not null").select("shard", "first_key", "last_key").orderBy("shard").toArrow()  # most_shards rows at most
    shard, lo, hi = (ranges[c].to_numpy().astype(np.int64) for c in ("shard", "first_key", "last_key"))
    near = keys.select(F.col("doc_id").cast("long").alias("key")).filter("key is not null").distinct().mapInArrow(_shards_of(shard, lo, hi), "key long, shard int")
    spans = spark.read.parquet(f"{out}/segments").filter("first_key is not null").select("shard", "segment", "first_key", "last_key")
    listed = spans.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("first_key", "last_key", "segment"))).alias("spans"))  # a shard's segments
    mine = F.filter("spans", lambda x: (x["first_key"] <= F.col("key")) & (F.col("key") <= x["last_key"]))
    asked = near.join(listed, "shard").select("shard", "key", F.explode(mine).alias("x")).groupBy("shard", F.col("x.segment").alias("segment")).agg(F.collect_set("key").alias("keys"))
    return _segments(spark, out).join(asked, ["shard", "segment"]).mapInArrow(_finder, "doc_id long, start long, ids array<long>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    out = folder(docs.sparkSession, "ids")
    write(docs, out, path)
    return read_digests(docs.sparkSession, out)
