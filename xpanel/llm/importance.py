"""Importance resampling of documents towards a target corpus, by bucket-partitioned inverted postings.

A document's features are its runs of one to three words; a feature falls into a bucket by the CRC-32 of its bytes. A task turns
a block of documents into postings, (bucket, document, count) with the buckets in order, packed into a row for each part of the
bucket range, and writes them once; so what is shuffled later is the packed lists. Both corpora's counts are grouped by bucket,
which gives a bucket's gain from the bucket alone and the two totals. Postings meet the gains of their part of the range in a join
by part and salt (`per_salt` blocks of documents each, so that a bucket that every document has is split among many tasks); what
a document gains in a part is emitted there, and the contributions are summed by document. The draw is Gumbel top-k: documents are
ordered by ranges, counted for each range, and a rank is the place within its range after the ranges before.

A null text has no words, and a document without features has weight 0. A null key counts as an empty one in the draw's hash and
stands last among equal scores; then the place of a row decides, so that repeated rows are drawn one by one. Rows keep their own
identity throughout, whatever their keys. An empty target has t = 0 everywhere; no documents give no rows. Documents of fewer than
`least_words` words are scored and never drawn. No other column of the input is read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .words import Words, folded, groups

BUCKETS = 10_000
PARTS = 16  # of the range of buckets
LONGEST = 64  # bytes of a word whose shifts are looked up in one step
_MOST_DOCS = 512  # documents of a block
_POLYNOMIAL = 0xEDB88320
_FOLD = np.full(256, 32, np.uint8)  # what separates words becomes a space, capitals become small
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(_POLYNOMIAL), x >> 1)
    return x


_STEP = _byte_table()


def _lookup(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by what each of their four bytes becomes."""
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps that append 0 to LONGEST + 1 zero bytes to a CRC, and those for 2^k zero bytes."""
    own = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    short = [own]
    for _ in range(LONGEST + 1):
        short.append(_STEP[short[-1] & 255] ^ (short[-1] >> 8))
    powers = [short[1]]
    while len(powers) < 40:
        powers.append(_lookup(powers[-1], powers[-1]))
    return np.stack(short), powers


_SHORT, _POWERS = _tables()
_FLAT = np.ascontiguousarray(_SHORT.transpose(1, 0, 2)).reshape(4, -1)  # byte, then (length, value)


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC after so many zero bytes more; CRC(a + b) is shifted(CRC(a), len(b)) ^ CRC(b)."""
    row = np.minimum(zeros, LONGEST + 1) << 8
    out = _FLAT[0][row + (crc & 255)] ^ _FLAT[1][row + ((crc >> 8) & 255)] ^ _FLAT[2][row + ((crc >> 16) & 255)] ^ _FLAT[3][row + (crc >> 24)]
    for i in [np.flatnonzero(zeros > LONGEST + 1)]:
        x, n = crc[i], zeros[i].astype(np.int64)
        for k, table in enumerate(_POWERS):
            some = (n >> k) & 1 == 1
            x = np.where(some, _lookup(table, x), x)
        out[i] = x
    return out


def word_crcs(w: Words) -> np.ndarray:
    """The CRC-32 of every word, a byte of all words at a time; words of more than LONGEST bytes one by one."""
    size = w.end - w.start
    order = np.argsort(-np.minimum(size, LONGEST + 1).astype(np.int16), kind="stable")
    start, size_of = w.start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long_ = int(np.searchsorted(-size_of, -LONGEST, "left")) if len(order) else 0
    ascending = size_of[::-1]
    for k in range(int(size_of[long_]) if long_ < len(order) else 0):
        m = len(order) - int(np.searchsorted(ascending, k, "right"))
        x = crc[long_:m]
        crc[long_:m] = _STEP[(x ^ w.data[start[long_:m] + k]) & 255] ^ (x >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    for i in order[:long_]:
        out[i] = zlib.crc32(w.data[w.start[i] : w.end[i]])
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of one to three words, and the texts' numbers of words."""
    w = Words(folded(texts, _FOLD))
    many = np.diff(w.at)
    doc = np.repeat(np.arange(len(many)), many)
    one = word_crcs(w)
    more = w.end - w.start + 1
    spaced = shifted(np.full(len(one), zlib.crc32(b" "), np.uint32), more - 1) ^ one
    found, owner, run = [one], [doc], one
    for n in (2, 3):
        run = shifted(run[: max(0, len(one) - n + 1)], more[n - 1 :]) ^ spaced[n - 1 :]
        whole = doc[: len(run)] == doc[n - 1 :]
        found.append(run[whole])
        owner.append(doc[: len(run)][whole])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(owner), many


def n_features(words: np.ndarray) -> np.ndarray:
    return words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)


def _counted(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, text and count of each posting in order of bucket and text, and the texts' numbers of words."""
    bucket, doc, words = features(texts, buckets)
    n = max(1, len(words))
    code = bucket * n + doc
    if len(code) * 16 < buckets * n:
        code, count = np.unique(code, return_counts=True)
    else:
        dense = np.bincount(code, minlength=buckets * n)
        code = np.flatnonzero(dense)
        count = dense[code]
    return code // n, code % n, count, words


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in groups(batch, "text", 1 << 22):
            for i in range(0, group.num_rows, _MOST_DOCS):
                yield group.slice(i, _MOST_DOCS)


def _postings(buckets: int, row: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block: a row with its documents (part -1) and one for each part of the buckets with its postings."""
    width = -(-buckets // PARTS)
    kind = pa.struct([("row", row), ("seed", pa.string()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, zstd = TaskContext.get().partitionId() << 32, pa.Codec("zstd", 1)
        for i, part in enumerate(_blocks(batches)):
            bucket, doc, count, words = _counted(part["text"], buckets)
            n = part.num_rows
            docs = pa.StructArray.from_arrays([part["row"], part["seed"], pa.array(words)], fields=list(kind))
            sums = np.bincount(bucket, count, buckets).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(PARTS + 1) * width)
            made = [(-1, n, 0, None, None)]
            for p in range(PARTS):
                mine = slice(cut[p], cut[p + 1])
                code = (bucket[mine] - p * width) * n + doc[mine]
                packed = np.concatenate([np.diff(code, prepend=0), count[mine]]).astype(np.uint32).tobytes()
                if len(code):
                    made.append((p, n, len(code), zstd.compress(packed, asbytes=True), sums[p * width : (p + 1) * width].tolist()))
            parts, sizes, many, lists, totals = zip(*made, strict=True)
            rows = pa.ListArray.from_arrays(pa.array([0, *[n] * len(made)], pa.int32()), docs)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([first + i] * len(made), pa.int64()), pa.array(sizes, pa.int32()), pa.array(many, pa.int32()), pa.array(lists, pa.binary()), pa.array(totals, pa.list_(pa.int64())), rows], names=["part", "block", "n_docs", "many", "postings", "sums", "docs"])

    return run


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each document of a row of postings gains there."""
    zstd = pa.Codec("zstd")
    for batch in batches:
        for row in batch.to_pylist():
            m, n = row["many"], row["n_docs"]
            both = np.frombuffer(zstd.decompress(row["postings"], 8 * m), np.uint32).astype(np.int64)
            code = np.cumsum(both[:m])
            weight = np.bincount(code % n, np.array(row["gains"], np.int64)[code // n] * both[m:], n).astype(np.int64)  # far below 2^53
            some = np.flatnonzero(np.bincount(code % n, minlength=n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["block"])), pa.array(some.astype(np.int32)), pa.array(weight[some])], names=["block", "place", "weight"])


def _by_bucket(postings: DataFrame, name: str, other: str, width: int) -> DataFrame:
    one = postings.filter("part >= 0").select("part", F.posexplode("sums").alias("i", "n")).filter("n > 0")
    return one.groupBy((F.col("part") * width + F.col("i")).alias("bucket")).agg(F.sum("n").alias(name)).select("bucket", name, F.lit(0).cast("long").alias(other))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, part, place in it, s, t and gain of every bucket, from both corpora's postings."""
    width = -(-buckets // PARTS)
    both = _by_bucket(documents, "s", "t", width).unionByName(_by_bucket(target, "t", "s", width))
    all_ = documents.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    met = both.unionByName(all_).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = Window.partitionBy()  # a row for each bucket
    odds = (F.col("t") + 1.0) * (F.sum("s").over(whole) + float(buckets)) / ((F.col("s") + 1.0) * (F.sum("t").over(whole) + float(buckets)))
    return met.select("bucket", F.floor(F.col("bucket") / width).cast("int").alias("part"), (F.col("bucket") % width).cast("int").alias("i"), "s", "t", F.floor(1000.0 * F.log(odds)).alias("gain"))


def _noise(seed: Column, salt: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(seed, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _scored(docs: DataFrame, target: DataFrame, buckets: int, salt: int, per_salt: int) -> DataFrame:
    """row, n_words, n_features, weight, score, block, place. docs has row, seed and text; target has text."""
    width = -(-buckets // PARTS)
    kind = docs.schema["row"].dataType
    arrow = docs.select("row").limit(0).toArrow().schema.field(0).type
    columns = f"part int, block long, n_docs int, many int, postings binary, sums array<long>, docs array<struct<row:{kind.simpleString()},seed:string,n_words:long>>"
    made = stored(docs.mapInArrow(_postings(buckets, arrow), columns), "postings")
    aim = target.select(F.lit(0).alias("row"), F.lit("").alias("seed"), F.col("text").cast("string").alias("text"))
    theirs = aim.mapInArrow(_postings(buckets, pa.int32()), columns.replace(f"row:{kind.simpleString()}", "row:int"))
    gain = stored(gains(made, theirs, buckets), "gains")
    salts = max(1, made.filter("part = -1").count() // per_salt)
    listed = gain.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "gain"))), lambda x: x["gain"]).alias("gains"))
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = made.filter("part >= 0").select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "n_docs", "many", "postings")
    parts = dealt.join(listed.hint("merge"), ["part", "salt"]).select("block", "n_docs", "many", "postings", "gains").mapInArrow(_contributions, "block long, place int, weight long")
    named = made.filter("part = -1").select("block", F.posexplode("docs").alias("place", "d"))
    nothing = named.select("block", "place", F.lit(0).cast("long").alias("weight"))
    weights = parts.unionByName(nothing).groupBy("block", "place").agg(F.sum("weight").alias("weight"))
    n = F.col("d.n_words")
    counted = (n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).alias("n_features")
    joined = weights.join(named.select("block", "place", "d.row", n.alias("n_words"), counted, _noise(F.col("d.seed"), salt).alias("noise")), ["block", "place"])
    return joined.select("row", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), "block", "place")


def _ranked(docs: DataFrame, target: DataFrame, key: str, buckets: int, salt: int, per_cent: int, least_words: int, per_salt: int) -> DataFrame:
    scored = _scored(docs, target, buckets, salt, per_salt)
    able = (F.col("n_words") >= least_words).alias("able")
    order = [F.col("able").desc(), F.col("score").desc(), F.col(f"row.{key}").asc_nulls_last(), F.col("block"), F.col("place")]
    rows = stored(scored.select("*", able), "scored")
    places = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    places = stored(places.select("row", "n_words", "n_features", "weight", "score", "able", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "ordered")
    counts = places.groupBy("range").agg(F.count_if("able").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * per_cent / 100).alias("wanted"))
    rank = F.col("before") + F.col("at") + 1
    return places.join(F.broadcast(starts), "range").withColumn("rank", F.when(F.col("able") & (rank <= F.col("wanted")), rank))  # a row for each range


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, salt: int = 42, per_cent: int = 5, least_words: int = 20, per_salt: int = 256) -> DataFrame:
    """The drawn documents with their columns, and weight, score and rank, which replace columns of these names."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")
    at = docs.columns.index(key)
    made = _ranked(docs.select(row, F.col(f"`{key}`").cast("string").alias("seed"), F.col(f"`{text}`").cast("string").alias("text")), target, f"c{at}", buckets, salt, per_cent, least_words, per_salt)
    kept = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("weight", "score", "rank")]
    return made.filter("rank is not null").select(*kept, "weight", "score", "rank")


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    made = _ranked(docs.select(F.struct("doc_id").alias("row"), F.col("doc_id").cast("string").alias("seed"), "text"), target, "doc_id", BUCKETS, 42, 5, 20, 256)
    return made.select("row.doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH bits AS (
  SELECT list(list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS crc FROM range(256) AS t(b)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), runs AS (
  SELECT 0 AS side, rid, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS many FROM d, unnest(range(1, len(w) + 1)) AS t(i), range(1, 4) AS u(n) WHERE i + n - 1 <= len(w) GROUP BY ALL
  UNION ALL
  SELECT 1, rid, array_to_string(w[i:i + n - 1], ' '), count(*) FROM b, unnest(range(1, len(w) + 1)) AS t(i), range(1, 4) AS u(n) WHERE i + n - 1 <= len(w) GROUP BY ALL
), named AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda s, x: xor(s >> 8, crc[CAST(xor(s, x) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM runs), bits
), counted AS (
  SELECT side, rid, bucket, sum(many) AS many FROM runs JOIN named USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, sum(many) FILTER (side = 0) AS s, coalesce(sum(many) FILTER (side = 1), 0) AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM sums) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT sum(t) FROM sums) + 10000.0::DOUBLE)))) AS gain FROM sums
), weights AS (
  SELECT rid, CAST(sum(many * gain) AS BIGINT) AS weight FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY rid
), scored AS (
  SELECT rid, doc_id, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (rid)
), drawn AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE able
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 5 // 100 FROM scored WHERE able) THEN rank END AS rank FROM scored LEFT JOIN drawn USING (rid)
"""


def brute_force(docs: list[tuple[int | None, str | None]], target: list[str | None], buckets: int = BUCKETS, per_cent: int = 5, least_words: int = 20) -> list[tuple]:
    """doc_id, n_features, weight, score, rank of each document in turn, for tests."""

    def runs(text: str | None) -> tuple[int, Counter]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))

    own, other, s, t = [runs(x) for _, x in docs], [runs(x)[1] for x in target], Counter(), Counter()
    for _, c in own:
        s.update(c)
    for c in other:
        t.update(c)
    of = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    made = []
    for (doc_id, _), (words, c) in zip(docs, own, strict=True):
        h = int(sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(of[b] * n for b, n in c.items())
        made.append([doc_id, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((m for m in made if m[5] >= least_words), key=lambda m: (-m[3], m[0] is None, m[0] or 0))
    for i, m in enumerate(able[: per_cent * len(able) // 100]):
        m[4] = i + 1
    return [tuple(m[:5]) for m in made]
