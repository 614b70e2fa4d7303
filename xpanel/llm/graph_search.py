"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by hash, about `shard_vectors` to each however many there are, so building costs the same for
every vector and a task holds one shard. Largest inner product becomes smallest Euclidean distance by one more coordinate,
sqrt(1 - |x|^2), after vectors are divided by the shard's largest norm; a query ranks by its inner products alone, where
that coordinate drops out. A shard's graph is grown in batches: greedy beam searches from the medoid propose neighbours, and
relaxed pruning keeps one only if no kept neighbour is `alpha` times closer to it than the vector itself, so
edges stay few and diverse; reverse edges are added and pruned alike. Two passes, the first with alpha = 1. Every
query block is then searched in every shard by beam search, all its queries in step, and each query's
best are merged by exact double inner products on the original vectors. Searching thus costs queries times shards: it is the
part that grows with the square of the table, by 1 / (20 * shard_vectors) of it.

Equal vectors are one vertex; of each, the k + 1 smallest ids are kept, which is all that ties to smaller ids
can return, so hot vectors cost nothing. Vectors that are null, zero or hold null or non-finite components take no part,
as do null ids; a repeated id counts once for each different vector, and as a query stands for its smallest one. Vectors of
different lengths have no inner product: a query meets those of its own length. Fewer candidates than k are all returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored


class Graph:
    """Vertices in float32, divided by the largest norm, and their added coordinate; edges: vertex x degree, -1 for none."""

    def __init__(self, x: np.ndarray, high: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.high, self.edges, self.entry = x, high, edges, entry
        self.norm = np.einsum("ij,ij->i", x, x)

    def near(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Squared distances between the vertices at[i] and v[i], in terms of the size of their own differences."""
        dot = np.einsum("ij,ij->i", self.x[at], self.x[v])
        return self.norm[at] + self.norm[v] - 2 * dot + (self.high[at] - self.high[v]) ** 2

    def beam(self, q: np.ndarray, width: int, at: np.ndarray | None = None, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each query the `width` nearest vertices found, and their distances; -1 pads.

        Without `at`, a query's distance is its negative inner product; with it, the queries are these vertices. Each step
        opens the `ahead` nearest unopened vertices of every beam.
        """
        n, m = len(q), len(self.x)
        ids = np.full((n, width), -1, np.int64)
        dist = np.full((n, width), np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        seen = np.zeros((n, m), bool)  # m is bounded by the size of a shard
        ids[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, True, True
        live = np.arange(n)
        entry = np.full(n, self.entry)
        dist[:, 0] = -(q @ self.x[self.entry]) if at is None else self.near(at, entry)
        while len(live):
            waiting = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(waiting, ahead - 1, axis=1)[:, :ahead] if width > ahead else np.argsort(waiting, 1)
            rows = np.arange(len(live))[:, None]
            valid = np.isfinite(waiting[rows, pick])
            some = valid.any(1)
            live, pick, valid, rows = live[some], pick[some], valid[some], rows[: int(some.sum())]
            if not len(live):
                break
            open_[live[:, None], pick] &= ~valid
            near = np.where(valid[:, :, None], self.edges[np.where(valid, ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            r, c = np.nonzero((near >= 0) & ~seen[live[:, None], np.maximum(near, 0)])
            v = near[r, c]
            code, first = np.unique(r * m + v, return_index=True)  # vertices that several opened ones lead to
            r, c, v = r[first], c[first], v[first]
            seen[live[r], v] = True
            if at is None:
                new = -np.einsum("ij,ij->i", self.x[v], q[live[r]])
            else:
                new = self.near(at[live[r]], v)
            better = new < dist[live].max(1)[r]  # the worst of the beam
            r, v, new = r[better], v[better], new[better]
            many = np.bincount(r, minlength=len(live))
            most = int(many.max()) if len(r) else 0
            if not most:
                continue
            slot = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            d, i = np.full((len(live), most), np.inf, np.float32), np.full((len(live), most), -1, np.int64)
            d[r, slot], i[r, slot] = new, v
            every_d = np.concatenate([dist[live], d], 1)
            every_i = np.concatenate([ids[live], i], 1)
            every_o = np.concatenate([open_[live], i >= 0], 1)
            top = np.argpartition(every_d, width - 1, axis=1)[:, :width]
            dist[live], ids[live], open_[live] = every_d[rows, top], every_i[rows, top], every_o[rows, top]
        return ids, dist


def _prune(g: Graph, at: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Robust pruning of each vertex's proposals (rows of near, -1 none, no repeats), blocks of vertices in step."""
    if len(at) > 48:
        return np.concatenate([_prune(g, at[i : i + 48], near[i : i + 48], alpha, degree) for i in range(0, len(at), 48)])
    n, many = near.shape
    v = np.maximum(near, 0)
    d = np.where(near >= 0, g.near(np.repeat(at, many), v.reshape(-1)).reshape(n, many), np.inf)
    d[near == at[:, None]] = np.inf
    x = g.x[v]
    norm, high = g.norm[v], g.high[v]
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)) + (high[:, :, None] - high[:, None, :]) ** 2
    between *= alpha * alpha
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for j in range(degree):
        pick = d.argmin(1)
        some = np.isfinite(d[rows, pick])
        if not some.any():
            break
        out[some, j] = near[rows, pick][some]
        d[rows, pick] = np.inf
        d[some[:, None] & (between[rows, pick] <= d)] = np.inf
    return out


def _distinct_rows(a: np.ndarray) -> np.ndarray:
    """Repeats within a row become -1."""
    a = np.sort(a, 1)
    a[:, 1:][a[:, 1:] == a[:, :-1]] = -1
    return a


def build(x: np.ndarray, high: np.ndarray, degree: int = 32, width: int = 32, alpha: float = 1.2, batch: int = 256, seed: int = 1) -> Graph:
    n = len(x)
    random = np.random.default_rng(seed)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((n, degree), -1, np.int64)
    graph = Graph(x, high, edges, entry)
    for a in (1.0, alpha):
        order = random.permutation(n)
        lo, size = 0, 16 if a == 1.0 else batch
        while lo < n:
            at = order[lo : lo + size]
            lo, size = lo + size, min(batch, size * 2)
            found, _ = graph.beam(x[at], width, at)
            # vertices of one batch do not see each other in the graph yet: each is also shown some of them
            peers = at[random.integers(0, len(at), (len(at), min(len(at), 16)))]
            near = _distinct_rows(np.concatenate([found, edges[at], peers], 1))
            edges[at] = _prune(graph, at, near, a, degree)
            r, c = np.nonzero(edges[at] >= 0)
            to, source = edges[at][r, c], at[r]
            by = np.argsort(to, kind="stable")
            to, source = to[by], source[by]
            heads, first, many = np.unique(to, return_index=True, return_counts=True)
            most = int(many.max()) if len(many) else 0
            back = np.full((len(heads), most), -1, np.int64)
            slot = np.arange(len(to)) - np.repeat(first, many)
            back[np.repeat(np.arange(len(heads)), many), slot] = source
            joined = -np.sort(-_distinct_rows(np.concatenate([edges[heads], back], 1)), 1)  # those that are some come first
            held = (joined >= 0).sum(1)
            crowded = held > degree
            edges[heads[~crowded]] = joined[~crowded, :degree]
            for top in (degree + 8, degree + 32, joined.shape[1]):  # rows of like length are pruned together
                mine = np.flatnonzero(crowded & (held <= top))
                crowded[mine] = False
                for i in range(0, len(mine), batch):
                    h = mine[i : i + batch]
                    edges[heads[h]] = _prune(graph, heads[h], joined[h, :top], a, degree)
    return graph


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in float32 after division by the largest norm, and the coordinate that makes them equally long."""
    x = x / np.abs(x).max()
    x = x / np.sqrt((x**2).sum(1).max())
    return x.astype(np.float32), np.sqrt(np.maximum(1 - (x**2).sum(1), 0)).astype(np.float32)


_GRAPH = "dim int, shard int, entry int, x binary, high binary, edges binary, classes binary"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            dim, shard = batch["dim"][i].as_py(), batch["shard"][i].as_py()
            classes = batch["classes"][i].values.to_numpy()
            g = build(*scaled(batch["vectors"][i].values.flatten().to_numpy().reshape(len(classes), dim)))
            packed = [g.x.tobytes(), g.high.tobytes(), g.edges.astype(np.int32).tobytes(), classes.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([g.entry], pa.int32()), *(pa.array([x]) for x in packed)], names=[c.split()[0] for c in _GRAPH.split(", ")])


def _searched(k: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {c: batch[c][i].as_buffer() for c in ("x", "high", "edges", "classes")}
                dim, classes, high = batch["dim"][i].as_py(), np.frombuffer(raw["classes"], np.int64), np.frombuffer(raw["high"], np.float32)
                edges = np.frombuffer(raw["edges"], np.int32).astype(np.int64).reshape(len(classes), -1)
                graph = Graph(np.frombuffer(raw["x"], np.float32).reshape(-1, dim), high, edges, batch["entry"][i].as_py())
                names = batch["queries"][i].values.to_numpy()
                q = batch["vectors"][i].values.flatten().to_numpy().reshape(-1, dim)
                q = (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)  # a query's own size changes no order
                for lo in range(0, len(q), 256):
                    ids, dist = graph.beam(q[lo : lo + 256], max(width, k + 1))
                    order = np.argsort(dist, 1, kind="stable")[:, : k + 1]
                    ids = np.take_along_axis(ids, order, 1)
                    r, c = np.nonzero(ids >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo + r]), pa.array(classes[ids[r, c]])], names=["query_id", "class"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, width: int = 80, shard_vectors: int = 4096, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vec_id, embedding whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = good.filter(~bad & F.exists("embedding", lambda v: v != 0)).select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("class"))
    one = stored(good.groupBy("class", "dim").agg(F.first("embedding").alias("embedding")), "vectors")
    sizes = one.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_vectors).cast("int").alias("shards"))
    sizes = stored(sizes, "sizes")  # a row for each length of vectors
    total = sizes.agg(F.sum("shards")).first()[0]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = good.select("class", "vec_id").distinct()
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).filter(F.col("place") <= k + 1).select("class", "vec_id")
    dealt = one.join(F.broadcast(sizes), "dim").groupBy("dim", F.pmod(F.xxhash64("class", F.lit(3)), "shards").cast("int").alias("shard")).agg(F.sort_array(F.collect_list(F.struct("class", "embedding"))).alias("x"))
    dealt = stored(dealt.select("dim", "shard", F.col("x.class").alias("classes"), F.col("x.embedding").alias("vectors")), "shards")
    graphs = stored(dealt.repartitionByRange(min(total, 1 << 14), "dim", "shard").mapInArrow(_built, _GRAPH), "graphs")  # a task for each
    asked = good.filter(F.col("vec_id") % every == 0)
    queries = stored(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", "embedding", F.size("embedding").alias("dim")), "queries")
    count = max(1, -(-queries.count() // block))
    blocks = queries.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    blocks = blocks.select("dim", F.col("x.vec_id").alias("queries"), F.col("x.embedding").alias("vectors"))
    tasks = blocks.join(F.broadcast(sizes), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(graphs, ["dim", "shard"])
    found = tasks.select("queries", "vectors", "dim", "entry", "x", "high", "edges", "classes").mapInArrow(_searched(k, width), "query_id long, class long")
    dot = F.aggregate(F.zip_with("a", "b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = found.join(one.select("class", F.col("embedding").alias("a")), "class").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("b")), "query_id").select("query_id", "class", dot.alias("score"))
    named = scored.join(few, "class").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
