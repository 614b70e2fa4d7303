"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents become token pieces of at most `capacity` (only longer ones are cut; their first piece is the short
one). Pieces are dealt at random into blocks of about `block` pieces; each block is one packing problem. Several
islands evolve each block in tasks of their own: crossover injects a random half of the well-filled bins
of one parent into the other, bins that lose a piece to an injected one are dissolved, and the displaced
pieces are put back best-fit, largest first. Between epochs every island sends its elite to the next
one. Evolution stops where the lower bound ceil(sum / capacity) is met, after PATIENCE generations without gain or at the last generation;
best-fit alone meets the bound in many blocks of ordinary lengths;
where it does not, the generations run (state tables hold their number and the bins before and after). Bins that stay poorly filled are
released, gathered whole into new blocks and evolved once more from that grouping, so a block is never packed worse.

Only lengths travel; a block is bounded by construction whatever the keys. Null texts count as empty, and
every document ends with id 0, so each row gives at least one piece. Null and repeated doc_ids are kept as rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoder import encoder
from .shared import stored
from .words import groups

END = 0
PATIENCE = 8  # generations without a better solution after which an island rests


def _pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, "bytes")
        for batch in batches:
            for part in groups(batch, "text"):
                ids, at = coder.encode(part["text"])
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(part.num_rows):
                    mine = np.append(ids[at[i] : at[i + 1]], np.uint32(END)).astype("<u4")
                    first = len(mine) - capacity * (math.ceil(len(mine) / capacity) - 1)
                    lo = 0
                    for p, hi in enumerate(range(first, len(mine) + 1, capacity)):
                        row.append(i)
                        piece.append(p)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(mine[lo:hi].tobytes()))
                        lo = hi
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Block:
    """One packing problem. A solution is the bin of each piece, bins numbered from 0."""

    def __init__(self, size: np.ndarray, capacity: int, seed: int):
        self.size, self.capacity, self.random = size, capacity, np.random.default_rng(seed)
        self.bound = math.ceil(int(size.sum()) / capacity)

    def fill(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.size).astype(np.int64)

    def worth(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then bins that are rather full or empty than middling."""
        full = self.fill(bins)
        return len(full), -float(((full / self.capacity) ** 2).mean())

    def best_fit(self, bins: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Puts the pieces in order each into the open bin it leaves least room in; -1 marks what is not placed yet."""
        placed = bins >= 0
        count = int(bins.max()) + 1 if placed.any() else 0
        room = self.capacity - np.bincount(bins[placed], self.size[placed], count).astype(np.int64)
        with_room: dict[int, list[int]] = {}
        mask = 0
        for b, r in enumerate(room.tolist()):
            if r:
                with_room.setdefault(r, []).append(b)
                mask |= 1 << r
        size = self.size.tolist()
        for i in order.tolist():
            s = size[i]
            above = mask >> s
            if above:
                r = s + (above & -above).bit_length() - 1
                b = with_room[r].pop()
                if not with_room[r]:
                    mask ^= 1 << r
            else:
                b, r = count, self.capacity
                count += 1
            bins[i] = b
            if r > s:
                left = r - s
                if not with_room.setdefault(left, []):
                    mask |= 1 << left
                with_room[left].append(b)
        return bins

    def tight(self, bins: np.ndarray, which: np.ndarray, slack: int) -> np.ndarray:
        """Pieces not placed yet fill new bins by threes or pairs of at most that slack, largest first; the others are put best-fit."""
        by = which[np.argsort(self.size[which], kind="stable")]
        count = int(bins.max()) + 1 if (bins >= 0).any() else 0
        rest = []
        while len(by) > 2:
            seed, by = by[-1], by[:-1]
            v = self.size[by]
            room = self.capacity - self.size[seed]
            j = np.searchsorted(v, room - v, "right") - 1
            j -= j == np.arange(len(v))  # a piece is no partner of its own
            total = np.where(j >= 0, v + v[np.maximum(j, 0)], v)
            total[v > room] = 0  # the seed alone
            i = int(total.argmax())
            if total[i] < room - slack:
                rest.append(seed)
                continue
            mine = [] if not total[i] else [i, int(j[i])] if j[i] >= 0 else [i]
            bins[[seed, *by[mine]]] = count
            count += 1
            by = np.delete(by, mine)
        return self.best_fit(bins, self.falling(np.array([*rest, *by], np.int64)))

    def falling(self, which: np.ndarray) -> np.ndarray:
        return which[np.argsort(-self.size[which], kind="stable")]

    def fresh(self, noise: float) -> np.ndarray:
        order = np.argsort(-self.size * (1 + noise * self.random.random(len(self.size))), kind="stable")
        return self.best_fit(np.full(len(self.size), -1, np.int64), order)

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a with a random half of b's well-filled bins; displaced pieces fill new bins tightly or are put best-fit, by turns of chance."""
        full = self.fill(b)
        good = full >= np.quantile(full, 0.3)
        give = (good & (self.random.random(len(full)) < 0.5))[b]
        gone = np.zeros(int(a.max()) + 1, bool)
        gone[a[give]] = True  # bins that hold an injected piece are dissolved
        weak = self.fill(a)
        gone[self.random.permutation(np.argsort(weak)[: max(4, len(weak) // 4)])[: max(2, len(weak) // 8)]] = True
        kept = ~gone[a] & ~give
        child = np.full(len(a), -1, np.int64)
        child[kept] = np.unique(a[kept], return_inverse=True)[1]
        base = int(child.max()) + 1 if kept.any() else 0
        if give.any():
            child[give] = base + np.unique(b[give], return_inverse=True)[1]
        out = np.flatnonzero(child < 0)
        return self.tight(child, out, self.capacity // 200) if self.random.random() < 0.5 else self.best_fit(child, self.falling(out))

    def evolve(self, elite: list[np.ndarray], population: int, generations: int) -> list[np.ndarray]:
        """The two best solutions found; elite holds groupings with any labels. Sets first, last (bins) and ran (generations)."""
        elite = [np.unique(x, return_inverse=True)[1] for x in elite] or [self.fresh(0.0)]
        self.ran, self.first = 0, self.worth(elite[0])[0]
        if self.first > self.bound:
            made = [self.tight(np.full(len(self.size), -1, np.int64), np.arange(len(self.size)), self.capacity // 200)]
            elite = elite + made + [self.fresh(0.05 * (i + 1)) for i in range(max(0, population - len(elite) - 1))]
        elite = sorted(elite, key=self.worth)
        since, best = 0, self.worth(elite[0])
        for _ in range(generations):
            if best[0] <= self.bound or len(elite) < 2 or since >= PATIENCE:
                break
            self.ran, since = self.ran + 1, since + 1
            made = []
            for _ in range(population):
                x, y = self.random.choice(len(elite), 2, replace=False)
                made.append(self.cross(elite[min(x, y)], elite[max(x, y)]))
            elite = sorted(elite + made, key=self.worth)[:population]
            if self.worth(elite[0]) < best:
                since, best = 0, self.worth(elite[0])
        self.last = self.worth(elite[0])[0]
        return elite[:2]


_STATE = "block long, island int, uid array<long>, size array<int>, elite array<array<long>>, bins int, bins_before int, generations int"


def _evolved(capacity: int, population: int, generations: int, epoch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                it = Block(np.array(row["size"], np.int64), capacity, (row["block"] * 1_000_003 + row["island"] * 101 + epoch) & 0x7FFFFFFF)
                best = it.evolve([np.array(x, np.int64) for x in row["elite"]], population, generations)
                row |= {"elite": [x.tolist() for x in best], "bins": it.last, "bins_before": it.first, "generations": it.ran}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("uid", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("elite", pa.list_(pa.list_(pa.int64()))), ("bins", pa.int32()), ("bins_before", pa.int32()), ("generations", pa.int32())]))

    return run


def _epochs(start: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """uid, block, bin of the best solution of each block. start: block, uid, size, elite (possibly empty)."""
    state = start.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "uid", "size", "elite", *(F.lit(0).alias(c) for c in ("bins", "bins_before", "generations")))
    for epoch in range(epochs):
        if epoch:  # every island's best goes to its neighbour
            guest = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite")[0].alias("guest"))
            state = state.join(guest, ["block", "island"]).withColumn("elite", F.array_append("elite", F.col("guest"))).drop("guest")
        state = stored(state.repartition("block", "island").mapInArrow(_evolved(capacity, population, generations, epoch), _STATE), "islands")
    best = state.groupBy("block").agg(F.min_by(F.struct("uid", F.col("elite")[0].alias("bin"), "size"), F.struct("bins", "island")).alias("x"))
    return best.select("block", F.explode(F.arrays_zip("x.uid", "x.bin", "x.size")).alias("y")).select("block", "y.*")


def pack(lengths: DataFrame, capacity: int = 2048, block: int = 4096, islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 40, well_filled: float = 0.98) -> DataFrame:
    """uid, sequence_id, offset for rows of uid (long, different) and length (1 to capacity)."""
    total = lengths.count()
    blocks = max(1, round(total / block))
    deal = lengths.select("uid", F.col("length").cast("int").alias("size"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    none = F.array().cast("array<array<long>>")
    start = deal.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("uid", "size"))).alias("x")).select("block", "x.uid", "x.size", none.alias("elite"))
    first = stored(_epochs(start, capacity, islands, epochs, population, generations), "packed")
    bins = first.groupBy("block", "bin").agg(F.sum("size").alias("full"))
    weak = stored(bins.filter(F.col("full") < well_filled * capacity), "weak")
    again = max(1, round(weak.count() * total / max(1, bins.count()) / block))
    moved = first.join(weak, ["block", "bin"]).select("uid", "size", (F.col("block") * (1 << 21) + F.col("bin")).alias("old"), F.pmod(F.xxhash64("block", "bin", F.lit(1)), F.lit(again)).alias("block"))
    grouped = moved.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("old", "uid", "size"))).alias("x"))
    start = grouped.select("block", "x.uid", "x.size", F.array("x.old").alias("elite"))
    second = _epochs(start, capacity, islands, 1, population, generations)
    done = first.join(weak, ["block", "bin"], "left_anti").select("uid", "size", (F.col("block") * (1 << 21) + F.col("bin")).alias("sequence_id"))
    both = done.union(second.select("uid", "size", (F.col("block") * (1 << 21) + (1 << 20) + F.col("bin")).alias("sequence_id")))
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity rows
    return both.select("uid", "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = stored(pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return made.join(pack(made.select("uid", "length"), capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
