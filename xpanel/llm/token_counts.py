"""Edit-aware token counts.

A document's state is its text, cut into pre-tokens, with a segment tree over them: leaves are blocks of
pre-tokens holding their characters and token counts, inner nodes the sums of their subtree, in one heap-ordered
array. An edit (start, stop, replacement, in characters of the text as it then is) finds its first block by
descending the tree, goes two pre-tokens further back for context, and cuts the text again from there until a
boundary meets an old one behind the edit; only those pre-tokens are encoded. The touched blocks are
rewritten and the sums on their paths updated. A block that has grown too much has its tree rebuilt.

State tables hold one row per document and survive between jobs: `build_trees` makes them, `apply_edits` joins
edits to them by document and returns the new state. A row has the text, `leaves` (pairs of unsigned 32-bit numbers, block after
block), `ends` (pre-tokens up to each block's end) and `sums` (pairs of 64-bit numbers, node after node). Reading it back makes
views of these; a block is unpacked only when an edit touches it, and the others are copied as they are. Edits of a
document are applied in the order of (seq, start, stop, replacement); bounds beyond the text are clipped and a stop before
the start counts as the start. Null texts count as empty, a null replacement as empty; edits with a null or unknown doc_id
change nothing; rows of a repeated doc_id each get the edits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoder import encoder
from .shared import stored
from .words import groups

CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed value: the vocabulary's own pre-tokens
BLOCK, BACK = 64, 2


class Counter:
    """Token counts of pre-tokens, kept in a bounded table."""

    def __init__(self, path: str, most: int = 400_000):
        self.coder, self.most, self.known = encoder(path, "bytes"), most, {}

    def __call__(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    out[i] = n = len(self.coder.piece(pieces[i].encode()))
                    if len(known) < self.most:
                        known[pieces[i]] = n
        return out


def _heap(leaf: np.ndarray) -> np.ndarray:
    """Node sums (a row of characters and tokens each) in heap order, the root at 1, over the sums of the blocks."""
    width = 1 << max(0, (len(leaf) - 1).bit_length())
    sums = np.zeros((2 * width, 2), np.int64)
    sums[width : width + len(leaf)] = leaf
    while width > 1:
        half = width // 2
        sums[half:width] = sums[width : 2 * width : 2] + sums[width + 1 : 2 * width : 2]
        width = half
    return sums


class Tree:
    """Blocks of pre-tokens (rows of characters and tokens) and the heap of their sums. A stored tree's blocks stay packed until they are asked for."""

    def __init__(self, leaves: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None):
        self.leaves, self.ends, self.changed = leaves, ends, {}
        if sums is None:
            total = np.zeros((len(leaves) + 1, 2), np.int64)
            np.cumsum(leaves, axis=0, out=total[1:], dtype=np.int64)
            at = total[np.r_[0, ends]]
            sums = _heap(at[1:] - at[:-1])
        self.sums = sums
        self.width = len(sums) // 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        n = len(chars)
        return cls(np.array([chars, tokens], np.uint32).T.reshape(n, 2), np.minimum(np.arange(BLOCK, max(n, 1) + BLOCK, BLOCK), n).astype(np.int32))

    @classmethod
    def restored(cls, leaves: bytes, ends: bytes, sums: bytes) -> Tree:
        return cls(np.frombuffer(leaves, "<u4").reshape(-1, 2), np.frombuffer(ends, "<i4"), np.frombuffer(sums, "<i8").reshape(-1, 2).copy())

    def packed(self) -> tuple[bytes, bytes, bytes]:
        if self.changed:
            parts, size, cut = [], np.diff(np.r_[0, self.ends]), np.r_[0, self.ends]
            last = 0
            for b in sorted(self.changed):
                mine = np.array(self.changed[b], np.uint32).reshape(-1, 2)
                parts += [self.leaves[cut[last] : cut[b]], mine]
                size[b], last = len(mine), b + 1
            self.leaves, self.ends, self.changed = np.concatenate([*parts, self.leaves[cut[last] :]]), np.cumsum(size).astype(np.int32), {}
        return self.leaves.astype("<u4").tobytes(), self.ends.astype("<i4").tobytes(), self.sums.astype("<i8").tobytes()

    @property
    def blocks(self) -> int:
        return len(self.ends)

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def block(self, b: int) -> list[list[int]]:
        """The block's pre-tokens as [characters, tokens]."""
        if b not in self.changed:
            return self.leaves[(self.ends[b - 1] if b else 0) : self.ends[b]].tolist()
        return self.changed[b]

    def pieces(self) -> int:
        return sum(len(self.block(b)) for b in self.changed) + sum(int(self.ends[b] - (self.ends[b - 1] if b else 0)) for b in range(self.blocks) if b not in self.changed)

    def find(self, at: int) -> tuple[int, int]:
        """The block with the character `at` (the last one if there is none), and where the block begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if at >= begin + self.sums[i, 0] and self.sums[i + 1, 0]:
                begin += int(self.sums[i, 0])
                i += 1
        return min(i - self.width, self.blocks - 1), begin

    def put(self, b: int, block: list[list[int]]) -> None:
        """Writes a block and the sums on its path."""
        self.changed[b] = block
        i = self.width + b
        self.sums[i] = (sum(p[0] for p in block), sum(p[1] for p in block))
        while i > 1:
            i //= 2
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]


class Document:
    def __init__(self, text: str, tree: Tree, count: Counter):
        self.text, self.tree, self.count, self.encoded = text, tree, count, 0

    @classmethod
    def new(cls, text: str, count: Counter) -> Document:
        pieces = CUT.findall(text)
        return cls(text, Tree.of(list(map(len, pieces)), count(pieces)), count)

    def edit(self, start: int, stop: int, replacement: str) -> None:
        tree, n = self.tree, len(self.text)
        start = min(max(0, start), n)
        stop = min(max(start, stop), n)
        text = self.text[:start] + replacement + self.text[stop:]
        shift = len(replacement) - (stop - start)
        first, at = tree.find(max(0, start - 1))
        inside, here = 0, tree.block(first)
        while inside < len(here) and at + here[inside][0] < start:
            at += here[inside][0]
            inside += 1
        for _ in range(BACK):
            while not inside and first:
                first -= 1
                here = tree.block(first)
                inside = len(here)
            if inside:
                inside -= 1
                at -= here[inside][0]
        # old boundaries from the edit's end on, block by block, until a new one meets one
        old, last, taken, there = at, first, inside, here
        made: list[str] = []
        new = at
        for m in CUT.finditer(text, at):
            made.append(m[0])
            new = m.end()
            while old + shift < new or old < stop:
                while last < tree.blocks and taken >= len(there):
                    last, taken = last + 1, 0
                    there = tree.block(last) if last < tree.blocks else []
                if last >= tree.blocks:
                    break
                old += there[taken][0]
                taken += 1
            if old >= stop and old + shift == new and new >= start + len(replacement):
                break
        else:
            last = tree.blocks
        if last >= tree.blocks:
            last = tree.blocks - 1
            there = tree.block(last)
            taken = len(there)
        self.encoded += len(made)
        head = [*here[:inside], *([len(p), c] for p, c in zip(made, self.count(made)))]
        tail = there[taken:]
        self.text = text
        if first == last:
            head, tail = head + tail, []
        if max(len(head), len(tail)) > 4 * BLOCK:
            pieces = [p for b in range(first) for p in tree.block(b)] + head + tail + [p for b in range(last + 1, tree.blocks) for p in tree.block(b)]
            self.tree = Tree.of([p[0] for p in pieces], [p[1] for p in pieces])
            return
        for b in range(first + 1, last):
            tree.put(b, [])
        tree.put(first, head)
        if last > first:
            tree.put(last, tail)


_STATE = "text string, leaves binary, ends binary, sums binary, n_tokens long"
_COUNTS = ("n_before", "n_tokens", "n_edits", "n_reencoded", "n_pieces")


def _columns(docs: list[Document]) -> list[pa.Array]:
    packed = [d.tree.packed() for d in docs]
    return [pa.array([d.text for d in docs], pa.string()), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(3)), pa.array([d.tree.total for d in docs], pa.int64())]


def _built(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for batch in batches:
            for part in groups(batch, "text"):
                docs = [Document.new(text or "", count) for text in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *_columns(docs)], names=["doc_id", "text", "leaves", "ends", "sums", "n_tokens"])

    return run


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the state of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_built(path), f"doc_id {kind}, {_STATE}")


def _edited(path: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Restores each stored tree, applies the row's edits, and gives counts and, if whole, the new state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for batch in batches:
            for part in groups(batch, "text"):
                docs, rows = [], []
                for text, leaves, ends, sums, edits in zip(*(part[c].to_pylist() for c in ("text", "leaves", "ends", "sums", "edits"))):
                    doc = Document(text, Tree.restored(leaves, ends, sums), count)
                    before = doc.tree.total
                    for e in edits or []:
                        doc.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                    docs.append(doc)
                    rows.append((before, doc.tree.total, len(edits or []), doc.encoded, doc.tree.pieces()))
                counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
                if whole:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *_columns(docs), *(counts[i] for i in (0, 2, 3, 4))], names=["doc_id", "text", "leaves", "ends", "sums", "n_tokens", "n_before", "n_edits", "n_reencoded", "n_pieces"])
                else:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *counts], names=["doc_id", *_COUNTS])

    return run


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def apply_edits(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The new state of every document with n_before, n_edits, n_reencoded (pre-tokens), n_pieces.

    edits: doc_id, seq, start, stop, replacement.
    """
    listed = edits.filter("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    both = trees.select("doc_id", "text", "leaves", "ends", "sums").join(listed, "doc_id", "left")
    return both.mapInArrow(_edited(path, True), f"doc_id {_kind(trees)}, {_STATE}, n_before long, n_edits long, n_reencoded long, n_pieces long")


def _sample_edits() -> Column:
    """Three edits at places fixed by doc_id: an insertion, a deletion and a replacement."""
    size = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
    place = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), size).cast("int")
    rows = ((place(0), place(0), " new words, 12 of"), (place(1), place(1) + 40, ""), (place(2), place(2) + 7, "'ll be\n\n"))
    return F.array(*(F.struct(F.lit(i).alias("seq"), a.alias("start"), b.alias("stop"), F.lit(r).alias("replacement")) for i, (a, b, r) in enumerate(rows)))


def sample_edits(docs: DataFrame) -> DataFrame:
    """The same edits as a table, for apply_edits."""
    return docs.select("doc_id", F.explode(_sample_edits()).alias("e")).select("doc_id", "e.*")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Counts before and after three edits of every document; n_reencoded tells how little was encoded again.

    The trees are written and read back as a later job would. These edits depend on the row alone, so they are attached
    to it; edits that come as a table are joined by apply_edits, through the same restored trees.
    """
    trees = stored(build_trees(docs, path), "trees").withColumn("edits", _sample_edits())
    return trees.mapInArrow(_edited(path, False), f"doc_id {_kind(docs)}, " + ", ".join(f"{k} long" for k in _COUNTS))
