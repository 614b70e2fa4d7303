"""Whole texts to token ids with the tokenizers library, each different piece of text encoded once.

A text is cut only between words and white space, where the tokenizers' own pre-tokenizers always cut, so the
pieces' ids do not depend on their neighbours. Pieces are kept, by 64-bit hash, in a bounded table of the worker
process; when it is full, further pieces are encoded wherever they occur. A text with white space that is not
ASCII, or that ends in white space, is given to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import U, Words, span_hashes

MOST = 1_200_000  # pieces kept by a worker process, about 60 MB
_SLOTS = 1 << 21
_ODD_SPACE = "[\\x1c-\\x1f\u0085   -     　]"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # control strings in a text are ordinary text
    return t


def _byte_letters() -> list[str]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class _Table:
    """64-bit hashes to small integers, by open addressing; looked up and filled in arrays."""

    def __init__(self):
        self.key, self.value, self.size = np.zeros(_SLOTS, U), np.zeros(_SLOTS, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), (h & U(_SLOTS - 1)).astype(np.int64)
        while len(left):
            k = self.key[at]
            hit = k == h[left]
            out[left[hit]] = self.value[at[hit]]
            go = ~hit & (k != 0)
            left, at = left[go], (at[go] + 1) & (_SLOTS - 1)
        return out

    def add(self, h: np.ndarray, value: np.ndarray) -> None:
        self.size += len(h)
        left, at = np.arange(len(h)), (h & U(_SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.key[at] == 0
            self.key[at[free]] = h[left[free]]
            mine = free & (self.key[at] == h[left])
            self.value[at[mine]] = value[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & (_SLOTS - 1)


class Encoder:
    """kind "words": white space only separates (a vocabulary with word ends); "bytes": it belongs to the next word."""

    def __init__(self, path: str, kind: str):
        if kind not in ("words", "bytes"):
            raise ValueError(kind)
        self.tokenizer, self.kind = _tokenizer(path), kind
        self.model, self.stand_in = self.tokenizer.model, _byte_letters()
        self.table, self.flat, self.start = _Table(), np.zeros(1 << 20, np.uint32), np.zeros(MOST + 1, np.int64)
        self.marks: dict[bytes, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, piece: bytes) -> list[int] | None:
        """Ids of one pre-token of letters, straight from the model; None if the piece is anything else."""
        if self.kind == "words":
            return [t.id for t in self.model.tokenize(piece.decode().lower())] if piece.isalpha() else None
        if not (piece[1:] if piece[:1] == b" " else piece).decode().isalpha():
            return None
        return [t.id for t in self.model.tokenize("".join(map(self.stand_in.__getitem__, piece)))]

    def _mark(self, piece: bytes) -> list[int]:
        if piece not in self.marks:
            self.marks[piece] = self.whole(piece.decode())
        return self.marks[piece]

    def piece(self, piece: bytes) -> list[int]:
        head, tail = [], []
        body = piece
        if self.kind == "bytes" and body[:1] == b"\n" and len(body) > 1 and not body[1:2].isspace():
            head, body = self._mark(b"\n"), body[1:]  # a single line end before a word is a pre-token of its own
        if body[-1:] in (b",", b".", b"|", b"!", b";", b":") and len(body) > 1 and body[-2:-1].isalpha():
            tail, body = self._mark(body[-1:]), body[:-1]  # as is one mark after letters
        ids = self._letters(body)
        return self.whole(piece.decode()) if ids is None else head + ids + tail

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
        w = Words(texts)
        start = w.start
        if self.kind == "bytes" and len(start):
            start = np.r_[0, w.end[:-1]]
            some = np.diff(w.at) > 0
            start[w.at[:-1][some]] = w.byte_at[:-1][some]
        return start, w.end, w.at, w

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(texts), bool)
        if self.kind == "bytes":
            odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        start, end, at, w = self._pieces(texts)
        if self.kind == "bytes":
            last = np.where(np.diff(at) > 0, w.end[np.maximum(at[1:], 1) - 1] if len(w.end) else 0, w.byte_at[:-1])
            odd = odd | (last < w.byte_at[1:])
        h = span_hashes(w.data, start, end)
        h[h == 0] = 1
        found = self.table.find(h)
        many = np.zeros(len(h), np.int64)
        flat, extra = self.flat, None
        lost = np.flatnonzero(found < 0)
        if len(lost):
            key, first = np.unique(h[lost], return_index=True)
            ids = [self.piece(w.data[start[i] : end[i]].tobytes()) for i in lost[first]]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            new = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
            used, room = self.table.size, MOST - self.table.size
            if len(key) <= room:
                begin = self.start[used]
                if begin + len(new) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(new)), np.uint32)])
                self.flat[begin : begin + len(new)] = new
                self.start[used + 1 : used + 1 + len(key)] = begin + np.cumsum(size)
                self.table.add(key, np.arange(used, used + len(key), dtype=np.int32))
                found[lost] = used + np.searchsorted(key, h[lost])
                flat = self.flat
            else:
                extra = (np.searchsorted(key, h[lost]), size, np.cumsum(size) - size)
                flat = np.concatenate([self.flat, new])
        known = np.maximum(found, 0)
        lo = self.start[known]
        many = self.start[known + 1] - lo
        if extra is not None:
            which, size, begin = extra
            lo[lost], many[lost] = len(self.flat) + begin[which], size[which]
        stop = np.cumsum(many)
        out = flat[np.repeat(lo - stop + many, many) + np.arange(stop[-1] if len(stop) else 0)]
        offsets = np.r_[0, stop][at]
        if odd.any():
            parts = [np.array(self.whole(texts[i].as_py()), np.uint32) if odd[i] else out[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            out = np.concatenate(parts)
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
        return out, offsets


_made: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker process's encoder of that vocabulary; it outlives a task where Spark reuses the worker."""
    if (path, kind) not in _made:
        _made[path, kind] = Encoder(path, kind)
    return _made[path, kind]
