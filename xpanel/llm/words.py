"""Words of whole texts as NumPy arrays, used inside Arrow tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D. Every hash is 64 bits wide and
depends on content only, so the same word or word run hashes alike in every task and document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BLOCK = 1 << 20  # bytes hashed at a time; bounds the working arrays whatever the text length
_BASE = U(0x9E3779B97F4A7C15 | 1)
_GRAM = U(0xD6E8FEB86659FD93 | 1)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: U) -> U:
    return U(pow(int(base), -1, 1 << 64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended on demand."""

    def __init__(self, base: U):
        self.base, self.up, self.down = base, _powers(base, 1), _powers(base, 1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(_inverse(self.base), n)
        return self.up, self.down


_bytes, _grams = _Powers(_BASE), _Powers(_GRAM)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each of the ascending spans start:end of the bytes."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _BLOCK, "right")))
        part = data[lo : end[j - 1]]
        up, down = _bytes.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] ^ (e - s).astype(U))
        i = j
    return out


class Words:
    """The words of a group of texts: byte spans, hashes, and the range of words of each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = ~_SEP[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        starts[edge] = inside[edge]  # a text's first byte and its neighbour's last belong to different words
        ends[edge - 1] = inside[edge - 1]
        self.data, self.start, self.end = data, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.byte_at, self.at = at, np.searchsorted(self.start, at)  # text i has words at[i]:at[i + 1]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def texts(self, lo: int, hi: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k word hashes, by doubling; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, size, power, step = None, 0, h, 1
    while step <= k:
        if k & step:
            out = power.copy() if out is None else out[: len(h) - size - step + 1] * _grams.upto(step + 1)[0][step] + power[size : len(h) - step + 1]
            size += step
        if 2 * step <= k:
            power = power[: len(power) - step] * _grams.upto(step + 1)[0][step] + power[step:]
        step *= 2
    return mix(out[:n])


def runs(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The hash of the word hashes lo:hi of each run of any length."""
    up, down = _grams.upto(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] ^ mix((hi - lo).astype(U)))


def leftmost_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of every window of w values."""
    best, size = np.arange(len(v)), 1
    while size < w:
        step = min(size, w - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(v[b] < v[a], b, a)
        size += step
    return best


def groups(table: pa.RecordBatch, column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are at most so many bytes together, or one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(table[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n = 0, table.num_rows
    while i < n:
        done = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, done + most_bytes, "right")))
        yield table.slice(i, j - i)
        i = j


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def folded(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with every byte replaced by its entry; a table that keeps ASCII bytes ASCII and all others as they are keeps UTF-8."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(table[raw]))
