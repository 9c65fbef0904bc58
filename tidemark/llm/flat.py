"""Texts of an Arrow batch as flat numpy arrays: tokens and their hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; bounds the memory of a task's arrays.
CHUNK_BYTES = 1 << 21

_U = np.uint64
#: A fixed random value per byte and a fixed odd base: the same hashes in every task and session.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)

_SPACES = list(b"\t\n\x0b\x0c\r ")
#: White space is 0, all else 1.
WORDS = np.ones(256, np.uint8)
WORDS[_SPACES] = 0
#: White space is 0, letters and digits (and all bytes beyond ASCII) are 1, other signs are 2.
SIGNS = np.full(256, 2, np.uint8)
SIGNS[_SPACES] = 0
SIGNS[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]), dtype=np.uint64)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes each, or a single longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


class Tokens:
    """Tokens of some texts in order: hash, class, text number, first and last byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, prefixes: tuple[int, ...] = ()):
        n, rows = len(data), len(offsets) - 1
        self.rows, self.data = rows, data
        kind = classes[data]
        new = np.empty(n, bool)
        if n:
            new[0] = True
            np.not_equal(kind[1:], kind[:-1], out=new[1:])
            new[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n) if n else starts
        hashes = np.empty(len(starts), np.uint64)
        # blocks of whole tokens, so that one very long text needs no more memory than many short ones
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK_BYTES, "right")))
            a, b = starts[first], ends[last - 1]
            length = ends[first:last] - starts[first:last]
            place = np.arange(b - a) - np.repeat(starts[first:last] - a, length)
            values = _BYTE[data[a:b]] * _power(int(length.max()))[place]
            hashes[first:last] = np.add.reduceat(values, starts[first:last] - a)
            first = last
        kinds = kind[starts] if n else np.zeros(0, np.uint8)
        keep = kinds != 0
        self.start, self.end, self.kind = starts[keep], ends[keep], kinds[keep]
        self.hash = mix(hashes[keep] + self.kind)
        self.row = np.searchsorted(offsets, self.start, "right") - 1

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens longer than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        which = np.flatnonzero(self.end - self.start > size)
        power, total = _power(size), np.zeros(len(which), np.uint64)
        for i in range(size):
            total += _BYTE[self.data[self.start[which] + i]] * power[i]
        return which, mix(total + _U(size * 1000 + 7))

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def shingles(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` tokens; a shorter text gives one run of all its tokens."""
    h, row = tokens.hash, tokens.row
    count = tokens.counts()
    full = np.maximum(len(h) - size + 1, 0)
    total = np.zeros(full, np.uint64)
    for i in range(size):
        total = total * _BASE + h[i : i + full]
    inside = row[:full] == row[size - 1 :] if full else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    out, where = [mix(total[inside])], [row[:full][inside]]
    if len(short):
        first = np.cumsum(count) - count
        rest = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = count[short] > i
            rest[has] = rest[has] * _BASE + h[first[short[has]] + i]
        out.append(mix(rest + count[short].astype(np.uint64)))
        where.append(short)
    return np.concatenate(out), np.concatenate(where)
