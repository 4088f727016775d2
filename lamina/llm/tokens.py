"""Hashes of words and shingles for whole Arrow batches, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text makes a chunk of its own.
CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after another in ``data``, and the first word's number for each text and the end."""
    n = len(data)
    data = data.copy()
    space = (data == 32) | ((data >= 9) & (data <= 13))
    if lower:
        data[(data >= 65) & (data <= 90)] += 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | edge[1:n]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _power_tables(n)
    value = data.astype(np.uint64)
    value += np.uint64(1)
    value *= up
    value[space] = 0
    return mix(np.add.reduceat(value, at) * down[at]), np.searchsorted(at, offsets)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes: first and last number, their bytes and offsets in them. Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of every text, and where each text's begin. A text with fewer words is one run; one without words has none."""
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(runs)))
    text = np.repeat(np.arange(len(count)), runs)
    at = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    out = np.zeros(len(at), np.uint64)
    have = np.minimum(count, width)[text]
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    for j in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += np.where(j < have, padded[at + j], np.uint64(0))
    return mix(out ^ have.astype(np.uint64)), begin
