"""Vectorised text helpers for the Python side of a task: words, hashes, shingles, list columns.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; only ``A-Z`` are lower-cased. Texts are read as
one UTF-8 buffer per chunk, so a word costs a few array operations and no Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept per worker."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (finaliser of a well-known hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; at the task's end its worker, which lives on, gives freed memory back to the system."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task


def texts_of(batch) -> pa.Array:
    """The batch's texts, from the carried row where it holds them, so that no text travels twice; null is empty."""
    column = batch.column("__text") if "__text" in batch.schema.names else pc.struct_field(batch.column("row"), "text")
    return pc.fill_null(column, "") if column.null_count else column


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Spans:
    """The words of some texts: ``start``/``end`` byte positions; text i has words ``first[i]:first[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = ~SPACE[data]
        starts, ends = word.copy(), word.copy()
        if len(word):
            starts[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            filled = offsets[:-1] < offsets[1:]
            heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
            starts[heads], ends[tails] = word[heads], word[tails]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Words(Spans):
    """Words with a 64-bit ``hash`` of their lower-cased bytes ``low``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        self._trim(data, offsets)
        self.low = low = LOWER[data]
        up, down = _power(len(low) + 1)
        sums = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix64(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _trim(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """For words that are less than the run of bytes between spaces."""


_STEPS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct k-word shingles; fewer words make one shingle, no word makes none."""
    h = words.hash
    if len(h) >= k:
        sums = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            sums += h[i : len(h) - k + 1 + i] * _STEPS[i]
        windows = mix64(sums)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            own = np.sort(windows[a : b - k + 1])
            yield own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own
        elif b > a:
            few = h[a:b]
            yield mix64(np.array([(few * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def long_lists(values: list[np.ndarray]) -> pa.Array:
    """A list<int64> column from unsigned or signed 64-bit arrays (bits kept)."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    joined = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined.view(np.int64) if joined.dtype == np.uint64 else joined.astype(np.int64)))


def list_values(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64), offsets - offsets[0]
