"""Vectorised words and window hashes over Arrow string columns.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D`` of the UTF-8 text. Each different word of a block is
hashed once, whole, by xxh3 (128 bits, two hashes of 64); windows are put together from halves, with a bit mixer at
every step, so no structure of words or windows makes two of them alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each a followed by each b."""
    return mix(a * _ODD + b, seed)


def runs(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of the ``width`` values from each place on, by doubling: runs of 2, 4, 8 and so on, and those that make up
    ``width`` put together."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out, held, length, power = None, 0, 1, mix(values, seed)
    while True:
        if width & length:
            out = power if out is None else joined(out[: len(out) - length], power[held:], seed + 3 * held + 1)
            held += length
        if held == width:
            return out
        power = joined(power[:-length], power[length:], seed + 3 * length + 2)
        length *= 2


def blocks(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text; a longer text stands alone. After the last, what Arrow keeps of
    memory in this worker is given back: other workers of the executor may need it."""
    texts = batch.column(column)
    if not len(batch):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 16)
    start = 0
    while start < len(batch):
        floor = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, floor + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more at the end). Null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def small(data: bytes) -> bytes:
    """Compressed bytes, for what shuffles or is stored."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def full(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Words:
    """The words of some texts: where each begins and ends in ``buf``, its row, and each row's first word."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        buf, self.at = text_bytes(texts)
        self.buf = _LOWER[buf] if lower else buf
        n = len(self.buf)
        solid = ~_SPACE[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each word, independent of one another."""
        size = self.ends - self.starts
        places = np.concatenate(([0], np.cumsum(size)))
        kind, width = (pa.large_binary(), np.int64) if places[-1] > 2**31 - 1 else (pa.binary(), np.int32)
        letters = np.ascontiguousarray(self.buf[~_SPACE[self.buf]])
        words = pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(places.astype(width)), pa.py_buffer(letters)]).dictionary_encode()
        known = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
        at = words.indices.to_numpy()
        return known[at, 0], known[at, 1]

    def windows(self, hashes: tuple[np.ndarray, np.ndarray], width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window of ``width`` words inside one text, and a hash of each from both hashes of its words."""
        n = len(self.row) - width + 1
        starts = np.flatnonzero(self.row[:n] == self.row[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
        return starts, joined(runs(hashes[0], width, seed), runs(hashes[1], width, seed + 1), seed)[starts]
