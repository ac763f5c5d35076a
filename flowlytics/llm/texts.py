"""Helpers for Arrow tasks that read whole texts: bounded slices of a batch, words, rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2_000_000
PIECE_BYTES = 1 << 18
BROADCAST_BYTES = 32_000_000

U64 = np.uint64


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts Arrow batches into runs of whole rows of about ``limit`` bytes of text; a longer text comes alone.

    After the last one the worker's free memory goes back to the system.
    """
    for batch in batches:
        sizes = batch.column(text).cast(pa.large_binary())
        lengths = np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, sizes.offset * 8)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(lengths, lengths[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            part = batch.slice(start, end - start)
            yield part, raw_texts(part.column(text))
            start = end
    release()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it


def release() -> None:
    """Gives freed memory back to the system: Spark keeps a worker for later tasks, and it counts beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def fresh_name(taken: Sequence[str], name: str) -> str:
    """``name``, with as many underscores before it as make it unlike all of the taken ones (column names ignore case)."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name = "_" + name
    return name


def small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A staged table, to be broadcast up to BROADCAST_BYTES by its count (a job); beyond, a join with it shuffles."""
    return F.broadcast(table) if row_bytes * table.count() <= BROADCAST_BYTES else table


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64 bits (xor-shift and multiply), so that every bit depends on every other."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def translation(separators: set[int]) -> bytes:
    """Byte table that makes A-Z lower case and each separator a blank."""
    return bytes(0x20 if b in separators else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


_BASE = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=U64))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, U64(base), U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_BASE, PIECE_BYTES + 1), _powers(pow(_BASE, -1, 1 << 64), PIECE_BYTES + 1)


class Words:
    """The words of several texts in a row: 64-bit hashes, places in ``clean``, and the number of words up to each text's end."""

    def __init__(self, raws: list[bytes], table: bytes):
        self.clean = b" ".join(raws).translate(table)
        found = [self._piece(a, b) for a, b in self._pieces()]
        self.hashes, self.starts, self.stops = (np.concatenate([f[i] for f in found]) if found else np.empty(0, k) for i, k in enumerate((U64, np.int64, np.int64)))
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        self.ends = np.searchsorted(self.starts, np.cumsum(lengths + 1) - 1)

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Stretches of about PIECE_BYTES that end between words."""
        at, length = 0, len(self.clean)
        while at < length:
            end = length
            if length - at > PIECE_BYTES:
                end = self.clean.rfind(b" ", at, at + PIECE_BYTES) + 1 or self.clean.find(b" ", at + PIECE_BYTES) + 1 or length
            yield at, end
            at = end

    def _piece(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of a stretch: the polynomial of a word's bytes is a difference of running sums, moved to its start."""
        codes = np.frombuffer(self.clean, np.uint8, b - a, a)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = codes != 0x20
        turns = np.diff(inside)
        starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        up, down = (_UP, _DOWN) if len(codes) <= PIECE_BYTES else (_powers(_BASE, len(codes) + 1), _powers(pow(_BASE, -1, 1 << 64), len(codes) + 1))
        sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(_VALUES[codes] * up[:len(codes)], out=sums[1:])
        hashes = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
        return mix(hashes), starts + a, stops + a

    def word(self, i: int) -> bytes:
        return self.clean[self.starts[i]:self.stops[i]]

    def bounds(self) -> Iterator[tuple[int, int]]:
        """First word and end of each text."""
        start = 0
        for end in self.ends.tolist():
            yield start, end
            start = end


# odd multipliers, one for each place in a shingle (fixed values)
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                   0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85,
                   0xDB4F0B9175AE2165, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3], U64)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (one entry fewer than words for each place beyond the first)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.full(n, U64(k), U64)
    for j in range(k):
        h = h + words[j:j + n] * PLACES[j]
    return mix(h)
