"""Words, lines and shingles of whole texts as numpy arrays, for use inside tasks.

A batch of texts is one byte buffer. Words are runs of bytes other than space and tab to
carriage return; in UTF-8 no byte of a longer character falls in that set. A slice of the
buffer is hashed from running sums, so the work per text is linear in its bytes and no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are handled in pieces of about this many bytes; one longer text is one piece.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        back = np.full(size, _INVERSE, np.uint64)
        back[0] = 1
        _powers, _inverses = np.cumprod(steps), np.cumprod(back)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(buffer: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return buffer + ((buffer >= 65) & (buffer <= 90)).astype(np.uint8) * np.uint8(32)


@dataclass
class Texts:
    """Consecutive texts: rows ``first`` to ``first + len(offsets) - 1`` of the batch."""

    buffer: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def _spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each run of set bytes that does not cross a text's border."""
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        at = np.flatnonzero(starts)
        return at, np.flatnonzero(ends) + 1, np.searchsorted(self.offsets, at, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = self.buffer
        return self._spans((b != 32) & ((b < 9) | (b > 13)))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each non-empty line."""
        return self._spans(self.buffer != 10)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of slices of the buffer."""
        powers, inverses = _power_tables(len(self.buffer) + 1)
        values = _TABLE[lowered(self.buffer) if lower else self.buffer]
        sums = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum(values * powers[: len(self.buffer)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))

    def code_points(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.buffer) + 1, np.int64)
        np.cumsum((self.buffer & 0xC0) != 0x80, out=sums[1:])
        return sums[ends] - sums[starts]

    def counted(self, chosen: np.ndarray) -> np.ndarray:
        """Number of chosen bytes in each text."""
        sums = np.zeros(len(self.buffer) + 1, np.int64)
        np.cumsum(chosen, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def shingles(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words inside one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(row[:n] == row[size - 1:])
    out = np.zeros(len(whole), np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[whole + k]
    return mix(out), whole


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a batch (null counts as empty) in pieces of bounded size."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at], at)
        at = to


def per_row(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, rows)
