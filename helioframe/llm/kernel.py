"""Vectorised word and window hashes over blocks of texts (used inside Arrow tasks).

A block of texts is one byte array.  Hashes of words, and of windows of words, are
differences of prefix sums of a polynomial in 64-bit arithmetic, so a block costs a
few passes of numpy whatever the window length is.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Odd multipliers of the polynomials: bytes of a word, words of a window (two of them).
BYTE_BASE, WINDOW_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


#: Tables that operators keep in a worker for their next task.
HELD: list[dict] = []


def lean() -> None:
    """Give back what operators before keep in this worker, which serves tasks of one application for long."""
    if any(HELD):
        for table in HELD:
            table.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64; the table is kept while it is small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 1 << 21:
            _powers[base] = have
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Words:
    """Words of a block: byte spans, hashes, and where each text's words start."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i] .. bounds[i + 1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


#: Bytes with ASCII capitals made small and every other ASCII sign made a space.
FOLD = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))


def words(texts: list[str | None], table: bytes | None = None) -> Words:
    """Split a block of texts into words and hash each word; ``table`` maps their bytes first."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    if table:
        data = data.translate(table)
    buf = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.empty(len(buf) + 1, dtype=np.int8)
    edge[0] = 1 - space[0]
    edge[-1] = 0
    np.subtract(space[:-1].view(np.int8), space[1:].view(np.int8), out=edge[1:-1])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = _prefix(buf.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    h = (sums[end] - sums[start]) * powers(_inverse(BYTE_BASE), len(buf))[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    text_at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return Words(data, start, end, h, np.searchsorted(start, text_at))


def windows(hashes: np.ndarray, length: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Hash of the ``length`` words from each position of the block on (block ends are left out)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = _prefix(hashes, base)
    return mix((sums[length:] - sums[:-length]) * powers(_inverse(base), n))


def inside(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the first ``n`` window starts lie within one text."""
    if n <= 0:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + length <= ends


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one row if that is longer."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to

