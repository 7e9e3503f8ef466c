"""Vectorised words and hashes over Arrow string columns (numpy, no per-word Python).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes never occur
inside a multi-byte UTF-8 character, so the rule on bytes equals the rule on characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser; ``x`` (uint64) is not changed."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = _TABLE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    up, down = _POWERS["up"][:n], _POWERS["down"][:n]
    if n > CHUNK_BYTES + 1:  # one very long text: do not keep its tables
        _POWERS.clear()
    return up, down


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()  # null rows have no bytes
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count and (np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)] > 0).any():
        yield from chunks(column.fill_null(""))
        return
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (one entry more than rows)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends there."""
    size = ends - starts
    stop = np.cumsum(size + 1) - 1
    out = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, dtype=np.uint8)
    solid = np.ones(len(out), dtype=bool)
    solid[stop] = False
    out[solid] = data[~_SPACE[data]]
    return out.tobytes(), stop - size, stop


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data))
    sums = (_LOWER if lower else _TABLE)[data]
    sums *= up
    np.cumsum(sums, out=sums)
    value = sums[ends - 1]
    has = starts > 0
    value[has] -= sums[starts[has] - 1]
    value *= down[starts]
    value ^= (ends - starts).astype(np.uint64)
    return mix(value)


def gram_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words within a row: positions (of the first word) and hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    value = sums[k:] - sums[: n - k + 1]
    value *= down[: n - k + 1]
    ok = np.ones(n - k + 1, dtype=bool)
    edges = first[1:-1]
    for back in range(1, k):  # a run must not reach over the end of its row
        at = edges - back
        ok[at[(at >= 0) & (at <= n - k)]] = False
    at = np.flatnonzero(ok)
    return at, mix(value[at] ^ np.uint64(k * 0x9E37))


def rows_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of each word position."""
    return np.searchsorted(first, at, side="right") - 1
