"""Words and shingle hashes of whole texts, computed on the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased.  Work proceeds in
pieces of bounded size cut at white space, so a very long text costs no more temporary memory than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes hashed at a time, few enough for a core's cache, and bytes of texts handled together.
PIECE_BYTES = 1 << 17
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, one for each seed."""
    x = x ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        _powers[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_BASE, _BASE_INVERSE)
        ]
    return _powers


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and the offsets of each text; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _piece_cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE_BYTES that end at a text's end or before white space."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE_BYTES)
        while end < n and not _SPACE[data[end]] and offsets[np.searchsorted(offsets, end)] != end:
            limit = min(n, end + PIECE_BYTES)
            gap = np.flatnonzero(_SPACE[data[end:limit]])
            stop = int(offsets[np.searchsorted(offsets, end)])
            end = min(stop, end + int(gap[0]) if len(gap) else limit)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start byte of each word, and for each text the number of words before it (one more entry than texts)."""
    hashes, starts = [], []
    for at, end in _piece_cuts(data, offsets):
        part = data[at:end]
        solid = ~_SPACE[part]
        head = np.zeros(end - at + 1, bool)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
        head[inner] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | head[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | head[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _power_tables(end - at + 1)
        running = np.zeros(end - at + 1, np.uint64)
        np.cumsum(_LOWER[part] * power[: end - at], out=running[1:])
        hashes.append(mix((running[e] - running[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes, starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words and the bounds of each text's runs; a shorter text is one run, no words give none."""
    counts = np.diff(bounds)
    total = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(total)])
    n = len(hashes)
    run = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        run = run * np.uint64(_BASE) + hashes[k : k + len(run)]
    # the first run of text t starts at word bounds[t]
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], total)
    short = (counts > 0) & (counts < width)
    out = np.empty(out_bounds[-1], np.uint64)
    whole = np.repeat(~short, total)
    out[whole] = mix(run[at[whole]])
    for t in np.flatnonzero(short):
        value = np.zeros(1, np.uint64)
        for h in hashes[bounds[t] : bounds[t + 1]]:
            value = value * np.uint64(_BASE) + h
        out[out_bounds[t]] = mix(value, int(counts[t]))[0]
    return out, out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text sorted without repeats, and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
    yield from ((int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)
