"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  UTF-8 never
uses those bytes inside a multi-byte character, so bytes give the same words
as code points do.  Hashes are 64-bit: a polynomial over the word's bytes
(modulo 2**64, odd base), its length, then a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes hashed at once; also the size of the cached power tables.
BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j for j < n."""
    n = max(n, 1)
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    both = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    if n <= BLOCK:
        _POWERS[:] = both
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser with full avalanche."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def as_binary(column: pa.Array) -> pa.Array:
    """A string column as binary with nulls made empty, one chunk, offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_binary column and its n+1 offsets into them."""
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, count=column.offset + n + 1)[column.offset :]
    if data is None or n == 0 or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(column: pa.Array, most: int = 2 * BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows holding about ``most`` bytes each (a longer row goes alone)."""
    if not len(column):
        return
    _, offs = buffer_of(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, column.slice(at, end - at)
        at = end


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word index where each row begins (n+1)."""
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    solid = ~_IS_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offs[:-1][offs[:-1] < n]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def polynomial_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every run of bytes (sorted, disjoint), block by block so that memory is bounded by a block or one run."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(int(np.searchsorted(ends, base + BLOCK, side="right")), at + 1)
        block = raw[base : int(ends[stop - 1])]
        if lower:
            block = _LOWER[block]
        power, inverse = _powers(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        h = (sums[e] - sums[s]) * inverse[s]
        out[at:stop] = mix(h + (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        at = stop
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (row borders are the caller's business)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # One polynomial by doubling: h_2m(i) = h_m(i) * c_m + h_m(i + m).
    factor = 0xD6E8FEB86659FD93
    parts, power, size, h = [], factor, 1, words
    while True:
        if k & size:
            parts.append((size, power, h))
        if size * 2 > k:
            break
        h = h[: len(h) - size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    total, at = np.zeros(n, np.uint64), 0
    for size, power, h in parts:
        total = total * np.uint64(power) + h[at : at + n]
        at += size
    return mix(total ^ np.uint64(k))


def sequence_keys(words: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit key of each row's whole word sequence (empty bytes for a row without words)."""
    import xxhash

    view = words.tobytes()
    return [xxhash.xxh3_128_digest(view[8 * a : 8 * b]) if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
