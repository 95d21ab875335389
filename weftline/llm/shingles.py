"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z
lower-cased.  Hashing never loops over characters in Python: word hashes are
differences of a running polynomial sum over the whole buffer, modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_LANE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        while have < n:
            step = np.uint64(pow(base, have, 2**64))
            take = min(have, n - have)
            out[have : have + take] = out[:take] * step
            have += take
    return out


_UP = np.ones(1, dtype=np.uint64)
_DOWN = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)
    return _UP, _DOWN


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, end to end, and n + 1 offsets (a null row is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.empty(0, np.uint8)
    return raw, offs - (offs[0] if n else 0)


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (n + 1 entries)."""
    solid = ~_SPACE[raw]
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = solid[:-1]
    edges = offs[1:-1]
    edges = edges[edges < len(raw)]
    cut = solid & ~before
    cut[edges] = solid[edges]
    starts = np.flatnonzero(cut)
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = False
        after[:-1] = solid[1:]
    stop = solid & ~after
    last = edges[edges > 0] - 1
    stop[last] = solid[last]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the spans in order of their starts; with fold, A-Z count as a-z."""
    if not len(starts):
        return np.empty(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    table = _BYTE_LOWER if fold else _BYTE
    reach = np.maximum.accumulate(ends)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(reach, low + _CHUNK, side="right")))
            high = reach[to - 1]
            up, down = _tables(int(high - low) + 1)
            total = np.empty(int(high - low) + 1, np.uint64)
            total[0] = 0
            np.cumsum(table[raw[low:high]] * up[: high - low], out=total[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _LANE[63]
            at = to
    return mix(out)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, and n_rows + 1 offsets; a row with fewer words has one, of all of them."""
    rows = len(first) - 1
    counts = np.diff(first)
    have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    offs = np.zeros(rows + 1, np.int64)
    np.cumsum(have, out=offs[1:])
    out = np.empty(offs[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(words) >= n:
            run = len(words) - n + 1
            every = words[:run] * _LANE[0]
            for k in range(1, n):
                every = every + words[k : k + run] * _LANE[k]
            long = counts >= n
            keep = np.zeros(len(words) + 1, np.int8)
            np.add.at(keep, first[:-1][long], 1)
            np.add.at(keep, first[1:][long] - (n - 1), -1)
            keep = np.cumsum(keep[:-1]).astype(bool)
            mask = np.repeat(long, have)
            out[mask] = every[keep[:run]]
        for r in np.flatnonzero((counts > 0) & (counts < n)):
            part = words[first[r] : first[r + 1]]
            out[offs[r]] = (part * _LANE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part)) * _LANE[62]
    return mix(out), offs


def shingle_sets(column: pa.Array, n: int = 5):
    """Yields, for each row, the sorted distinct shingle hashes."""
    raw, offs = text_bytes(column)
    starts, ends, first = word_spans(raw, offs)
    hashes, at = shingle_hashes(span_hashes(raw, starts, ends), first, n)
    for i in range(len(at) - 1):
        yield np.unique(hashes[at[i] : at[i + 1]])
