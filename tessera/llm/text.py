"""Vectorised text access shared by the operators: Arrow buffers, word spans, rolling hashes.

Everything works on the UTF-8 bytes of a slice of rows at a time, so that memory stays bounded by
the slice (or by one text, where a single text is longer) and not by the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

# Odd multiplier of the rolling hash, its inverse modulo 2**64, and the finalizer's constants.
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_tables: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII letters and digits and of all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n."""
    if len(_tables["p"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for key, base in (("p", _P), ("i", _PINV)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _tables[key] = np.cumprod(steps)
    return _tables["p"][:n], _tables["i"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums S with (S[e] - S[s]) * P**-s a hash of data[s:e]."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_sums(data)
    _, inv = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inv[starts])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of data[i:i+k] for every i."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    sums = prefix_sums(data)
    _, inv = powers(len(data) + 1)
    return mix((sums[k:] - sums[:-k]) * inv[: len(data) - k + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about limit bytes."""
    if not len(column):
        return
    data, offsets = buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and offsets of each row's words among them."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each row, sorted, and their row offsets.

    A row of fewer words, but not none, has its whole sequence as its one shingle.
    """
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, SPACED)
    words = span_hashes(data, starts, ends)
    n = len(words)
    counts = np.diff(at)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = mix(rolled + words[j : n - k + 1 + j]) if len(rolled) else rolled
    row = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(len(rolled)) + k <= at[row[: len(rolled)] + 1]
    hashes, rows = rolled[keep], row[: len(rolled)][keep]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            h = np.array([counts[r]], np.uint64)
            for w in words[at[r] : at[r + 1]]:
                h = mix(h + w)
            whole[i] = h[0]
        hashes, rows = np.concatenate((hashes, whole)), np.concatenate((rows, short))
    order = np.lexsort((hashes, rows)) if len(short) else None
    if order is None:
        out = []
        bounds = np.searchsorted(rows, np.arange(len(counts) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            out.append(np.unique(hashes[a:b]))
        sizes = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[first], rows[first]
    return hashes, np.searchsorted(rows, np.arange(len(counts) + 1))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
