"""Vectorised byte, word and hash kernels that run inside tasks, on bounded slices of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONG_WORD = 64  # sums of powers modulo 2**64 tell shorter words apart; of longer ones there are pairs that agree under every base
SLICE_BYTES = 2 << 20  # text handled at once; a longer document is handled alone
_BASE = np.uint64(0x9E3779B97F4A7C17)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        m = max(n, SLICE_BYTES + 4096)
        one = np.ones(m, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = _BASE, _BASE_INV
        with np.errstate(over="ignore"):
            _powers.update(n=m, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of values[j] * base**j over s <= j < e."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), the same wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes: (first row, end row, bytes, offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def cut_words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of non-space bytes; no run crosses a row."""
    word = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[:1] = True
    np.logical_or(~word[:-1], edge[1:-1], out=before[1:])
    after = np.empty(len(buf), bool)
    after[-1:] = True
    np.logical_or(~word[1:], edge[1:-1], out=after[:-1])
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased text: hashes, starts, ends, and the first word of each row (one more entry than rows)."""
    low = LOWER[buf]
    starts, ends, rows = cut_words(low, offs)
    hashes = span_hash(prefix_sums(_BYTE[low]), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(low[starts[i] : ends[i]].tobytes())
    return hashes, starts, ends, np.searchsorted(rows, np.arange(len(offs)))


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE[buf])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; one hash for the whole sequence where it is shorter; none without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * np.uint64(0xD1342543DE82EF95) + hashes[i : n - k + 1 + i])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def row_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column of consecutive runs of ``values``."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
