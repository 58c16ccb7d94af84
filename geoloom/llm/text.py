"""Array kernels over the UTF-8 bytes of an Arrow string column.

Words are maximal runs of bytes other than space and \\x09-\\x0D. All kernels work
on slices of bounded size, so a task's memory doesn't grow with its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel holds at once; a longer document is a slice of its own.
SLICE_BYTES = (2 << 20) - 8

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWERED = _BYTE[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = int(_STEP) | 1
_TABLES = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_TABLES[0]) < n:
        size = 1 << max(8, int(n - 1).bit_length())
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _TABLES[k] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``size`` bytes of text, across or within Arrow batches."""
    held, n = [], 0
    for batch in batches:
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size - n, "right")) - 1)
            if held and at[stop] - at[start] + n > size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
                continue
            held.append(batch.slice(start, stop - start))
            n += int(at[stop] - at[start])
            start = stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (with the total last)."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = at[1:][at[1:] > 0] - 1
    last[tails] = solid[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _BYTE)[data] * powers[: len(data)], out=sums[1:])
    sums = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(sums ^ ((ends - starts).astype(np.uint64) * _M2))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places aren't meaningful across rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out)


def whole(firsts: np.ndarray, k: int) -> np.ndarray:
    """For each word that starts a run: does the run of k words end within its row."""
    n = int(firsts[-1])
    ends = np.repeat(firsts[1:], np.diff(firsts))
    return np.arange(n) + k <= ends


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every row, ASCII letters lowered, and row offsets.

    A row of fewer than k words gives its whole sequence as one shingle; a row
    without words gives none.
    """
    starts, ends, firsts = words(data, at)
    hashes = word_hashes(data, starts, ends, lower=True)
    counts = np.diff(firsts)
    runs = run_hashes(hashes, k)
    keep = whole(firsts, k)[: len(runs)]
    rows = np.repeat(np.arange(len(counts)), counts)[: len(runs)][keep]
    runs = runs[keep]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        folded = [run_hashes(hashes[firsts[r] : firsts[r + 1]], int(counts[r]))[0] ^ np.uint64(counts[r] * 0x51ED27) for r in short]
        rows, runs = np.r_[rows, short], np.r_[runs, np.array(folded, np.uint64)]
        order = np.argsort(rows, kind="stable")
        rows, runs = rows[order], runs[order]
    bounds = np.searchsorted(rows, np.arange(len(counts) + 1))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        runs[i:j].sort()
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
    rows, runs = rows[new], runs[new]
    return runs, np.searchsorted(rows, np.arange(len(counts) + 1))
