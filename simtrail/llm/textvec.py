"""Vectorised text kernels on Arrow string columns (numpy, inside tasks).

A column is looked at as one UTF-8 byte array with row offsets; words,
hashes and shingles of all its rows are computed in a few array passes, a
few megabytes of text at a time, so a task's memory does not follow the size
of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
# Odd multipliers of the words of a shingle, from a fixed seed.
_GRAM_SEED = 20240131


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def class_table(pattern_bytes) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    out = np.zeros(256, dtype=bool)
    out[list(pattern_bytes)] = True
    return out


# Words of letters and digits: ASCII alphanumerics and every non-ASCII byte.
ALNUM = class_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
# Words between ASCII white space.
NON_SPACE = class_table([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(off):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: (first row, end row, bytes, offsets)."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = int(np.searchsorted(off, off[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows, row + 32768)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray = ALNUM):
    """(starts, ends, word offsets by row) of maximal runs of ``table`` bytes."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = table[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2^64), kept for the next block."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(n, 1024).bit_length()
        for name, base in (("up", _WORD_BASE), ("down", pow(_WORD_BASE, -1, 1 << 64))):
            table = np.full(size, _U(base))
            table[0] = _U(1)
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span: differences of one running polynomial sum."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    values = _BYTE_VALUE[data]
    values *= up[: len(data)]
    np.cumsum(values, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(_WORD_BASE) + _U(seed))


def word_hashes(data, off, table=ALNUM, lower: bool = True):
    """(hash of each word, word offsets by row)."""
    data = LOWER[data] if lower else data
    starts, ends, word_off = word_spans(data, off, table)
    return span_hashes(data, starts, ends), word_off


def gram_multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(_GRAM_SEED).integers(1, 1 << 63, size=k, dtype=np.uint64) * _U(2) + _U(1)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (also across rows; callers mask those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(gram_multipliers(k)):
        out += words[j : j + n] * c
    return mix64(out + _U(k))


def grams(words: np.ndarray, word_off: np.ndarray, k: int, whole_short: bool = True):
    """(hash of each ``k``-word shingle, its row); a shorter row is one shingle."""
    counts = np.diff(word_off)
    row = np.repeat(np.arange(len(counts)), counts)
    n = max(len(words) - k + 1, 0)
    full = np.arange(n) + k <= word_off[1:][row[:n]]
    hashes, rows = rolling(words, k)[full], row[:n][full]
    short = np.flatnonzero((counts > 0) & (counts < k)) if whole_short else []
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j, c in enumerate(gram_multipliers(k)):
            has = counts[short] > j
            acc[has] += words[word_off[short[has]] + j] * c
        hashes = np.concatenate([hashes, mix64(acc + counts[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
    return hashes, rows


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values of each row (rows as offsets into ``values``)."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def row_hashes(values: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each row's sequence of 64-bit values."""
    counts = np.diff(off)
    pos = np.arange(len(values)) - np.repeat(off[:-1], counts)
    table = mix64(np.arange(int(counts.max()) if len(counts) else 0, dtype=np.uint64) + _U(seed)) | _U(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ _U(seed)) * table[pos], dtype=np.uint64)])
    return mix64(total[off[1:]] - total[off[:-1]] + counts.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged_take(flat: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The listed rows of a ragged array, one after another: (values, length of each)."""
    lens = (off[1:] - off[:-1])[rows]
    total = int(lens.sum())
    at = np.cumsum(lens) - lens
    return flat[np.arange(total) + np.repeat(off[rows] - at, lens)], lens
