"""Whole-batch tokenising and hashing of UTF-8 text in numpy.

A batch is one Arrow array of binary or string values, read through its buffers without
copying. Words are runs of bytes outside space and \\x09-\\x0D, A-Z lower-cased; word and
shingle hashes are 64-bit.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Odd base of the polynomial word hash.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Piece of a batch that is hashed at once, in bytes; bounds the work arrays.
_PIECE = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _byte_values(lower: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:  # doubling: powers[done:2*done] = powers[:done] * base**done
            step = min(done, n - done)
            out[done : done + step] = out[:step] * (out[done - 1] * _BASE)
            done += step
    return out


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE**0 ... _BASE**(n-1) modulo 2**64; kept for the process up to a piece's size."""
    global _POWERS
    if n > len(_POWERS):
        found = _powers(max(n, 1 << 16))
        if n > 4 * _PIECE:
            return found
        _POWERS = found
    return _POWERS[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of data[start:end] spans, which must not overlap and be in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # sum of value * base**(position in word): per-byte powers are gathered by position in word
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    at = np.arange(total, dtype=np.int64)
    within = at - np.repeat(first, lengths)
    byte = data[at + np.repeat(starts - first, lengths)]
    values = _byte_values(lower)[byte] * powers(int(lengths.max()))[within]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per value) of the words of each value; breaks: for each byte, whether it ends a word."""
    inside = ~breaks[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def word_hashes(column: pa.Array, lower: bool = True, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, offsets of each value's words)."""
    data, offsets = buffers(column)
    counts = np.zeros(len(offsets) - 1, np.int64)
    found: list[np.ndarray] = []
    at = 0
    while at < len(counts):
        # whole values up to a piece's size; a longer value is a piece of its own
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
        piece = data[offsets[at] : offsets[to]]
        starts, ends, n = word_spans(piece, offsets[at : to + 1] - offsets[at], breaks)
        counts[at:to] = n
        found.append(_hash_spans(piece, starts, ends, lower))
        at = to
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


_LANES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words[i:i+size] for every i, over the borders of values too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _LANES[0]
    for j in range(1, size):
        out += words[j : j + n] * _LANES[j]
    return mix64(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def _inverse_powers(lg: int) -> np.ndarray:
    out = np.ones(1 << lg, np.uint64)
    np.multiply.accumulate(np.full((1 << lg) - 1, _INVERSE, np.uint64), out=out[1:])
    return out


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of words[i:i+size] for every i: a running sum of words times powers, whatever the size.

    The difference of two sums is a window's hash times the power it starts at, which is odd
    and so can be divided out modulo 2**64.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * _inverse_powers(max(0, n - 1).bit_length())[:n])


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers: (sums[j] - sums[i]) * inverse_powers(j)[i] is the hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(False)[data] * powers(len(data)), out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    """_BASE**0 ... _BASE**-(n-1) modulo 2**64, or more of them."""
    return _inverse_powers(max(0, n - 1).bit_length())


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each size-word shingle, offsets): a value with fewer words has its whole sequence as one, one without words none."""
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    to = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(to[-1]), np.uint64)
    full = np.flatnonzero(counts >= size)
    windows = window_hashes(words, size)
    if len(full):
        m = n[full]
        first = np.cumsum(m) - m
        at = np.arange(int(m.sum())) - np.repeat(first, m)
        out[at + np.repeat(to[full], m)] = windows[at + np.repeat(offsets[full], m)]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        short = words[offsets[i] : offsets[i + 1]]
        out[to[i]] = mix64((short * _LANES[: len(short)]).sum(dtype=np.uint64)[None] + np.uint64(len(short)))[0]
    return out, to
