"""Numpy kernels over the UTF-8 bytes of Arrow string columns.

All of them work on chunks: whole documents whose texts together hold about a megabyte (one document, if it is longer). White space is
the six ASCII characters 0x20 and 0x09-0x0D; bytes of longer code points are never white space, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        out[0] = 1
        _tables[name] = np.multiply.accumulate(out)
    return _tables[name][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and byte offsets of each chunk; a null text counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more entry than documents)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~IS_SPACE[raw]
    gap = np.empty(n + 1, bool)
    gap[0] = gap[n] = True
    np.logical_not(word[:-1], out=gap[1:n])
    gap[at] = True
    starts = np.flatnonzero(word & gap[:n])
    after = np.empty(n + 1, bool)
    after[n] = True
    np.logical_not(word, out=after[:n])
    after[at] = True
    ends = np.flatnonzero(word & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n), out=total[1:])
    return mix64((total[ends] - total[starts]) * _powers("down", _INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; len(words) - n + 1 of them, which also run over the borders of documents."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m] * _STEPS[0]
    for k in range(1, n):
        out = out * _STEPS[4] + words[k : m + k] * _STEPS[k % 4]
    return mix64(out)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values within each pair of neighbouring bounds; 0 where nothing lies between."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def code_points(raw: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (raw & 0xC0) != 0x80
