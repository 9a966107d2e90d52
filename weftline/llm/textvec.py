"""Whole batches of texts as byte arrays: tokens, their hashes and their shingles without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text goes alone.
CHUNK = 2 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _STEP
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = _powers(1 << 12)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, row starts with an end) of slices of about CHUNK bytes; nulls are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order. Words are runs of bytes that are not white space; A-Z are lower-cased if asked."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    row_starts = starts[:-1][starts[:-1] < len(data)]
    first[row_starts] = solid[row_starts]  # a word ends with its text
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = _BYTE[_LOWER[data] if lower else data]
    values[~solid] = 0
    begin = np.zeros(len(data), dtype=np.int64)
    begin[at] = at
    np.maximum.accumulate(begin, out=begin)
    place = np.arange(len(data)) - begin
    if (top := int(place.max(initial=0))) < len(_POWERS):
        values *= _POWERS[place]
    else:
        values *= _powers(top + 1)[place]
    hashes = mix64(np.add.reduceat(values, at))
    rows = np.searchsorted(starts, at, side="right") - 1
    return hashes, rows


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-word shingles of each row, sorted by row and hash; a row of fewer words has one, all of it."""
    if not len(hashes):
        return hashes, rows
    counts = np.bincount(rows)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    out = np.zeros(len(hashes), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        out = mix64(out + padded[k : k + len(hashes)] + np.uint64(k + 1))
    whole = np.zeros(len(hashes), dtype=bool)
    left = (first + counts[rows[first]])[np.searchsorted(first, np.arange(len(hashes)), side="right") - 1] - np.arange(len(hashes))
    whole[left >= n] = True
    short = first[counts[rows[first]] < n]
    for i in short:  # few: texts of one to n - 1 words
        h = np.zeros(1, np.uint64)
        for k in range(int(counts[rows[i]])):
            h = mix64(h + hashes[i + k : i + k + 1] + np.uint64(k + 1))
        out[i] = mix64(h + np.uint64(0xF00D))[0]
        whole[i] = True
    h, r = out[whole], rows[whole]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
    return h[keep], r[keep]
