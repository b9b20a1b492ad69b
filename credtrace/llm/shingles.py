"""Word shingles of texts as sorted 64-bit hashes, in numpy over the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte, A-Z like a-z and white space 0; which bytes are white space."""
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    values[65:91] = values[97:123]
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    values[space] = 0
    return values, space


@lru_cache(8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def piece_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of the bytes; a word also ends at the borders."""
    values, space = byte_tables()
    n = 1 << max(10, int(len(data) + 1).bit_length())
    up, down = powers(n)
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = borders[(borders > 0) & (borders < len(data))]
    starts[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin]), begin


def text_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, word hashes) of runs of rows; row r of a run owns words offsets[r]:offsets[r + 1].

    Rows are taken together up to PIECE bytes; a longer text is read in pieces cut at white space, so that memory beside
    the text is bounded by the pieces and the word hashes.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    _, space = byte_tables()
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PIECE, side="right")) - 1)
        start, stop = int(bounds[row]), int(bounds[last])
        hashes, places, at = [], [], start
        while at < stop:
            cut = min(stop, at + PIECE)
            while cut < stop and not space[data[cut]]:
                cut += 1
            h, p = piece_hashes(data[at:cut], bounds[row:last] - at)
            hashes.append(h)
            places.append(p + at)
            at = cut
        words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        where = np.concatenate(places) if places else np.empty(0, np.int64)
        yield row, np.searchsorted(where, bounds[row:last + 1]), words
        row = last


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; the whole sequence is one where there are fewer words."""
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += words[k: len(words) - n + 1 + k] * np.uint64(int(_BASE) * (2 * k + 1) % (1 << 64))
    return np.unique(mixed(total))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, offsets, words in text_words(texts):
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield shingle_set(words[a:b], size)
