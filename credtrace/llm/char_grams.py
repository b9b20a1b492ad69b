"""Hashed character n-grams of texts, in numpy over code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def hashes_of(points: np.ndarray, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Per order the 64-bit hash of the n-gram that starts at each code point; longer ones grow from shorter ones."""
    wide = points.astype(np.uint64)
    total = np.full(len(points), 1, dtype=np.uint64)
    for k in range(max(orders)):
        total = (total[: max(len(points) - k, 0)] ^ wide[k:]) * _MIX
        total ^= total >> np.uint64(29)
        if k + 1 in orders:
            yield total * np.uint64(0xD6E8FEB86659FD93)


def batched(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in lists of about CHUNK code points together; a longer one stands alone."""
    held, size = [], 0
    for t in texts:
        text = t.as_py() or ""
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
