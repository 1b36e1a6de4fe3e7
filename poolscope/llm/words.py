"""Words of texts as numpy hash arrays, for the Arrow maps of this subpackage.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is what
``bytes.split()`` cuts. Hashes are 64 bit; sums wrap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WORD = "[^\\x20\\x09-\\x0D]+"
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_digest = xxhash.xxh3_64_intdigest


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Growing tables of the powers of the base and of its inverse."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 4096)
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps = np.full(size, _INVERSE, np.uint64)
            steps[0] = 1
            self.down = np.cumprod(steps, dtype=np.uint64)


_powers = Powers()


def prefix_hash(hashes: np.ndarray) -> np.ndarray:
    """Running polynomial sums; any stretch of words is the difference of two."""
    n = len(hashes)
    _powers.upto(n)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers.up[:n], dtype=np.uint64, out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, stop), equal for equal word sequences."""
    width = (stop - start).astype(np.uint64)
    return mix((prefix[stop] - prefix[start]) * _powers.down[start] + width)


def windows(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all stretches of ``width`` words."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = (prefix[width:] - prefix[:n]) * _powers.down[:n]
    return mix(raw + np.uint64(width))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
