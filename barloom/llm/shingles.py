"""Word shingles as sets of 64-bit hashes, computed in Arrow batches from whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT, _M1, _M2 = np.uint64(31), np.uint64(0x7FB5D329728EA185), np.uint64(0x81DADEF4BC2DD44D)
#: Words whose hashes a Python worker remembers; beyond that many it starts over. This bounds memory only.
REMEMBERED = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> _SHIFT)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of the k-word shingles of a text with A-Z lower-cased.

    A text of 1 to k - 1 words has one element, its whole sequence; null or no words: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.fromiter((_words[w] for w in words), np.uint64, n)
        width = min(k, n)
        out = np.full(n - width + 1, width, np.uint64) * _C
        for i in range(width):
            out = (out ^ h[i : n - width + 1 + i]) * _A + _B
            out ^= out >> _SHIFT
        return np.unique(mixed(out).view(np.int64))


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)
