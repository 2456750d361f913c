"""Words and their hashes, as problems 4 and 7 define them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A single Han character U+4E00 to U+9FFF, or a longest run of other letters or digits.
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """64-bit hash of each word, computed once per worker; emptied when it holds `most` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all three consecutive words of the lower-cased text; empty below three words."""
    words = WORD.findall(text.lower())
    n = len(words) - 2
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n + 2)
    return np.unique(mix(h[:n] * _M1 + h[1 : n + 1] * _M2 + h[2:] * _M3))
