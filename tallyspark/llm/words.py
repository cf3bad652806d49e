"""Word hashing shared by the operators that compare or search texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(1)
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the runs of letters and digits of the lower-cased text, in order."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _word_chars()[codes]
    if not inside.any():
        return np.zeros(0, np.uint64)
    starts = inside & ~np.r_[False, inside[:-1]]
    at = np.flatnonzero(starts)
    word = np.cumsum(starts) - 1
    place = np.arange(len(codes)) - at[np.maximum(word, 0)]
    letter = mixed(codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)) + np.uint64(1))
    letter[~inside] = 0
    return mixed(np.add.reduceat(letter, at))
