"""64-bit hashes of words and numbers, as NumPy arrays."""

from __future__ import annotations

import numpy as np
from pandas.util import hash_array


def word_hashes(words: list[bytes]) -> np.ndarray:
    """SipHash of every word, in one call."""
    return hash_array(np.array(words, dtype=object), categorize=False).astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
