"""The binary Golay code of length 23: syndromes, and the codewords near a word.

Every 23-bit word is within distance 3 of exactly one codeword. Around a word at distance 3 from its codeword,
5 more codewords lie at distance 4; around any other word none does. So with the codewords within distance 4 as
keys (1 or 6 of them), any two words that differ in at most one bit share a key: the codeword nearest to the one
is within distance 4 of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

N = 23
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value of the code).
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word by the generator polynomial: 11 bits, 0 for codewords."""
    rest = np.asarray(words, dtype=np.int64).copy()
    for bit in range(N - 1, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(1)
def near_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: error patterns of weight at most 4 that lead to a codeword (6 columns), and how many there are."""
    patterns = np.array([sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(N), weight)], dtype=np.int64)
    of = syndrome(patterns)
    table, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for pattern, s in zip(patterns, of, strict=True):
        # Patterns of weight 4 matter only where the nearest codeword is at distance 3 itself.
        table[s, count[s]] = pattern
        count[s] += 1
    return table, count


@lru_cache(1)
def segment_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment (padded with zeros to 23 bits): the message parts of the codewords near it (6 columns), and how many."""
    words = np.arange(1 << 16, dtype=np.int64)
    table, count = near_errors()
    s = syndrome(words)
    return (words[:, None] ^ table[s]) >> 11, count[s]
