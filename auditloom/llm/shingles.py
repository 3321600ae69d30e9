"""Word shingles as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Odd multipliers of the rolling polynomials and the last mixing step.
ROLL = np.uint64(0x9E3779B97F4A7C15)
ROLL_TOO = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)
MAX_WORDS_KNOWN = 250_000


class WordHashes(dict):
    """64-bit hash of each word seen so far."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS_KNOWN:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread polynomial values over all 64 bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * MIX
    return values ^ (values >> np.uint64(29))


def rolling(words: np.ndarray, size: int, base: np.uint64 = ROLL) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every window of `size` words; windows double, then join by the bits of `size`."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    width, block = 1, words
    total, covered = None, 0
    bits = size
    while bits:
        if bits & 1:
            if total is None:
                total, covered = block, width
            else:  # the block stands before what is covered
                rest = total[width:]
                total = block[: len(rest)] * _power(base, covered) + rest
                covered += width
        bits >>= 1
        if bits:
            block = block[:-width] * _power(base, width) + block[width:]
            width *= 2
    return total[:n]


def _power(base: np.uint64, exponent: int) -> np.uint64:
    return np.uint64(pow(int(base), exponent, 2**64))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; a shorter text is one shingle, no words none."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return np.unique(mixed(rolling(words, min(size, len(words))) + np.uint64(min(size, len(words)))))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
