"""Word shingles of texts as sorted 64-bit hashes, inside tasks."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash

_MIX = 0xFF51AFD7ED558CCD


@lru_cache(maxsize=16)
def _factors(k: int) -> np.ndarray:
    """Odd factors, one per place of a word in a shingle of k words."""
    return np.array([xxhash.xxh3_64_intdigest(f"{k}/{i}") | 1 for i in range(k)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white space characters."""
    return text.encode("utf-8").split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k words."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i, factor in enumerate(_factors(k)):
        if n > 0:
            out += hashes[i : i + n] * factor
    out ^= out >> np.uint64(31)
    out *= np.uint64(_MIX)
    out ^= out >> np.uint64(29)
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct k-word shingles of a text, A-Z lower-cased, ascending.

    A shorter text is one shingle of all its words; one without words has none.
    """
    words = text.encode("utf-8").lower().split() if text else []
    return np.unique(windows(hashes_of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
