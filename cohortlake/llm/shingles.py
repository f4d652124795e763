"""Word shingles of whole texts as 64-bit hashes, computed batch by batch inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

KNOWN_WORDS = 1 << 18
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    values = (values ^ (values >> _HALF)) * _MIX
    values = (values ^ (values >> _HALF)) * _MIX
    return values ^ (values >> _HALF)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased (bytes do exactly this); none for null."""
    return text.lower().split() if text else []


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles, sorted; the whole sequence if it is shorter."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    folded = mix(hashes[: len(hashes) - width + 1] + np.uint64(width))
    for k in range(1, width):
        folded = mix(folded * _PRIME + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(folded)
