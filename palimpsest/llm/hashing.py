"""Word and shingle hashes of whole texts, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Entries a task keeps of the words it has hashed; then it starts anew.
MEMO_WORDS = 500_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def signed(value: int) -> int:
    return value - (value >> 63 << 64)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = signed(xxhash.xxh3_64_intdigest(word))
        if len(word) < 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; a shorter text is one run; none: empty."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = mix(total * _PRIME + words[i : len(words) - size + 1 + i])
    return total


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; null has none."""
    # bytes.lower and bytes.split know ASCII only, which is what is wanted.
    return text.encode("utf-8", "replace").lower().split() if text else []
