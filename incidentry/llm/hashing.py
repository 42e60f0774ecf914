"""64-bit hashes of all words of a text at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class WordHasher(dict):
    """Word (bytes) -> 64 bits of its BLAKE2 hash; words seen before in this task are looked up."""

    #: Words kept, and the longest kept.
    LIMIT, LONGEST = 100_000, 64

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def words(self, raw: bytes) -> np.ndarray:
        """Hashes of the words between white space, in order."""
        words = raw.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
