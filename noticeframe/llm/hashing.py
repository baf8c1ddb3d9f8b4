"""Word and window hashes on NumPy arrays, for the operators that read texts in Python workers."""

from __future__ import annotations

#: Entries of a worker's word table; beyond it words are hashed anew, with the same result.
KNOWN_WORDS = 400_000
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rolled(words, size: int, base: int = BASE):
    """Polynomial hash (mod 2**64) of every ``size`` consecutive values, by doubling."""
    import numpy as np

    total, done, power, part, width = None, 0, 1, words, 1
    left = size
    while left:
        if left & 1:
            if total is None:
                total, done = part, width
            else:
                n = len(words) - done - width + 1
                total = total[: max(n, 0)] * np.uint64(pow(base, width, 2**64)) + part[done : done + max(n, 0)]
                done += width
        left >>= 1
        if left:
            n = max(len(part) - width, 0)
            part = part[:n] * np.uint64(pow(base, width, 2**64)) + part[width : width + n]
            width *= 2
    return total


def mixed(h):
    """Spread the values over all 64 bits."""
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))
