"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np

from pulsetally.llm.common import hash64

#: Words a worker remembers; at the bound the memory is emptied.
WORDS_MAX = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingles of ``size`` words as sorted 64-bit hashes.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Fewer words than ``size``
    are one shingle, the whole sequence; no words give the empty set.
    """

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 16, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORDS_MAX:
            known.clear()
        rows = list(map(known.get, words))
        if None in rows:
            for i, row in enumerate(rows):
                if row is None:
                    word = words[i]
                    row = known.get(word)
                    if row is None:
                        row = known[word] = len(known)
                        if row >= len(self.hashes):
                            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
                        self.hashes[row] = hash64(word)
                    rows[i] = row
        codes = self.hashes[np.array(rows, np.int64)]
        size = min(self.size, len(codes))
        n = len(codes) - size + 1
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = (total ^ codes[k : k + n]) * _STEP
            total ^= total >> np.uint64(29)
        total.sort()
        if n > 1:
            total = total[np.concatenate(([True], total[1:] != total[:-1]))]
        return total


def odd_sketch(shingles: np.ndarray) -> bytes:
    """Parities of bit positions, at least two bits a shingle.

    The symmetric difference of two sets is at least the Hamming distance of their
    sketches, the larger one folded to the size of the smaller one.
    """
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def odd_distance(left: bytes, right: bytes) -> int:
    """Hamming distance of two odd sketches: a lower bound of the symmetric difference."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    elif len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())
