"""The perfect Golay code [23, 12, 7]: nearest codewords of 23-bit words."""

from __future__ import annotations

import numpy as np

#: Fixed value: the generator polynomial.
GENERATOR = 0b101011100011


class Golay:
    """Nearest codewords by syndrome, for arrays of 23-bit words."""

    def __init__(self) -> None:
        def rest(word: int) -> int:
            for i in range(22, 10, -1):
                if word >> i & 1:
                    word ^= GENERATOR << (i - 11)
            return word

        unit = np.array([rest(1 << i) for i in range(23)])
        self.by_byte = []
        for low, high in ((0, 8), (8, 16), (16, 23)):
            part = np.zeros(1 << (high - low), np.int64)
            for i in range(low, high):
                part[np.arange(len(part)) >> (i - low) & 1 == 1] ^= unit[i]
            self.by_byte.append(part)
        self.error = np.zeros(2048, np.int64)
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    flipped = [*{i, j, k}]
                    self.error[np.bitwise_xor.reduce(unit[flipped])] = sum(1 << b for b in flipped)

    def errors(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.by_byte
        return self.error[a[x & 255] ^ b[x >> 8 & 255] ^ c[x >> 16]]

    def index(self, x: np.ndarray) -> np.ndarray:
        """12-bit index of the nearest codeword (its upper bits)."""
        return (x ^ self.errors(x)) >> 11

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 24) indices of codewords within distance 4, the nearest first, and which of them count."""
        out = np.stack([self.index(x), *(self.index(x ^ (1 << i)) for i in range(23))], axis=1)
        rest = np.sort(out[:, 1:], axis=1)
        fresh = np.ones(rest.shape, bool)
        fresh[:, 1:] = rest[:, 1:] != rest[:, :-1]
        fresh &= rest != out[:, :1]
        return np.concatenate([out[:, :1], rest], axis=1), np.concatenate([np.ones((len(x), 1), bool), fresh], axis=1)
