"""A minimal perfect hash in numpy for keys of two 64-bit words, with arrays of fingerprints and values.

Level by level each key is hashed to a bit of a bitmap of ``GAMMA`` bits a key; keys that meet no other there keep their
bit, the rest go on to the next level. A key's slot is the number of bits set before its own. About 3 bits a key.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
_U = np.uint64


#: The finaliser of splitmix64 (fixed values).
_S30, _S27, _S31, _M1, _M2 = _U(30), _U(27), _U(31), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    out = x >> _S30
    out ^= x
    out *= _M1
    out ^= out >> _S27
    out *= _M2
    out ^= out >> _S31
    return out


def _at(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h1 ^ mix64(h2 + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64))) % _U(bits)).astype(np.int64)


class MinimalHash:
    """Build with ``of``, look up with ``slots``. Distinct keys get distinct slots 0 to n - 1; other keys any slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, n = [], 0
        for bitmap in levels:
            ones = np.cumsum(np.unpackbits(bitmap).reshape(-1, 64).sum(axis=1, dtype=np.int64))
            self.ranks.append(np.concatenate(([0], ones[:-1])) + n)
            n += int(ones[-1])
        self.n = n

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalHash:
        levels, level = [], 0
        while len(h1):
            bits = max(64, -(-int(len(h1) * GAMMA) // 64) * 64)
            at = _at(h1, h2, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone))
            left = ~alone[at]
            h1, h2, level = h1[left], h2[left], level + 1
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for level, (bitmap, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _at(h1[open_], h2[open_], level, len(bitmap) * 8)
            here = (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            found, word = at[here], at[here] >> 6
            # Bits set in the word before the own bit.
            words = bitmap.reshape(-1, 8)[word].copy().view(">u8").ravel().astype(np.uint64)
            shift = (found & 63).astype(np.uint64)
            before = np.where(shift == 0, _U(0), words >> (_U(64) - np.maximum(shift, _U(1))))
            out[open_[here]] = ranks[word] + np.bitwise_count(before).astype(np.int64)
            open_ = open_[~here]
            if not len(open_):
                break
        return out

    def to_bytes(self) -> list[bytes]:
        return [bitmap.tobytes() for bitmap in self.levels]

    @classmethod
    def from_bytes(cls, levels: list[bytes]) -> MinimalHash:
        return cls([np.frombuffer(x, np.uint8) for x in levels])
