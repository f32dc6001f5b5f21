"""Word shingles as 64-bit hashes, in numpy.

Words are runs of letters, digits and underscores, lower-cased. A shingle is five words in a row; a text of one to four
words is one shingle, a text without words has none. Long texts are read piece by piece; only a hash a word is kept.
"""

from __future__ import annotations

import re

import numpy as np

from quarrylight.llm.bpe import pieces
from quarrylight.llm.minimal_hash import mix64

WORDS = 5
_WORD = re.compile(r"\w+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, _U)
#: Odd multipliers by the place of a word in its shingle.
_PLACES = [_U(pow(0xD6E8FEB86659FD93, j + 1, 2**64)) for j in range(64)]


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers), 64), _U(_BASE))
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    parts = []
    for piece in pieces(text or "", 1 << 20):
        joined = " ".join(_WORD.findall(piece.lower())).encode("utf-8", "surrogatepass")
        if not joined:
            continue
        raw = np.frombuffer(joined, np.uint8)
        gaps = raw == 32
        starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(gaps) + 1))
        lengths = np.diff(np.append(starts, len(raw)))
        place = np.arange(len(raw)) - np.repeat(starts, lengths)
        values = np.where(gaps, _U(0), raw.astype(_U) + _U(1)) * _powers_to(int(lengths.max()) + 1)[place]
        parts.append(mix64(np.add.reduceat(values, starts)))
    return np.concatenate(parts) if parts else np.empty(0, _U)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each shingle, in order, repeats included."""
    return shingles_of(word_hashes(text), words)


def shingles_of(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The shingles of hashed words."""
    if not len(own):
        return own
    n = min(words, len(own))
    sums = np.full(len(own) - n + 1, _U(n))
    for j in range(n):
        sums += own[j : len(own) - n + 1 + j] * _PLACES[j]
    return mix64(sums)


def numbered(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles and their counts."""
    return np.unique(shingles, return_counts=True)


def as_set(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th occurrence of a shingle becomes an element of its own, so that the Jaccard
    similarity of the sets is the weighted Jaccard similarity of the counts."""
    found, counts = numbered(shingles)
    if len(found) == len(shingles):
        return found
    turn = np.arange(len(shingles)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix64(np.repeat(found, counts) + turn.astype(_U) * _U(_BASE))
