"""Word shingles of whole texts as sets of 64-bit numbers.

Words are maximal runs of bytes other than ASCII white space, after lower-casing
A-Z.  A word's number is a keyed hash of its bytes, kept in a bounded table; a
shingle's number mixes those of its words, over arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np

MASK = (1 << 64) - 1
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
WORDS_KEPT = 400_000


class _Numbers(dict):
    """Word to number; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        number = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"quarrylight words").digest(), "little")
        if len(word) <= 64:
            self[word] = number
        return number


_number = _Numbers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of all texts, and the first word's index of each text (one more at the end)."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    words = [p.split() for p in parts]  # of bytes: at ASCII white space
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    numbers = np.empty(int(at[-1]), np.uint64)
    for w, a, b in zip(words, at[:-1], at[1:], strict=True):
        numbers[a:b] = np.fromiter(map(_number.__getitem__, w), np.uint64, len(w))
    return numbers, at


def _shingles(texts: list, k: int) -> list[np.ndarray]:
    words, at = _words(texts)
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        grams = grams * STEP + words[j : j + len(grams)]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif n:
            whole = np.uint64(n)
            for w in words[a:b]:
                whole = (whole * STEP + w).astype(np.uint64) if isinstance(whole, np.ndarray) else np.uint64((int(whole) * int(STEP) + int(w)) & MASK)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list, k: int, chunk_bytes: int = 1 << 20):
    """For each text its sorted distinct ``k``-word shingles; fewer words form one shingle.

    Works through the texts in chunks of about ``chunk_bytes`` characters, so
    memory follows the longest text and not the batch.
    """
    chunk, size = [], 0
    for t in texts:
        n = len(t) if t is not None else 0
        if chunk and size + n > chunk_bytes:
            yield from _shingles(chunk, k)
            chunk, size = [], 0
        chunk.append(t)
        size += n
    if chunk:
        yield from _shingles(chunk, k)


def set_key(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
