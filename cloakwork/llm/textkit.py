"""Vectorised words and hashes for the operators that run in Arrow batches.

A word here is a run of letters, digits or marks after lower-casing; ASCII punctuation and the common
Unicode spaces and punctuation separate words. Hashes are polynomial over UTF-8 bytes modulo 2^64,
then mixed, so any run of words has a hash from prefix sums. They are equal on every executor.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)
_APART = re.compile("[\u0080-©«-±´¶-¸»¿  -⁯₠-⃏←-⯿　-〿︰-﹏！-／�]+")
_powers: dict[int, np.ndarray] = {}


def normalise(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = _APART.sub(" ", text.lower())
    return text.encode("utf-8", "replace").translate(_TABLE)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 18), base, U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (multiply and shift)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a normalised buffer."""
    edge = np.diff(np.concatenate(([0], (data != 32).view(np.int8), [0])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(data.astype(U64) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(U64))


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on; the last n - 1 positions are dropped."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[n:] - sums[:m]) * _power(_INVERSE, m))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions whose run would leave the array are dropped."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for j in range(n):
        out = out * U64(0xBF58476D1CE4E5B9) + words[j : j + m]
    return mix(out)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of n-word shingles; a shorter text is one shingle of all its words; no words, none."""
    return runs(words, min(n, len(words))) if len(words) else words


def batches(texts: Iterable[str | None], size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups texts to buffers of about `size` bytes: (first text, past the last, buffer, starts, ends, cuts).

    Words of text first+i are those from cuts[i] to cuts[i+1].
    """

    def whole(first: int, parts: list[bytes]):
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        starts, ends = bounds(data)
        return first, first + len(parts), data, starts, ends, np.searchsorted(starts, offsets)

    parts: list[bytes] = []
    held = first = 0
    for at, text in enumerate(texts):
        parts.append(normalise(text))
        held += len(parts[-1]) + 1
        if held >= size:
            yield whole(first, parts)
            parts, held, first = [], 0, at + 1
    if parts:
        yield whole(first, parts)


def slices(source: Iterator, rows: int) -> Iterator:
    """Arrow batches of a few rows each, so that a worker holds the Python texts of no more."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order."""
    for first, last, data, starts, ends, cuts in batches(texts):
        hashes = word_hashes(data, starts, ends)
        for i in range(last - first):
            yield hashes[cuts[i] : cuts[i + 1]]
