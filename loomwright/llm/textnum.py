"""Vectorised word and shingle hashing for the Python-side text operators.

A text's UTF-8 bytes are scanned once with numpy: separators come from a
256-entry table, a word's 64-bit hash is a difference of polynomial prefix
sums, and a k-word shingle's hash mixes its k word hashes.  No Python loop runs
over words, so the cost is a few nanoseconds per byte.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, dtype=U)
_NEG = np.ones(1, dtype=U)


def separators(chars: bytes) -> np.ndarray:
    """A table that is True for each byte of ``chars``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


#: Words are runs of anything but ASCII white space.
SPACES = separators(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
NON_WORD = separators(bytes(c for c in range(128) if not chr(c).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> None:
    global _POW, _NEG
    have = len(_POW)
    if n <= have:
        return
    n = max(n, 2 * have, 1 << 16)
    with np.errstate(over="ignore"):
        for name, base in (("_POW", _BASE), ("_NEG", _INV)):
            grown = np.full(n, base, dtype=U)
            grown[0] = 1
            globals()[name] = np.cumprod(grown, dtype=U)


def word_hashes(text: str | None, table: np.ndarray = SPACES) -> np.ndarray:
    """One uint64 per word of the text with A-Z lower-cased; empty if there is none."""
    if not text:
        return np.empty(0, dtype=U)
    a = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    n = len(a)
    _powers(n + 1)
    edge = np.ones(n + 2, dtype=np.int8)
    edge[1:-1] = table[a]
    step = np.diff(edge)
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum((a.astype(U) + U(1)) * _POW[:n], out=total[1:])
    return mix((total[end] - total[start]) * _NEG[start] + (end - start).astype(U))


_COEF = mix(np.arange(1, 257, dtype=U)) | U(1)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every k-word window in order; the whole sequence as one if it is shorter."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = words[: n - k + 1] * _COEF[0]
    for j in range(1, k):
        out = out + words[j : n - k + 1 + j] * _COEF[j]
    return mix(out + U(k))


def shingle_set(text: str | None, k: int = 5, table: np.ndarray = SPACES) -> np.ndarray:
    """The sorted distinct k-word shingles of a text."""
    return np.unique(shingles(word_hashes(text, table), k))


def word_places(data: bytes, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some UTF-8 bytes begin and end."""
    edge = np.ones(len(data) + 2, dtype=np.int8)
    edge[1:-1] = table[np.frombuffer(data, dtype=np.uint8)]
    step = np.diff(edge)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


class Prefixes:
    """Sums from which the hash of any span of a sequence of numbers is a difference."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        _powers(n + 1)
        self.total = np.zeros(n + 1, dtype=U)
        np.cumsum(numbers.astype(U) * _POW[:n], out=self.total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * _NEG[start] + (end - start).astype(U))


def exact_words(data: bytes, table: np.ndarray = SPACES) -> np.ndarray:
    """One uint64 per word of some UTF-8 bytes, unchanged."""
    start, end = word_places(data, table)
    return Prefixes(np.frombuffer(data, dtype=np.uint8).astype(U) + U(1)).spans(start, end) if len(start) else np.empty(0, dtype=U)
