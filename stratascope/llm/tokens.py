"""Words of many texts at once, as arrays: where they start and end, and 64-bit hashes of them and of their prefixes.

A hash is a polynomial over the code points, so that one running sum over a block of texts gives the hash of every
stretch of it; SplitMix64's finish spreads it. Texts are taken in blocks of about BLOCK characters, a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 400_000
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finish, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers_known: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; kept while blocks are of the usual size."""
    own = _powers_known.get(base)
    if own is None or len(own) < n:
        own = np.full(max(n, 2 * BLOCK), base, np.uint64)
        own[0] = 1
        own = np.multiply.accumulate(own)
        if n <= 2 * BLOCK:
            _powers_known[base] = own
    return own[:n]


class Stretches:
    """Hashes of stretches of one array of codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
        salt = mixed(np.atleast_1d(salt).astype(np.uint64) + _MIX1)
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] ^ salt)


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form, where that is one code point, and whether it is a letter."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            letter[c] = True
            low = s.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return lower, letter


@dataclass
class Words:
    """The words of a block of texts: code-point places within each word's own text, and a stretch of words for each text."""

    start: np.ndarray
    end: np.ndarray
    #: Where each text's words begin in the arrays, and at last their number.
    first: np.ndarray
    whole: np.ndarray
    prefixes: list[np.ndarray]
    #: Where ``prefixes`` has no hash of its own, since the word isn't longer.
    short: list[np.ndarray]


def each(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column, made into Python objects a few at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of texts of BLOCK characters or one text."""
    held, chars = [], 0
    for t in texts:
        t = t or ""
        if held and chars + len(t) > BLOCK:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def letter_words(texts: list[str], prefixes: Sequence[int] = ()) -> Words:
    """Runs of letters, in lower case, with the hashes of their first letters."""
    lower, letter = letter_tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], letter[codes], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(start, begins)
    first[-1] = len(start)
    stretches = Stretches(lower[codes])
    whole, heads, short = stretches.hashes(start, end, 0), [], []
    for k in prefixes:
        few = end - start <= k
        heads.append(stretches.hashes(start, np.minimum(start + k, end), k))
        short.append(few)
    shift = np.repeat(begins[:-1], np.diff(first))
    return Words(start - shift, end - shift, first, whole, heads, short)


def blank_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words between ASCII white space, A-Z counted as a-z, and where each text's words begin in them."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"\n".join(raw).lower(), np.uint8)
    inside = np.concatenate(([False], (codes != 32) & ((codes < 9) | (codes > 13)), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in raw]]))
    first[-1] = len(start)
    return Stretches(codes).hashes(start, end, 0), first


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a text of fewer words is one shingle of them all."""
    for some in blocks(texts):
        h, first = blank_words(some)
        n = max(0, len(h) - words + 1)
        whole = np.full(n, np.uint64(words))
        for i in range(words):
            whole = mixed(whole * np.uint64(_BASE) + h[i : n + i])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b == a:
                yield np.empty(0, np.uint64)
            else:
                one = np.full(1, np.uint64(b - a))
                for i in range(a, b):
                    one = mixed(one * np.uint64(_BASE) + h[i])
                yield one
