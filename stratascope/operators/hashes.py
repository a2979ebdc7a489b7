"""MD5 of many short names at once, as arrays: the numbers that ``nulls.drawn`` gives, without a call for each."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_ADDED = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNED = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def digests(heads: Sequence[str], names: pa.StringArray, tail: str = "", at_once: int = 16384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The first two words of the digests of head + name + tail: a pair of arrays over the names for each head, in order.

    Heads of one length share all that doesn't depend on them. What doesn't fit into one block of 64 bytes is hashed singly.
    """
    for head in heads:
        head.encode("ascii")
    whole = [name.encode() + tail.encode() for name in names.to_pylist()]
    out = [(np.empty(len(whole), np.uint32), np.empty(len(whole), np.uint32)) for _ in heads]
    for low in range(0, len(whole), at_once):
        own = whole[low : low + at_once]
        sizes = np.array([len(x) for x in own])
        blocks = np.zeros((len(own), 64), np.uint8)
        for length in dict.fromkeys(map(len, heads)):
            short = sizes + length <= 55
            blocks[:] = 0
            rows = np.repeat(np.arange(len(own)), np.where(short, sizes, 0))
            at = np.arange(len(rows)) - np.repeat(np.cumsum(np.where(short, sizes, 0)) - np.where(short, sizes, 0), np.where(short, sizes, 0))
            blocks[rows, length + at] = np.frombuffer(b"".join(x for x, s in zip(own, short) if s), np.uint8)
            blocks[np.flatnonzero(short), (length + sizes)[short]] = 0x80
            blocks[:, 56:58] = (8 * (length + sizes)).astype("<u2").view(np.uint8).reshape(-1, 2)
            words = np.ascontiguousarray(blocks.view("<u4").T)
            added = [words[w] + k for w, k in zip(_WORD, _ADDED)]
            for i, head in enumerate(heads):
                if len(head) != length:
                    continue
                first = np.frombuffer(head.encode().ljust(-(-length // 4) * 4, b"\0"), "<u4")
                turned = [added[k] + first[w] if w < len(first) else added[k] for k, w in enumerate(_WORD)]
                a, b = _rounds(turned)
                out[i][0][low : low + at_once], out[i][1][low : low + at_once] = a, b
                for k in np.flatnonzero(~short):
                    out[i][0][low + k], out[i][1][low + k] = np.frombuffer(hashlib.md5(head.encode() + own[k]).digest()[:8], "<u4")
    yield from out


def _rounds(added: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The compression of one block, from the sums of its words and the constants, in the order of the steps."""
    n = len(added[0])
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    other, f = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for step, word in enumerate(added):
        if step < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif step < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif step < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += word
        turn = _TURNED[step // 16][step % 4]
        np.left_shift(f, np.uint32(turn), out=other)
        f >>= np.uint32(32 - turn)
        f |= other
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def numbers(words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whole numbers of 48 bits from two words of a digest, as ``nulls.drawn`` reads them."""
    a, b = (w.byteswap().astype(np.int64) for w in words)
    return a << 16 | b >> 16
