"""Keyed hashes that give the same sample whatever the partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(x: Column) -> Column:
    """The first 32 bits of the md5 of a string, as a long."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def sample_key(seed: str, *columns: Column | str) -> Column:
    """Order by this for a uniform sample without replacement keyed by ``seed``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))


#: Shifts of md5's steps, their constants, and the words it starts from (RFC 1321).
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_CONSTANTS = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


#: Messages that are hashed side by side: their words stay in a core's cache.
SIDE_BY_SIDE = 1 << 14


class Md5Starts:
    """The first 32 bits of the md5 of one prefix and each of many short endings, which are hashed side by side."""

    def __init__(self, endings: list[bytes]):
        self.endings = endings
        self.sizes = np.array([len(e) for e in endings], np.uint32)
        self.longest = int(self.sizes.max(initial=0))
        self.made: dict[int, np.ndarray] = {}

    def _words(self, offset: int) -> np.ndarray:
        """Words of 32 bits of the endings from ``offset`` bytes into a word, with the bit that ends a message."""
        if offset not in self.made:
            width = -(-(offset + self.longest + 1) // 4) * 4
            raw = b"".join((b"\0" * offset + e + b"\x80").ljust(width, b"\0") for e in self.endings)
            self.made[offset] = np.ascontiguousarray(np.frombuffer(raw, "<u4").reshape(len(self.endings), -1).T).astype(np.uint32)
        return self.made[offset]

    def after(self, prefix: bytes) -> np.ndarray:
        """Numbers in the order of the hexadecimal md5's first eight digits, one for each ending."""
        if len(prefix) + self.longest > 55:  # more than one block
            return np.array([int(hashlib.md5(prefix + e).hexdigest()[:8], 16) for e in self.endings], np.uint32)
        out = np.empty(len(self.endings), np.uint32)
        whole, offset = divmod(len(prefix), 4)
        first, own = np.frombuffer(prefix.ljust(64, b"\0"), "<u4").tolist(), self._words(offset)
        for at in range(0, len(out), SIDE_BY_SIDE):
            part, words = slice(at, at + SIDE_BY_SIDE), list(first)
            words[whole : whole + len(own)] = [w[part] + np.uint32(x) for w, x in zip(own, first[whole:], strict=False)]
            words[14] = (self.sizes[part] + np.uint32(len(prefix))) * np.uint32(8)
            out[part] = _md5_start(words, len(words[14])).byteswap()
        return out


def _md5_start(words: list, n: int) -> np.ndarray:
    """The first word of the md5 of ``n`` messages of one block; ``words``: its 16 words, a number where all messages have the same."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _WORDS)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps make the other words
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(_CONSTANTS[i])
        else:
            f += np.uint32((_CONSTANTS[i] + words[g]) & 0xFFFFFFFF)
        f += a
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(_WORDS[0])
