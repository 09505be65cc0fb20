"""Chance that depends on a seed and a key only: the same rows give the same draw in any order, partition or engine."""

from __future__ import annotations

from math import sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: one repository in so many is held out.
HOLDOUT = 100


def order_key(seed: int, *keys: Column) -> Column:
    """A text that puts rows into a random order; add the key itself to settle ties."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 up to, not including, 1."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def held_out(repo: Column, modulus: int = HOLDOUT) -> Column:
    """Whether a repository is held out, by the checksum of its name; rows without one never are."""
    return F.coalesce(F.crc32(repo.cast("binary")) % modulus == 0, F.lit(False))


_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_word(words: list, rows: int) -> np.ndarray:
    """The first 32 bits of the MD5 sums of ``rows`` one-block messages; a word is a number where all share it."""
    kind = np.uint32
    a, b, c, d = (np.full(rows, x, kind) for x in _START)
    f, g = np.empty(rows, kind), np.empty(rows, kind)
    for i in range(64):
        turn, step = divmod(i, 16)
        if turn == 0:
            at = step
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            at = (5 * step + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            at = (3 * step + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * step % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[at]
        if isinstance(word, int):
            np.add(f, kind(word + _SINES[i] & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, kind(_SINES[i]), out=f)
        by = _TURNS[turn][i % 4]
        np.left_shift(f, kind(by), out=g)
        np.right_shift(f, kind(32 - by), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a  # the old a is free for the next step
    return (a + kind(_START[0])).byteswap()


def order_codes(seed: int, first: int, count: int, block: int = 16_384) -> np.ndarray:
    """For the numbers i from 0 to ``count``, the first eight digits of :func:`order_key` of ``seed``, ``first`` and i as
    whole numbers, by NumPy: a column of so many texts costs several times as much."""
    out = np.empty(count, np.uint32)
    head = f"{seed}:{first}:".encode()
    lo = 0
    while lo < count:
        digits = len(str(lo))
        hi = min(count, lo + block, 10**digits)
        size = len(head) + digits
        if size > 55:
            raise ValueError(f"{seed}:{first} is too long")
        whole = (head + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
        words: list = [int.from_bytes(whole[i : i + 4], "little") for i in range(0, 64, 4)]
        rest = np.arange(lo, hi, dtype=np.uint32)
        for at in range(size - 1, len(head) - 1, -1):
            tens = rest // np.uint32(10)
            byte = (rest - tens * np.uint32(10) + np.uint32(48)) << np.uint32(8 * (at % 4))
            words[at // 4] = byte + np.uint32(words[at // 4]) if isinstance(words[at // 4], int) else words[at // 4] + byte
            rest = tens
        out[lo:hi] = _first_word(words, hi - lo)
        lo = hi
    return out
