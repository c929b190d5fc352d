"""Seeded choices as pure functions of keys: an md5 prefix, which SQL engines share, instead of rand()."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(parts: tuple[Column | str | int, ...]) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash32(*parts: Column | str | int) -> Column:
    """A number under 2^32 from the parts joined by bars; columns stay columns, all else is literal."""
    return F.conv(F.substring(F.md5(_joined(parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """In [0, 1)."""
    return hash32(*parts) / F.lit(float(2**32))


def hash_key(*parts: Column | str | int) -> Column:
    """A string to order by."""
    return F.md5(_joined(parts))


def sql_hash32(expr: str) -> str:
    """The same in DuckDB SQL; expr is the joined string."""
    return f"CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT)"


def sql_uniform(expr: str) -> str:
    return f"({sql_hash32(expr)} / 4294967296.0e0)"


#: So many messages go through the rounds of md5 at once: their words stay in the cache.
BLOCK = 8192
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]


@lru_cache(maxsize=128)
def _digits(start: int, stop: int) -> list[np.ndarray]:
    """The decimal digits, as characters' codes, of numbers that have equally many."""
    numbers, n = np.arange(start, stop, dtype=np.int64), len(str(start))
    return [(numbers // 10 ** (n - 1 - k) % 10 + 48).astype(np.uint32) for k in range(n)]


def _first_words(head: bytes, start: int, stop: int) -> np.ndarray:
    """The first word of md5 of head and each number; all have equally many digits, and fit one block."""
    digits = _digits(start, stop)
    fixed = bytearray(64)
    fixed[: len(head)] = head
    size = len(head) + len(digits)
    fixed[size], fixed[56:64] = 0x80, (8 * size).to_bytes(8, "little")
    words: list[np.ndarray | np.uint32] = list(np.frombuffer(bytes(fixed), "<u4"))
    for k, d in enumerate(digits, len(head)):
        words[k // 4] = (d << np.uint32(8 * (k % 4))) | words[k // 4]
    a, b, c, d = (np.full(stop - start, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[at]
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            word = 0
        np.add(f, np.uint32((int(_SINES[i]) + int(word)) & 0xFFFFFFFF), out=f)
        np.add(f, a, out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + np.uint32(0x67452301)).byteswap()


def hash32_numbers(head: str, start: int, stop: int) -> np.ndarray:
    """hash32(head, number) for each whole number from start, as an array."""
    first, out, at = f"{head}|".encode(), [np.empty(0, np.uint32)], start
    while at < stop:
        end = min(stop, 10 ** len(str(at)), at + BLOCK)
        if len(first) + len(str(at)) <= 55:
            out.append(_first_words(first, at, end))
        else:
            out.append(np.array([int.from_bytes(hashlib.md5(first + b"%d" % x).digest()[:4], "big") for x in range(at, end)], np.uint32))
        at = end
    return np.concatenate(out)


def config_hash(config: dict) -> str:
    """Twelve hex digits of a configuration, whatever the order of its keys."""
    import hashlib

    return hashlib.blake2b("|".join(f"{k}={config[k]}" for k in sorted(config)).encode(), digest_size=6).hexdigest()
