"""Keyed pseudo-random numbers that do not depend on partitioning.

``rand()``/``randn()``/``sample()`` change with the partition layout, so every
random choice in the engine is a pure function of a key:

    bits(key)    = first 32 bits of md5("s<seed>|part1|part2|...")
    uniform(key) = (bits + 0.5) / 2^32            in (0, 1)
    normal(key)  = sqrt(-2 ln u1) * cos(2 pi u2), with u1 and u2 taken from
                   the first and second 32 bits of the same md5 digest

The same formulas are emitted as DuckDB SQL text for the oracle queries, so a
sample drawn by Spark is exactly the sample the oracle draws.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
TWO_52 = 4503599627370496.0

KeyPart = Column | str | int


def _spark_part(part: KeyPart) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def hash_key(seed: int, parts: Sequence[KeyPart]) -> Column:
    return F.concat_ws("|", F.lit(f"s{seed}"), *[_spark_part(p) for p in parts])


def hash_bits(seed: int, *parts: KeyPart) -> Column:
    """Unsigned 32-bit integer (as bigint) drawn from the key."""
    digest = F.md5(hash_key(seed, parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int, *parts: KeyPart) -> Column:
    return (hash_bits(seed, *parts).cast("double") + F.lit(0.5)) / F.lit(TWO_32)


def hash_index(seed: int, n: Column, *parts: KeyPart) -> Column:
    """Row number in ``0 .. n - 1`` from the key's first 52 bits, so that every
    row of a block of up to 2^52 rows can be drawn."""
    digest = F.md5(hash_key(seed, parts))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return F.floor(bits.cast("double") / F.lit(TWO_52) * n).cast("bigint")


def hash_normal(seed: int, *parts: KeyPart) -> Column:
    """Standard normal by Box-Muller from one digest (two 32-bit uniforms)."""
    digest = F.md5(hash_key(seed, parts))
    u1 = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(TWO_32)
    u2 = (F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(TWO_32)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# --- DuckDB SQL twins (used only by the oracle registry and tests) ---------


def _sql_part(part: str | int) -> str:
    """``int`` → literal text; ``str`` starting with ``@`` → column expression."""
    if isinstance(part, int):
        return f"'{part}'"
    if part.startswith("@"):
        return f"CAST({part[1:]} AS VARCHAR)"
    return f"'{part}'"


def sql_hash_bits(seed: int, *parts: str | int) -> str:
    key = ", ".join([f"'s{seed}'"] + [_sql_part(p) for p in parts])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {key})), 1, 8)) AS BIGINT)"


def sql_hash_uniform(seed: int, *parts: str | int) -> str:
    return f"((CAST({sql_hash_bits(seed, *parts)} AS DOUBLE) + 0.5) / 4294967296.0)"


def sql_hash_index(seed: int, n: str, *parts: str | int) -> str:
    key = ", ".join([f"'s{seed}'"] + [_sql_part(p) for p in parts])
    bits = f"CAST(('0x' || substr(md5(concat_ws('|', {key})), 1, 13)) AS BIGINT)"
    return f"CAST(floor(CAST({bits} AS DOUBLE) / {TWO_52} * {n}) AS BIGINT)"


def sql_hash_normal(seed: int, *parts: str | int) -> str:
    key = ", ".join([f"'s{seed}'"] + [_sql_part(p) for p in parts])
    digest = f"md5(concat_ws('|', {key}))"
    u1 = f"((CAST(CAST(('0x' || substr({digest}, 1, 8)) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0)"
    u2 = f"((CAST(CAST(('0x' || substr({digest}, 9, 8)) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


# --- Python twin (driver-side constants, in-task seeds) -------------------


def py_hash_bits(seed: int, *parts: str | int) -> int:
    key = "|".join([f"s{seed}"] + [str(p) for p in parts])
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def py_hash_uniform(seed: int, *parts: str | int) -> float:
    return (py_hash_bits(seed, *parts) + 0.5) / TWO_32


def py_hash_normal(seed: int, *parts: str | int) -> float:
    key = "|".join([f"s{seed}"] + [str(p) for p in parts])
    digest = hashlib.md5(key.encode()).hexdigest()
    u1 = (int(digest[:8], 16) + 0.5) / TWO_32
    u2 = (int(digest[8:16], 16) + 0.5) / TWO_32
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)


_MD5_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_MD5_AT_ONCE = 1 << 15  # messages hashed together: the working arrays stay in the cache


def _np_md5_start(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of ``n`` one-block messages, given as
    16 words each: a number where all messages agree, else an array."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            w = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            w = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            w = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            w = words[7 * i % 16]
        f += a
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(_MD5_ADD[i])
        else:
            f += np.uint32((w + _MD5_ADD[i]) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_MD5_TURN[i]), out=g)
        np.right_shift(f, np.uint32(32 - _MD5_TURN[i]), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += _MD5_START[0]
    b += _MD5_START[1]
    return a, b


def _np_digest_start(prefix: bytes, last: np.ndarray) -> np.ndarray:
    """The first 64 bits of the md5 of ``prefix`` followed by each number of ``last`` (from 0 on) in decimals."""
    out = np.empty(len(last), np.uint64)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), last, side="right") + 1
    for k in np.unique(digits).tolist():
        size = len(prefix) + k
        block = bytearray(64)
        block[: len(prefix)] = prefix
        block[size] = 0x80
        block[56:] = (8 * size).to_bytes(8, "little")
        common = np.frombuffer(bytes(block), "<u4").tolist()
        rows = np.flatnonzero(digits == k)
        for lo in range(0, len(rows), _MD5_AT_ONCE):
            at = rows[lo : lo + _MD5_AT_ONCE]
            words, rest = list(common), last[at]
            for place in range(size - 1, size - 1 - k, -1):
                rest, digit = np.divmod(rest, 10)
                byte = (digit + 48).astype(np.uint32) << np.uint32(8 * (place % 4))
                word = words[place // 4]
                words[place // 4] = byte + (word if isinstance(word, np.ndarray) else np.uint32(word))
            high, low = (x.byteswap().astype(np.uint64) for x in _np_md5_start(words, len(at)))
            out[at] = (high << np.uint64(32)) | low
    return out


def np_hash_index(seed: int, n: int, last: np.ndarray, *parts: str | int) -> np.ndarray:
    """``hash_index`` of many keys that differ in their last part only."""
    key = ("|".join([f"s{seed}"] + [str(p) for p in parts]) + "|").encode()
    last = np.asarray(last, dtype=np.int64)
    if len(key) + 18 <= 55 and (len(last) == 0 or 0 <= last.min() and last.max() < 10**18):
        start = _np_digest_start(key, last)  # one md5 block
    else:
        prefix, digests = hashlib.md5(key), []
        for x in last.tolist():
            h = prefix.copy()
            h.update(b"%d" % x)
            digests.append(h.digest())
        start = np.frombuffer(b"".join(digests), dtype=">u8")[::2].astype(np.uint64)
    bits = start >> np.uint64(12)
    return np.floor(bits.astype(np.float64) / TWO_52 * n).astype(np.int64)


# --- Integer mixing hash (hot paths with billions of keys) -----------------
#
# md5 over a formatted string costs a few hundred nanoseconds per row. Where
# one row per (attacker, candidate item) is hashed, a pure-integer mixer is
# used instead: Lehmer multiplications modulo the prime 2^31 - 1 with
# xor-shift steps. Every product stays below 2^48, so the arithmetic is exact
# in 64-bit integers on both engines (ANSI overflow checks never trigger).

MIX_P = 2147483647  # 2^31 - 1
MIX_A, MIX_B = 48271, 69621  # Lehmer multipliers
MIX_SHIFT_1, MIX_SHIFT_2 = 13, 11


def mix_bits(seed: int, *parts: Column | int) -> Column:
    """31-bit keyed hash of integer parts, in ``[0, 2^31 - 1)``."""
    p = F.lit(MIX_P)
    h = F.lit((seed * MIX_A + 1) % MIX_P).cast("bigint")
    for part in parts:
        x = F.pmod((part if isinstance(part, Column) else F.lit(part)).cast("bigint"), p)
        h = F.pmod(h.bitwiseXOR(x) * F.lit(MIX_A), p)
        h = h.bitwiseXOR(F.shiftright(h, MIX_SHIFT_1))
        h = F.pmod(h * F.lit(MIX_B), p)
        h = h.bitwiseXOR(F.shiftright(h, MIX_SHIFT_2))
    return F.pmod(h * F.lit(MIX_A), p)


def mix_uniform(seed: int, *parts: Column | int) -> Column:
    return (mix_bits(seed, *parts).cast("double") + F.lit(0.5)) / F.lit(float(MIX_P))


def mix_normal(seed: int, *parts: Column | int) -> Column:
    """Box-Muller from two mixer uniforms (salts 1 and 2 appended)."""
    u1 = mix_uniform(seed, *parts, 1)
    u2 = mix_uniform(seed, *parts, 2)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sql_mix_bits(source: str, keep: str, seed: int, parts: Sequence[str | int], out: str) -> str:
    """DuckDB twin of ``mix_bits``: a SELECT of the columns ``keep`` of ``source``
    and the hash as ``out``. Each step is a sub-select, so that the text grows
    with the number of parts only."""
    p = MIX_P
    sql = f"SELECT {keep}, CAST({(seed * MIX_A + 1) % p} AS BIGINT) AS _h FROM {source}"
    for part in parts:
        sql = f"SELECT {keep}, (xor(_h, CAST({part} AS BIGINT) % {p}) * {MIX_A}) % {p} AS _h FROM ({sql})"
        sql = f"SELECT {keep}, (xor(_h, _h >> {MIX_SHIFT_1}) * {MIX_B}) % {p} AS _h FROM ({sql})"
        sql = f"SELECT {keep}, xor(_h, _h >> {MIX_SHIFT_2}) AS _h FROM ({sql})"
    return f"SELECT {keep}, (_h * {MIX_A}) % {p} AS {out} FROM ({sql})"


def sql_mix_normal(source: str, keep: str, seed: int, parts: Sequence[str | int], out: str) -> str:
    one = sql_mix_bits(source, keep, seed, [*parts, 1], "_b1")
    both = sql_mix_bits(f"({one})", f"{keep}, _b1", seed, [*parts, 2], "_b2")
    u1, u2 = (f"((CAST({b} AS DOUBLE) + 0.5) / {float(MIX_P)})" for b in ("_b1", "_b2"))
    return f"SELECT {keep}, sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}) AS {out} FROM ({both})"


def py_mix_bits(seed: int, *parts: int) -> int:
    h = (seed * MIX_A + 1) % MIX_P
    for x in parts:
        h = ((h ^ (int(x) % MIX_P)) * MIX_A) % MIX_P
        h ^= h >> MIX_SHIFT_1
        h = (h * MIX_B) % MIX_P
        h ^= h >> MIX_SHIFT_2
    return (h * MIX_A) % MIX_P
