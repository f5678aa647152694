"""Byte-level scalar functions as Column expressions, with Arrow UDFs for base58 alone.

Integers read from bytes are little-endian unless said otherwise. ``u64`` values are
DECIMAL(20, 0), since the largest don't fit a BIGINT; 128-bit values stay binary.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Bitcoin base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_VALUE = {c: i for i, c in enumerate(ALPHABET)}


def b58encode(data: bytes) -> str:
    zeros = len(data) - len(data.lstrip(b"\0"))
    n, out = int.from_bytes(data, "big"), []
    while n:
        n, r = divmod(n, 58)
        out.append(ALPHABET[r])
    return "1" * zeros + "".join(reversed(out))


def b58decode(text: str) -> bytes:
    """Raises ValueError on a character outside the alphabet."""
    n = 0
    for c in text:
        if c not in _VALUE:
            raise ValueError(f"not a base58 character: {c!r}")
        n = n * 58 + _VALUE[c]
    zeros = len(text) - len(text.lstrip("1"))
    return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")


@F.pandas_udf(T.StringType())
def base58(data: pd.Series) -> pd.Series:
    """Base58 text of binary values, for display at the edge of a query."""
    return data.map(lambda x: None if x is None else b58encode(bytes(x)))


@F.pandas_udf(T.BinaryType())
def unbase58(text: pd.Series) -> pd.Series:
    """Bytes of base58 texts; null where the text is not base58."""

    def one(x):
        try:
            return None if x is None else b58decode(x)
        except ValueError:
            return None

    return text.map(one)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def window(data: str | Column, offset: int | Column, length: int | Column) -> Column:
    """``length`` bytes from ``offset`` (0-based); null if the data ends before."""
    d = _col(data)
    off = F.lit(offset) if isinstance(offset, int) else offset
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(F.octet_length(d) >= off + n, F.substring(d, off + 1, n))


def _swapped(n: Column) -> Column:
    """A BIGINT with the halves of each of its bytes exchanged."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)
    return F.shiftleft(n.bitwiseAND(low), 4).bitwiseOR(F.shiftright(n, 4).bitwiseAND(low))


def integer(raw: Column, big_endian: bool = False) -> Column:
    """The BIGINT with the bits of up to 8 bytes; what is missing above them is zero.

    Hex digits reversed as text are the bytes in reverse order with their halves exchanged,
    so the bytes are named once. (``reverse`` on binary would reverse UTF-8 characters.)
    """
    if big_endian:
        return F.conv(F.hex(raw), 16, -10).cast("bigint")
    return _swapped(F.conv(F.reverse(F.hex(raw)), 16, -10).cast("bigint"))


def unsigned(n: Column) -> Column:
    """The bits of a BIGINT as an unsigned number, DECIMAL(20, 0)."""
    d = n.cast("decimal(20,0)")
    return F.when(n < 0, (d + F.lit(Decimal(1 << 64))).cast("decimal(20,0)")).otherwise(d)


def uint(data: str | Column, offset: int | Column, size: int, big_endian: bool = False) -> Column:
    """Unsigned integer of 1, 2, 4 (BIGINT) or 8 bytes (DECIMAL(20, 0)); null if the data is too short."""
    n = integer(window(data, offset, size), big_endian)
    return unsigned(n) if size == 8 else n


def le_bytes(n: Column, size: int) -> Column:
    """Little-endian bytes of a non-negative integer column; the inverse of ``uint``."""
    return F.unhex(F.reverse(F.lpad(F.hex(_swapped(n.cast("bigint"))), 2 * size, "0")))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of unsigned 64-bit values, held at their greatest."""
    top = F.lit(Decimal((1 << 64) - 1)).cast("decimal(20,0)")
    return F.least((a.cast("decimal(20,0)") + b.cast("decimal(20,0)")).cast("decimal(21,0)"), top).cast("decimal(20,0)")


def saturating_sub(a: Column, b: Column) -> Column:
    """The difference of unsigned 64-bit values, not below zero."""
    return F.greatest((a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("decimal(21,0)"), F.lit(0)).cast("decimal(20,0)")


def checked_add(a: Column, b: Column) -> Column:
    """The sum of unsigned 64-bit values, null where it doesn't fit."""
    total = (a.cast("decimal(20,0)") + b.cast("decimal(20,0)")).cast("decimal(21,0)")
    return F.when(total <= F.lit(Decimal((1 << 64) - 1)), total.cast("decimal(20,0)"))


def sint(data: str | Column, offset: int | Column, size: int, big_endian: bool = False) -> Column:
    """Signed integer of 1 to 8 bytes as BIGINT."""
    n = integer(window(data, offset, size), big_endian)
    return n if size == 8 else F.when(n >= 1 << (8 * size - 1), n - (1 << (8 * size))).otherwise(n)


def short_u16(data: bytes, offset: int = 0) -> tuple[int, int]:
    """(value, bytes read) of a compact 16-bit integer; ValueError if it is cut, too long or not minimal."""
    value = 0
    for i in range(3):
        if offset + i >= len(data):
            raise ValueError("compact integer is cut")
        b = data[offset + i]
        value |= (b & 0x7F) << (7 * i)
        if not b & 0x80:
            if i and not b:
                raise ValueError("compact integer is not minimal")
            if value > 0xFFFF:
                raise ValueError("compact integer is above 65535")
            return value, i + 1
    raise ValueError("compact integer is too long")


def zigzag_varint(n: int) -> bytes:
    """Protocol-buffer varint of a zigzag-coded integer."""
    z = (n << 1) if n >= 0 else ((-n << 1) - 1)
    out = bytearray()
    while True:
        b = z & 0x7F
        z >>= 7
        out.append(b | (0x80 if z else 0))
        if not z:
            return bytes(out)


def discriminator(namespace: str, name: str) -> bytes:
    """The first 8 bytes of SHA-256 of ``namespace:name``."""
    import hashlib

    return hashlib.sha256(f"{namespace}:{name}".encode()).digest()[:8]


def discriminator_col(namespace: str, name: str | Column) -> Column:
    """The same as a Column, as 16 lower-case hex digits."""
    return F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), _col(name)).cast("binary"), 256), 1, 16)


def canonical_base64(text: str | Column) -> Column:
    """Decoded bytes, or null where the text is not the one canonical encoding of its bytes."""
    t = _col(text)
    data = F.try_to_binary(t, F.lit("base64"))
    return F.when(F.base64(data) == t, data)


def _words(name: str) -> list[str]:
    import re

    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+", name)


def snake(name: str) -> str:
    return "_".join(w.lower() for w in _words(name))


def camel(name: str) -> str:
    w = [x.lower() for x in _words(name)]
    return w[0] + "".join(x.capitalize() for x in w[1:]) if w else ""


def pascal(name: str) -> str:
    return "".join(x.capitalize() for x in (w.lower() for w in _words(name)))
