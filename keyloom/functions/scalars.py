"""String, byte and checksum functions with the semantics of the store's client library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(s: Column, x: str) -> Column:
    return F.instr(s, x) - 1


def last_index_of(s: Column, x: str) -> Column:
    """Last place (from 0) of x in s, -1 where there is none; an empty x stands at the end."""
    if not x:
        return F.length(s)
    at = F.instr(F.reverse(s), x[::-1])
    return F.when(at == 0, -1).otherwise(F.length(s) - at - len(x) + 1)


def replace_first(s: Column, x: str, y: str) -> Column:
    at = F.instr(s, x)
    return F.when(at == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), F.lit(y), F.substring(s, at + len(x), F.length(s))))


def replace_last(s: Column, x: str, y: str) -> Column:
    at = last_index_of(s, x)
    return F.when(at < 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at), F.lit(y), F.substring(s, at + len(x) + 1, F.length(s))))


def part(s: Column, at: int, n: int = -1) -> Column:
    """n characters from place `at` (from 0); -1: all the rest."""
    return F.substring(s, F.lit(at + 1), F.length(s) if n < 0 else F.lit(n))


def bytes_hash(s: Column) -> Column:
    """h = 31 * h + signed byte over the UTF-8 bytes, in 64 bits with wrap-around.

    Held as a decimal below 2**64 at each step, so no step overflows under ANSI rules."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(s.cast("binary")), "(..)", "$1,"), ","), lambda h: F.when(h != "", F.conv(h, 16, 10).cast("decimal(38,0)")))
    signed = F.transform(F.filter(codes, lambda c: c.isNotNull()), lambda c: F.when(c > 127, c - 256).otherwise(c).cast("decimal(38,0)"))
    wrap = F.lit(str(2**64)).cast("decimal(38,0)")
    total = F.aggregate(signed, F.lit(0).cast("decimal(38,0)"), lambda h, c: F.pmod(h * F.lit(31).cast("decimal(3,0)") + c, wrap).cast("decimal(38,0)"))
    return F.when(total >= F.lit(str(2**63)).cast("decimal(38,0)"), total - wrap).otherwise(total).cast("long")


def char_at(s: Column, at: int) -> Column:
    """The character at a place (from 0); empty beyond the end."""
    return F.substring(s, at + 1, 1)


def is_digit(s: Column) -> Column:
    """Whether a text is one ASCII digit."""
    return s.rlike("^[0-9]$")


def is_space_char(s: Column) -> Column:
    """Whether a text is one ASCII white-space character."""
    return s.rlike(r"^[ \t\n\x0B\f\r]$")


def derived_key(value: Column, offset: int, size: int) -> Column:
    """The unsigned big-endian number of `size` bytes (7 at most) of a binary value, at an offset; null where the value ends before."""
    held = F.substring(value, offset + 1, size)
    return F.when(F.octet_length(held) == size, F.conv(F.hex(held), 16, 10).cast("long"))


def bytes_extend(value: Column, size: int) -> Column:
    """A binary value filled with zero bytes up to a size; longer ones stay."""
    return F.when(F.octet_length(value) >= size, value).otherwise(F.rpad(value, size, F.lit(bytearray(b"\0"))))


def crc32_msb(value: Column) -> Column:
    """CRC-32 with the most significant bit first (polynomial 0x04C11DB7, all ones at first, inverted at the end).

    It is the usual one of the bytes with their bits in reverse order, in reverse order itself."""
    nibbles = F.translate(F.hex(value), "0123456789ABCDEF", "084C2A6E195D3B7F")
    mirrored = F.crc32(F.unhex(F.regexp_replace(nibbles, "(.)(.)", "$2$1")))
    return F.conv(F.reverse(F.lpad(F.bin(mirrored), 32, "0")), 2, 10).cast("long")
