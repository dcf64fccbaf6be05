"""Expressions with the arithmetic of fixed-width integers and of two-decimal reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element types: the only typed data are these six; Spark has no unsigned ones and widens them.
TYPES = {"int": "int", "unsigned int": "bigint", "long": "bigint", "unsigned long": "decimal(20,0)", "float": "float", "double": "double"}
INTEGRAL = {"int", "unsigned int", "long", "unsigned long"}


def wrap(x: Column, bits: int, signed: bool = True) -> Column:
    """x reduced to a fixed width as machine integers are, for long x."""
    size, half = 1 << bits, 1 << bits - 1
    return F.pmod(x + half, F.lit(size)) - half if signed else F.pmod(x, F.lit(size))


def wrap64(x: Column, signed: bool = True) -> Column:
    """A whole decimal x reduced to 64 bits as machine integers are."""
    size, half = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")
    low = lambda y: F.pmod(y, size)
    return low(low(x) + half) - half if signed else low(x)


def wrap_int32(x: Column) -> Column:
    return wrap(x.cast("bigint"), 32).cast("int")


def mixed(*numbers) -> Column:
    """A number from 0 to 2**32 - 1 that whole numbers decide and that looks random: the first eight
    digits of the MD5 of the numbers' decimals between colons, which any SQL engine can tell too."""
    text = F.concat_ws(":", *(F.lit(n) if isinstance(n, int) else n for n in numbers))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def wrap_int8(x: Column) -> Column:
    return wrap(x.cast("bigint"), 8).cast("int")


def two_decimals(x: Column) -> Column:
    """x to two decimals as C's printf rounds it: by the exact value of the double, and exact ties
    to the even digit. Where x * 100 looks like a tie, the product's own error decides."""
    y = x * 100
    low = F.floor(y)
    big = x * 134217729.0
    high = big - (big - x)
    error = (high * 100 - y) + (x - high) * 100
    tie = (error > 0) | ((error == 0) & (F.pmod(low, F.lit(2)) == 1))
    up = (y - low > 0.5) | ((y - low == 0.5) & tie)
    return (low + up.cast("bigint")) / 100.0


def truth(x: Column) -> Column:
    return x != 0
