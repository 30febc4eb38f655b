"""Key ranges as column expressions: a prefix of the 64-bit key space and its number of bits.

Prefixes are longs whose bits count as unsigned.  A shift by 64 changes nothing on
the JVM, so a range of no bits, the whole key space, is always a case of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shift(value: Column, by: Column, left: bool) -> Column:
    # the DataFrame functions take a constant number of bits only
    return F.call_function("shiftleft" if left else "shiftrightunsigned", value, by.cast("int"))


def mask(bits: Column) -> Column:
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(_shift(F.lit(-1).cast("long"), 64 - bits, True))


def contains(prefix: Column, bits: Column, key: Column) -> Column:
    return (bits == 0) | (key.bitwiseAND(mask(bits)) == prefix)


def valid(prefix: Column, bits: Column) -> Column:
    """Bits from 0 to 64, and none set in the prefix beyond them."""
    return bits.between(0, 64) & (prefix.bitwiseAND(mask(F.greatest(F.least(bits, F.lit(64)), F.lit(0)))) == prefix)


def _bit(bits: Column) -> Column:
    return _shift(F.lit(1).cast("long"), 64 - bits, True)


def lower_child(prefix: Column, bits: Column) -> Column:
    """Null for a range of a single key, which has no halves."""
    return F.when(bits < 64, F.struct(prefix.alias("prefix"), (bits + 1).alias("bits")))


def upper_child(prefix: Column, bits: Column) -> Column:
    return F.when(bits < 64, F.struct(prefix.bitwiseOR(_bit(bits + 1)).alias("prefix"), (bits + 1).alias("bits")))


def buddy(prefix: Column, bits: Column) -> Column:
    """The other half of the parent; null for the whole key space."""
    return F.when(bits > 0, prefix.bitwiseXOR(_bit(bits)))


def parent(prefix: Column, bits: Column) -> Column:
    return F.when(bits > 0, prefix.bitwiseAND(mask(bits - 1)))
