"""Zigzag, varint lengths and ratios as column expressions; all run inside code generation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The low 32 bits of a long.
LOW = 0xFFFFFFFF


def zigzag_encode(n: Column) -> Column:
    """Signed to unsigned in a long's bits: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def zigzag_decode(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def varint_length(z: Column) -> Column:
    """Bytes of z, taken as unsigned, at seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(z)) / F.lit(7.0))).cast("long")


def compression_ratio(original: Column, compressed: Column) -> Column:
    """original / compressed, 0 where nothing was compressed to."""
    return F.when(compressed == 0, F.lit(0.0)).otherwise(original.cast("double") / F.nullif(compressed, F.lit(0)).cast("double"))


def wrapped_int(n: Column) -> Column:
    """The low 32 bits of a long as a signed number."""
    return n.bitwiseAND(F.lit(LOW)).bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)


def halves(n: Column) -> tuple[Column, Column]:
    """The high and low 32 bits of a long, both unsigned, so that sums of them never overflow."""
    return F.shiftrightunsigned(n, 32), n.bitwiseAND(F.lit(LOW))


def joined(high: Column, low: Column) -> Column:
    """The long of high * 2**32 + low modulo 2**64; both may be sums and differences of halves."""
    return F.shiftleft((high + F.shiftright(low, 32)).bitwiseAND(F.lit(LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def to_bits(column: Column, kind: T.DataType) -> Column:
    """A number's bit pattern as a long, that of a 4-byte type as a signed 32-bit number; nulls stay.

    Integers are their own pattern. Spark has no expression for a float's, so Arrow batches are taken
    as integers where they lie.
    """
    if isinstance(kind, T.IntegerType | T.LongType):
        return column.cast("long")
    whole = pa.int64() if isinstance(kind, T.DoubleType) else pa.int32()

    @F.arrow_udf("long")
    def pattern(x: pa.Array) -> pa.Array:
        return x.view(whole).cast(pa.int64())

    return F.when(column.isNotNull(), pattern(F.coalesce(column, F.lit(0).cast(kind))))


def from_bits(bits: Column, kind: T.DataType) -> Column:
    """The number of to_bits."""
    if isinstance(kind, T.IntegerType | T.LongType):
        return bits.cast(kind)
    whole, plain = (pa.int64(), pa.float64()) if isinstance(kind, T.DoubleType) else (pa.int32(), pa.float32())

    @F.arrow_udf(kind)
    def number(x: pa.Array) -> pa.Array:
        return x.cast(whole).view(plain)

    return F.when(bits.isNotNull(), number(F.coalesce(bits, F.lit(0).cast("long"))))
