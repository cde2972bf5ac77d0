"""Comparisons of a column with a literal, and their conjunction."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.types import column_type
from lamella.plans.query import CompareOp, Predicate

_COMPARE = {
    CompareOp.EQ: operator.eq,
    CompareOp.NEQ: operator.ne,
    CompareOp.LT: operator.lt,
    CompareOp.LTE: operator.le,
    CompareOp.GT: operator.gt,
    CompareOp.GTE: operator.ge,
}
_INTEGER_BITS = {T.IntegerType(): 31, T.LongType(): 63}


def typed_literal(value: object, kind: T.DataType) -> Column:
    """value as a literal of the column's own type, so that neither side of a comparison is widened."""
    if kind in _INTEGER_BITS:
        if isinstance(value, bool) or not isinstance(value, int | float) or value != value or int(value) != value:
            raise ValueError(f"{value!r} is no {kind.simpleString()}")
        bits = _INTEGER_BITS[kind]
        if not -(2**bits) <= int(value) < 2**bits:
            raise ValueError(f"{value!r} is out of range for {kind.simpleString()}")
        return F.lit(int(value)).cast(kind)
    if kind in (T.FloatType(), T.DoubleType()):
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise ValueError(f"{value!r} is no number")
        return F.lit(float(value) if not math.isinf(value) else value).cast(kind)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        raise ValueError(f"{value!r} is no string")
    return F.lit(value).cast(kind)


def compare(column: Column, op: CompareOp, value: Column) -> Column:
    return _COMPARE[op](column, value)


def condition(schema: T.StructType, predicate: Predicate) -> Column:
    """The predicate as a boolean column; null where the value is null, which a filter drops."""
    kind = column_type(schema, predicate.column)
    return compare(F.col(f"`{predicate.column}`"), predicate.op, typed_literal(predicate.value, kind))


def conjunction(schema: T.StructType, predicates: Iterable[Predicate]) -> Column | None:
    """All predicates, most selective hint first; None if there are none."""
    ordered = sorted(predicates, key=lambda p: p.selectivity_hint)
    return reduce(operator.and_, [condition(schema, p) for p in ordered]) if ordered else None


def apply(df: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    """The rows of df that satisfy all predicates."""
    found = conjunction(df.schema, predicates)
    return df if found is None else df.where(found)


def select_all(df: DataFrame) -> DataFrame:
    return df


def select_none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def positions(df: DataFrame, predicate: Predicate, ordinal: str) -> DataFrame:
    """(position): ordinals of the rows that satisfy the predicate; ordinal is a stored row number."""
    return apply(df, [predicate]).select(F.col(ordinal).alias("position"))
