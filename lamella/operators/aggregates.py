"""Global aggregates in one pass; every value is a double, and 0 over no rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.types import column_type
from lamella.plans.query import AggFunc, Aggregate

#: Bits of each part of an exact long sum: sums of parts fit a long up to 2**41 rows.
PART = 22


def exact_sum(column: Column, kind: T.DataType) -> Column:
    """The sum as a double; integers are summed exactly and rounded once.

    Ints sum in longs. Longs are cut in three parts whose sums are longs as well, so partial
    aggregation stays on primitive values, and only the final sum is put together as a decimal.
    """
    if isinstance(kind, T.IntegerType):
        return F.sum(column).cast("double")
    if isinstance(kind, T.LongType):
        mask = F.lit(2**PART - 1).cast("long")
        parts = (F.shiftright(column, 2 * PART), F.shiftright(column, PART).bitwiseAND(mask), column.bitwiseAND(mask))
        high, middle, low = (F.sum(p).cast("decimal(20,0)") for p in parts)
        scale = F.lit(2**PART).cast("decimal(8,0)")
        return (((high * scale + middle).cast("decimal(29,0)") * scale).cast("decimal(37,0)") + low).cast("double")
    return F.sum(column.cast("double"))


def expression(schema: T.StructType, aggregate: Aggregate) -> Column:
    """The aggregate as a double column, 0.0 over no (non-null) rows."""
    if not aggregate.column:
        return F.count(F.lit(1)).cast("double")
    kind = column_type(schema, aggregate.column)
    column = F.col(f"`{aggregate.column}`")
    if aggregate.func is AggFunc.COUNT:
        return F.count(column).cast("double")
    if isinstance(kind, T.StringType):
        raise ValueError(f"{aggregate.func.name} of string column {aggregate.column}")
    if aggregate.func is AggFunc.SUM:
        found = exact_sum(column, kind)
    elif aggregate.func is AggFunc.AVG:
        found = F.avg(column.cast("double")) if not isinstance(kind, T.LongType) else exact_sum(column, kind) / F.nullif(F.count(column), F.lit(0)).cast("double")
    else:
        found = (F.min if aggregate.func is AggFunc.MIN else F.max)(column).cast("double")
    return F.coalesce(found, F.lit(0.0))


def wide(df: DataFrame, aggregates: Iterable[Aggregate]) -> DataFrame:
    """One row, one column per aggregate."""
    return df.agg(*[expression(df.schema, a).alias(a.name) for a in aggregates])


def long(df: DataFrame, aggregates: Iterable[Aggregate]) -> DataFrame:
    """One row per aggregate: col_name, func, value, count (rows selected)."""
    aggregates = list(aggregates)
    one = df.agg(*[expression(df.schema, a).alias(f"v{i}") for i, a in enumerate(aggregates)], F.count(F.lit(1)).alias("n"))
    records = [F.struct(F.lit(a.name).alias("col_name"), F.lit(a.func.name).alias("func"), F.col(f"v{i}").alias("value"), F.col("n").alias("count")) for i, a in enumerate(aggregates)]
    return one.select(F.explode(F.array(*records)).alias("r")).select("r.*")
