"""Zone maps: minimum and maximum of each chunk, and what they rule out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators.predicates import conjunction, typed_literal
from lamella.plans.query import CompareOp, Predicate

CHUNK_ROWS = 65_536


def chunk_of(ordinal: Column, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(ordinal / F.lit(rows)).cast("long")


def chunk_stats(df: DataFrame, ordinal: str, columns: Iterable[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Per chunk: number of rows, and min_<c> and max_<c> of each column over its non-null values (null if none)."""
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(chunk_of(F.col(ordinal), rows).alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"), *bounds)


def can_skip(op: CompareOp, low: Column, high: Column, value: Column) -> Column:
    """Whether no value from low to high satisfies `op value`; false without bounds.

    Compared in the column's own type, never truncated, so a chunk with a match is never skipped.
    """
    found = {
        CompareOp.GT: high <= value,
        CompareOp.GTE: high < value,
        CompareOp.LT: low >= value,
        CompareOp.LTE: low > value,
        CompareOp.EQ: (low > value) | (high < value),
        CompareOp.NEQ: (low == value) & (high == value),
    }[op]
    return F.coalesce(found, F.lit(False))


def might_match_range(low: Column, high: Column, first: Column, last: Column) -> Column:
    """Whether low..high meets first..last; true without bounds."""
    return F.coalesce(~((high < first) | (low > last)), F.lit(True))


def skippable(stats: DataFrame, df: DataFrame, predicates: Iterable[Predicate]) -> Column:
    """For rows of chunk_stats: whether some conjunct rules the chunk out."""
    found = F.lit(False)
    for p in predicates:
        value = typed_literal(p.value, df.schema[p.column].dataType)
        found = found | can_skip(p.op, F.col(f"min_{p.column}"), F.col(f"max_{p.column}"), value)
    return found


#: Ranges of chunks that a scan takes as a filter; with more, chunks are joined.
FILTER_RANGES = 500


def pruned_scan(df: DataFrame, ordinal: str, predicates: list[Predicate], rows: int = CHUNK_ROWS, stats: DataFrame | None = None) -> DataFrame:
    """The filtered rows of the chunks that can't be skipped: equal to a plain filter.

    stats are the rows of chunk_stats, stored by whoever scans often, taken from df if not given.
    Neighbouring chunks that stay are ranges of row numbers, a filter that reaches the scan and skips
    row groups; only a table whose chunks stay in very many ranges is joined with them.
    """
    if not predicates:
        return df
    if stats is None:
        stats = chunk_stats(df, ordinal, {p.column for p in predicates}, rows)
    kept = stats.where(~skippable(stats, df, predicates)).select("chunk")
    found = df.where(conjunction(df.schema, predicates))
    edges = kept.select(F.explode(F.array(F.struct("chunk", F.lit(1).alias("n")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(-1).alias("n")))).alias("e"))
    # a chunk's start and its neighbour's end cancel, so what remains are the ranges' ends
    ends = edges.groupBy("e.chunk").agg(F.sum("e.n").alias("n")).where("n <> 0").orderBy("chunk").limit(2 * FILTER_RANGES + 1).collect()
    if len(ends) > 2 * FILTER_RANGES:
        return found.withColumn("chunk", chunk_of(F.col(ordinal), rows)).join(kept, "chunk", "left_semi").drop("chunk")
    at, inside = F.col(ordinal), F.lit(False)
    for low, high in zip(ends[::2], ends[1::2], strict=True):
        inside = inside | ((at >= low["chunk"] * rows) & (at < high["chunk"] * rows))
    return found.where(inside)
