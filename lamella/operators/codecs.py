"""Codecs: Parquet writer profiles, and run-length and delta coding as DataFrame transforms.

Runs and deltas are taken within chunks of rows, so their windows are spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.bits import from_bits, halves, joined, to_bits, varint_length, wrapped_int, zigzag_decode, zigzag_encode
from lamella.functions.types import element_size
from lamella.operators.zonemaps import CHUNK_ROWS, chunk_of


@dataclass(frozen=True)
class Codec:
    """Options of a Parquet writer; columns get `per_column` options with #name appended."""

    name: str
    options: dict[str, str] = field(default_factory=dict)
    per_column: dict[str, str] = field(default_factory=dict)

    def writer_options(self, columns: list[str]) -> dict[str, str]:
        return self.options | {f"{k}#{c}": v for k, v in self.per_column.items() for c in columns}


_CODECS = {
    "none": Codec("none", {"compression": "none"}),
    "snappy": Codec("snappy", {"compression": "snappy"}),
    "zstd": Codec("zstd", {"compression": "zstd"}),
    "lz4": Codec("lz4", {"compression": "lz4_raw"}),
    "rle": Codec("rle", {"compression": "none", "parquet.enable.dictionary": "true"}),
    "delta": Codec("delta", {"compression": "none", "parquet.writer.version": "PARQUET_2_0"}, {"parquet.enable.dictionary": "false"}),
}


def make_codec(name: str) -> Codec:
    if name.lower() not in _CODECS:
        raise ValueError(f"unknown codec: {name}")
    return _CODECS[name.lower()]


def rle_encode(df: DataFrame, value: str, ordinal: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, run, value, length): runs of equal values (nulls are equal) in ordinal order."""
    by = Window.partitionBy("chunk").orderBy("pos")
    base = df.select(F.col(value).alias("value"), F.col(ordinal).alias("pos"), chunk_of(F.col(ordinal), rows).alias("chunk"))
    first = F.row_number().over(by) == 1
    starts = base.withColumn("starts", (first | ~F.col("value").eqNullSafe(F.lag("value").over(by))).cast("int"))
    marked = starts.withColumn("run", F.sum("starts").over(by))
    return marked.groupBy("chunk", "run").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("length"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(chunk, pos, value): the values again, pos counting from 0 in each chunk."""
    before = F.sum("length").over(Window.partitionBy("chunk").orderBy("run")) - F.col("length")
    spread = runs.withColumn("before", before).select("chunk", "value", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("k"))
    return spread.select("chunk", (F.col("before") + F.col("k")).alias("pos"), "value")


def rle_size(runs: DataFrame, element_size: int) -> DataFrame:
    """(chunk, n_rows, n_runs, size): bytes of value and varint length of each run."""
    return runs.groupBy("chunk").agg(
        F.sum("length").alias("n_rows"), F.count(F.lit(1)).alias("n_runs"), F.sum(F.lit(element_size) + varint_length(F.col("length"))).alias("size")
    )


def delta_encode(df: DataFrame, value: str, ordinal: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, pos, zigzag, missing): differences of successive values, the first from 0.

    value is of a type of 4 or 8 bytes; others are an error. Floats are taken by their bit patterns,
    and differences wrap around in the type's width, so every value comes back. Nulls are kept apart
    in missing, as repetitions of the value before.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, T.StringType) or element_size(kind) not in (4, 8):
        raise ValueError(f"no delta coding for {kind.simpleString()} column {value}")
    by = Window.partitionBy("chunk").orderBy("pos")
    own = F.col(f"`{value}`")
    base = df.select(to_bits(own, kind).alias("v"), own.isNull().alias("missing"), F.col(f"`{ordinal}`").alias("pos"), chunk_of(F.col(f"`{ordinal}`"), rows).alias("chunk"))
    filled = base.withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(by), F.lit(0).cast("long")))
    before = filled.withColumn("before", F.lag("v", 1, 0).over(by))
    if element_size(kind) == 4:
        delta = wrapped_int(F.col("v") - F.col("before"))
    else:
        (high, low), (high_before, low_before) = halves(F.col("v")), halves(F.col("before"))
        delta = joined(high - high_before, low - low_before)
    return before.select("chunk", "pos", zigzag_encode(delta).alias("zigzag"), "missing")


def delta_decode(deltas: DataFrame, kind: T.DataType = T.LongType()) -> DataFrame:  # noqa: B008
    """(chunk, pos, value): the values of type kind again by running sums."""
    by = Window.partitionBy("chunk").orderBy("pos")
    each = deltas.select("chunk", "pos", "missing", zigzag_decode(F.col("zigzag")).alias("d"))
    high, low = (F.sum(h).over(by) for h in halves(F.col("d")))
    each = each.withColumns({"high": high, "low": low})
    bits = joined(F.col("high"), F.col("low"))
    bits = wrapped_int(bits) if element_size(kind) == 4 else bits
    return each.select("chunk", "pos", from_bits(F.when(~F.col("missing"), bits), kind).alias("value"))


def delta_size(deltas: DataFrame) -> DataFrame:
    """(chunk, n_rows, size): varint bytes of each chunk."""
    return deltas.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(varint_length(F.col("zigzag"))).alias("size"))
