"""Sample orders, seeded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_orders(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """order_id, customer_id (1 to 10000), amount (1 to 5000, two places), status (0 to 3), ts (a minute apart)."""
    return spark.range(rows).select(
        F.col("id").alias("order_id"),
        (F.floor(F.rand(seed) * 10_000) + 1).cast("int").alias("customer_id"),
        F.round(F.rand(seed + 1) * 4999 + 1, 2).alias("amount"),
        F.floor(F.rand(seed + 2) * 4).cast("int").alias("status"),
        (F.lit(1_700_000_000) + F.col("id") * 60).cast("long").alias("ts"),
    )
