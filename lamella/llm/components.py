"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut, drop_cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (node, smallest node of its component) for each component of the edges a-b."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            v, m = forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            yield pd.DataFrame({"a": v, "b": m})


def _lowest(pairs: DataFrame) -> DataFrame:
    """(a, m): the smallest b of each a, with a behind an expression.

    Spark then deals this small side anew for a join on a, and so both sides of the join come from
    exchanges of their own: it can split a node with very many neighbours over tasks.
    """
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("a"), "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a long, b long); component is its smallest node.

    Each batch of edges is first contracted to stars where it lies. Then each round links every
    node's neighbours to its smallest one, larger neighbours first, then smaller ones, until the
    edges stay as they are; every round is cut. A node's smallest neighbour is found by partial
    aggregation and joined back, so a node with very many neighbours is no single task's work.
    Nulls and self links are ignored. Nodes without a link to another node are not in the result.
    """
    edges = edges.select("a", "b").where("a <> b").mapInPandas(_contract, "a long, b long")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.join(_lowest(large), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        before, edges = edges, cut(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        drop_cut(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
