"""A columnar scan-and-aggregate engine on Spark: query plans, a table catalog, zone maps and codecs."""

from lamella.operators.executor import Engine, QueryResult
from lamella.plans.query import AggFunc, Aggregate, CompareOp, Predicate, QueryPlan
from lamella.sources.catalog import Catalog

__all__ = ["AggFunc", "Aggregate", "Catalog", "CompareOp", "Engine", "Predicate", "QueryPlan", "QueryResult"]
