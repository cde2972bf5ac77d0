"""Plans to DataFrames, and DataFrames to results with figures."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.types import column_type
from lamella.operators import aggregates, predicates
from lamella.plans.query import AggFunc, AggregateValue, PlanResult, Predicate, QueryPlan
from lamella.sources.catalog import ORDINAL, Catalog


@dataclass
class QueryResult(PlanResult):
    rows_scanned: int = 0
    rows_read: int = 0
    elapsed_ms: float = 0.0


def validate(schema: T.StructType, plan: QueryPlan) -> None:
    """Raise ValueError for columns that the table lacks, wherever the plan names them."""
    for name in (*plan.select, *(p.column for p in plan.where), *(a.column for a in plan.aggregates if a.column)):
        column_type(schema, name)


def compile_plan(df: DataFrame, plan: QueryPlan, ordinal: str | None = None, as_double: bool = False, long: bool = False) -> DataFrame:
    """The plan over df.

    Aggregates give one row (or with long, one row per aggregate) and ignore select and limit. A limit
    takes the first qualifying rows by ordinal; without an ordinal, any. as_double casts projected
    numbers.
    """
    schema = T.StructType([f for f in df.schema if f.name != ORDINAL])
    validate(schema, plan)
    rows = predicates.apply(df, plan.where)
    if plan.aggregates:
        return (aggregates.long if long else aggregates.wide)(rows, plan.aggregates)
    names = list(plan.select) or schema.fieldNames()
    if plan.limit is not None:
        rows = rows.orderBy(ordinal).limit(plan.limit) if ordinal else rows.limit(plan.limit)
    columns = [F.col(f"`{c}`") for c in names]
    if as_double:
        columns = [c.cast("double").alias(n) if isinstance(schema[n].dataType, T.NumericType) else c for n, c in zip(names, columns, strict=True)]
    return rows.select(*columns)


def rows_read(df: DataFrame) -> int:
    """Rows that the scans of df gave when it was last run: those of row groups that weren't skipped."""

    def below(plan: object) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return below(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return below(plan.plan())
        if kind.endswith("ScanExec"):
            found = plan.metrics().get("numOutputRows")
            return found.get().value() if found.isDefined() else 0
        children = plan.children()
        return sum(below(children.apply(i)) for i in range(children.size()))

    return below(df._jdf.queryExecution().executedPlan())


class Engine:
    """Runs plans over the tables of a catalog."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def scan(self, table: str, columns: Iterable[str] = (), where: Iterable[Predicate] = ()) -> DataFrame:
        """The filtered rows with the named columns, or all; filters may name other columns."""
        return self.execute(QueryPlan(table, tuple(columns), tuple(where)))

    def explain(self, plan: QueryPlan) -> str:
        """The physical plan that the plan compiles to."""
        return self.execute(plan)._jdf.queryExecution().explainString(self.catalog.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def execute(self, plan: QueryPlan, as_double: bool = False, long: bool = False) -> DataFrame:
        """The plan's rows. With a limit, files are tried in stored order until enough rows qualify, and no others are read."""
        rows = self.catalog.stored(plan.table)
        if plan.limit is not None and not plan.aggregates:
            validate(T.StructType([f for f in rows.schema if f.name != ORDINAL]), plan)
            rows = self._first_files(plan)
        return compile_plan(rows, plan, ORDINAL, as_double, long)

    def _first_files(self, plan: QueryPlan) -> DataFrame:
        files, many = self.catalog.extents(plan.table), 1
        while many < len(files):
            rows = self.catalog.stored(plan.table, files[:many])
            found = predicates.apply(rows, plan.where).limit(plan.limit).count() if plan.where else sum(e.rows for e in files[:many])
            if found >= plan.limit:
                return rows
            many *= 4
        return self.catalog.stored(plan.table)

    def run(self, plan: QueryPlan) -> QueryResult:
        """The plan's rows or aggregates as Python values, with figures.

        rows_scanned is the number of the table's rows, rows_read how many of them the scan gave after
        skipping row groups, elapsed_ms the time of the plan alone.
        """
        began = time.perf_counter()
        df = self.execute(plan, long=bool(plan.aggregates))
        if plan.aggregates:
            found = df.collect()
            values = [AggregateValue(r["col_name"], AggFunc[r["func"]], r["value"], r["count"]) for r in found]
            result = QueryResult([v.name for v in values], [], values)
        else:
            result = QueryResult(df.columns, [tuple(r) for r in df.collect()])
        result.elapsed_ms = (time.perf_counter() - began) * 1000
        result.rows_read = rows_read(df)
        result.rows_scanned = self.catalog.total_rows(plan.table)
        return result


@dataclass(frozen=True)
class BenchmarkResult:
    name: str
    rows: int
    elapsed_ms: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.elapsed_ms * 1000 if self.elapsed_ms else 0.0

    def __str__(self) -> str:
        return f"{self.name}: {self.rows} rows in {self.elapsed_ms:.2f} ms, {self.rows_per_second:.0f} rows/s"


def run_benchmark(name: str, action: Callable[[], object], rows: int) -> BenchmarkResult:
    began = time.perf_counter()
    action()
    return BenchmarkResult(name, rows, (time.perf_counter() - began) * 1000)


def consume(df: DataFrame) -> None:
    """Compute every row and column of df and keep none."""
    df.write.format("noop").mode("overwrite").save()
