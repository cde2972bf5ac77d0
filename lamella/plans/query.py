"""The query plan: one table, projected columns or global aggregates, AND-ed comparisons, a row limit."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class CompareOp(Enum):
    EQ = "="
    NEQ = "<>"
    LT = "<"
    LTE = "<="
    GT = ">"
    GTE = ">="


class AggFunc(Enum):
    COUNT = "count"
    SUM = "sum"
    MIN = "min"
    MAX = "max"
    AVG = "avg"


@dataclass(frozen=True)
class Predicate:
    """column op value; the value is taken in the column's type. The hint only orders conjuncts."""

    column: str
    op: CompareOp
    value: object
    selectivity_hint: float = 1.0


@dataclass(frozen=True)
class Aggregate:
    """func over column; an empty column with COUNT counts rows."""

    func: AggFunc
    column: str = ""
    alias: str = ""

    def __post_init__(self) -> None:
        if not self.column and self.func is not AggFunc.COUNT:
            raise ValueError(f"{self.func.name} needs a column")

    @property
    def name(self) -> str:
        return self.alias or self.column or "count"


@dataclass(frozen=True)
class QueryPlan:
    """With aggregates, select and limit are ignored; an empty select means all columns."""

    table: str
    select: tuple[str, ...] = ()
    where: tuple[Predicate, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    limit: int | None = None

    def __post_init__(self) -> None:
        for name in ("select", "where", "aggregates"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit is negative")

    @property
    def required(self) -> tuple[str, ...]:
        """Columns the plan reads, in first-use order; empty if it reads all or none."""
        own = [a.column for a in self.aggregates if a.column] if self.aggregates else list(self.select)
        return tuple(dict.fromkeys(own + [p.column for p in self.where])) if own or self.aggregates else ()


@dataclass(frozen=True)
class AggregateValue:
    """One aggregate's outcome: its name, function, value, and how many rows were selected."""

    name: str
    func: AggFunc
    value: float
    count: int


@dataclass
class PlanResult:
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    aggregates: list[AggregateValue] = field(default_factory=list)
