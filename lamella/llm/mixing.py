"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import WORD_PATTERN, cut, row_columns

#: Rows of a range of a source that are aimed at, and hex digits of the seeded hash that deal rows to ranges at least.
RANGE_ROWS = 1_000_000
RANGE_DIGITS = 3


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Each source's target from (source, source_size).

    The fill level L solves sum(min(max_epochs * size, L * weight)) = share * total. In the order of
    cap over weight the capped sources come first, so L is what remains after their caps, divided by
    the weights of the others, at the first source whose cap isn't below it. The table has one row
    for each source, summed before; its windows are over these rows alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "position")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("position") % len(weights) + 1)
    ranked = (
        sources.withColumn("position", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    )
    levels = ranked.withColumn(
        "level",
        (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    ).withColumn("open", F.col("level") <= F.col("fill"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("fill", "position"))).over(Window.partitionBy())
    return levels.withColumn("at", level).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target")
    )


def draw_of(seed: Column, doc_id: Column, text: Column) -> Column:
    """A row's seeded place in its source: a hash of its id and text."""
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, draw): words of each row and its seeded place in its source."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size_of(F.col(text_col)).alias("size"),
        draw_of(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
    )


def dealt(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int) -> DataFrame:
    """Per row: doc_id, source, size, draw, source_size, target, whole (repetitions of all rows), extra (0 or 1)."""
    rows = cut(sizes(docs, seed))
    digits = RANGE_DIGITS  # the result is the same for any number of ranges
    while rows.count() > RANGE_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("range", F.substring("draw", 1, digits))
    ranges = cut(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    start = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    plan = (
        ranges.withColumn("start", start)
        .alias("r")
        .join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .select("r.source", "r.range", "start", "source_size", "target", "whole", "rest")
    )
    upto = F.col("start") + F.sum("size").over(Window.partitionBy("d.source", "d.range").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.when((F.col("rest") > 0) & (2 * F.col("upto") - F.col("size") <= 2 * F.col("rest")), 1).otherwise(0)
    return (
        rows.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
        .withColumn("upto", upto)
        .select("doc_id", F.col("d.source").alias("source"), "size", "draw", "source_size", "target", "whole", extra.cast("long").alias("extra"))
    )


DEFAULTS = {"weights": (3.0, 1.0, 2.0), "share": 1.5, "max_epochs": 2.0, "seed": 17}


def mix(docs: DataFrame, **parameters: object) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken.

    Parameters, as in DEFAULTS: the weights, in the order of the sources' names, repeating; the mix's
    share of all words; the most often that a source is repeated; the seed. copies is the number of
    repetitions that the mix takes: the whole part of target / source_size for every row, and one more
    for the rows that come first in the source's seeded order, up to the row whose middle word is
    beyond the remaining target. So a source's taken words miss its target by half a row's size at
    most. Reruns draw the same rows.

    Null text has size 0, a null source is a source of its own (last in order), a null doc_id counts
    as the word "null"; a row's place comes from its id and text, so rows that share an id, or have
    none, are spread as well. Repeated rows count as often as they come; equal ones follow one another,
    each drawn or not by itself. An empty table gives an empty result. Other columns of docs are not read.
    """
    copies = F.col("whole") + F.col("extra")
    found = dealt(docs, **(DEFAULTS | parameters))
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def marks(docs: DataFrame, **parameters: object) -> DataFrame:
    """One row per source: what `repeat` needs to repeat that source's documents as `mix` does."""
    found = dealt(docs, **(DEFAULTS | parameters))
    last = F.max(F.when(F.col("extra") == 1, F.struct("draw", "size")))
    seed = F.lit((DEFAULTS | parameters)["seed"])
    return found.groupBy("source").agg(F.first("whole").alias("whole"), last.alias("last")).withColumn("seed", seed)


def repeat(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, with all columns, texts unmoved where marks are broadcast.

    A source's extra repetitions go to the rows up to its last one in seeded order, so a row's own
    place tells its number. (Equal rows share a place and go together.)
    """
    rows = docs.select(F.struct(row_columns(docs)).alias("row"))
    place = F.struct(draw_of(F.col("m.seed"), F.col("row.doc_id"), F.col("row.text")).alias("draw"), size_of(F.col("row.text")).alias("size"))
    copies = F.col("m.whole") + F.when(F.col("m.last").isNotNull() & (place <= F.col("m.last")), 1).otherwise(0)
    joined = rows.join(marks.alias("m"), F.col("row.source").eqNullSafe(F.col("m.source")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position, sum(source_size) OVER ()::DOUBLE AS total FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(position % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM n),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY fill, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, fill * 1e6 + position) FROM l WHERE level <= fill) * weight, cap)) AS target
  FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
u AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, round(target, 6) AS target,
       (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies,
       (size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""
