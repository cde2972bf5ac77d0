"""Registered queries of the engine over the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.bits import compression_ratio
from lamella.functions.types import column_type, element_size, type_name
from lamella.operators import aggregates, codecs, predicates, zonemaps
from lamella.operators.executor import Engine, compile_plan, consume, run_benchmark
from lamella.plans.query import AggFunc, Aggregate, CompareOp, Predicate, QueryPlan
from lamella.sources.catalog import Catalog
from lamella.sources.csv import ingest_csv
from lamella.sources.sample import sample_orders
from lamella.streaming.reader import ColumnReader

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[name], _SQL[name] = query, sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planned(name: str, plan: QueryPlan, sql: str, ordinal: str | None = None, as_double: bool = False, long: bool = False, digits: int | None = None) -> None:
    """Register a plan over one table; digits rounds every result column."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = compile_plan(table(spark, sf_dir, plan.table), plan, ordinal, as_double, long)
        return found if digits is None else found.select(*[F.round(c, digits).alias(c) for c in found.columns])

    register(name, sql)(query)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the session's checkpoint folder or, without one, its warehouse, if executors share that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
        if base.startswith("file:") and not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/lamella-{uuid.uuid4().hex}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = QueryPlan("lineitem", where=[Predicate("l_linenumber", CompareOp.EQ, 1)], aggregates=[Aggregate(AggFunc.SUM, "l_extendedprice", "total")])
    return compile_plan(table(spark, sf_dir, "lineitem"), plan)


# scans, projections, filters

planned("scan_all", QueryPlan("lineitem"), "SELECT * FROM lineitem")
planned(
    "project",
    QueryPlan("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]),
    "SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_quantity FROM lineitem",
    as_double=True,
)

for _kind, _table, _column, _value in (("i32", "lineitem", "l_linenumber", 3), ("i64", "orders", "o_custkey", 700), ("f64", "lineitem", "l_discount", 0.05)):
    for _op in CompareOp:
        planned(
            f"flt_{_kind}_{_op.name}",
            QueryPlan(_table, where=[Predicate(_column, _op, _value)], aggregates=[Aggregate(AggFunc.COUNT, alias="n")]),
            f"SELECT count(*)::DOUBLE AS n FROM {_table} WHERE {_column} {_op.value} {_value}",
        )


def _f32(op: CompareOp) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("float").alias("d"))
        return aggregates.wide(predicates.apply(df, [Predicate("d", op, 0.05)]), [Aggregate(AggFunc.COUNT, alias="n")])

    return query


for _op in CompareOp:
    register(f"flt_f32_{_op.name}", f"SELECT count(*)::DOUBLE AS n FROM lineitem WHERE l_discount::FLOAT {_op.value} 0.05::FLOAT")(_f32(_op))

planned(
    "flt_string",
    QueryPlan("lineitem", where=[Predicate("l_returnflag", CompareOp.EQ, "R")], aggregates=[Aggregate(AggFunc.COUNT, alias="n")]),
    "SELECT count(*)::DOUBLE AS n FROM lineitem WHERE l_returnflag = 'R'",
)
planned(
    "filter_and",
    QueryPlan(
        "lineitem",
        where=[Predicate("l_quantity", CompareOp.GT, 24.5, 0.5), Predicate("l_linenumber", CompareOp.EQ, 1, 0.1), Predicate("l_discount", CompareOp.LTE, 0.05, 0.6)],
    ),
    "SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 24.5 AND l_discount <= 0.05",
)
planned("filter_neq_double", QueryPlan("lineitem", ["l_orderkey", "l_discount"], [Predicate("l_discount", CompareOp.NEQ, 0.05)]), "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount <> 0.05")


@register("chain_filter", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 2 AND l_quantity < 10")
def chain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predicates.apply(table(spark, sf_dir, "lineitem"), [Predicate("l_linenumber", CompareOp.EQ, 2)])
    return predicates.apply(df, [Predicate("l_quantity", CompareOp.LT, 10.0)]).select("l_orderkey", "l_quantity")


@register("positions", "SELECT event_id AS position FROM events WHERE value > 50")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.positions(table(spark, sf_dir, "events"), Predicate("value", CompareOp.GT, 50.0), "event_id")


@register("select_none", "SELECT p_partkey FROM part WHERE false")
def select_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.select_none(table(spark, sf_dir, "part")).select("p_partkey")


# limits

planned("limit", QueryPlan("part", ["p_partkey", "p_name", "p_size"], limit=10), "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_partkey LIMIT 10", ordinal="p_partkey")
planned(
    "limit_where",
    QueryPlan("events", ["event_id", "value"], [Predicate("value", CompareOp.GTE, 50.0)], limit=20),
    "SELECT event_id, value FROM events WHERE value >= 50 ORDER BY event_id LIMIT 20",
    ordinal="event_id",
)
planned("limit_zero", QueryPlan("events", ["event_id"], limit=0), "SELECT event_id FROM events LIMIT 0", ordinal="event_id")

# aggregates

_ONE = [Predicate("l_linenumber", CompareOp.EQ, 1)]
planned("agg_sum_f64", QueryPlan("lineitem", where=_ONE, aggregates=[Aggregate(AggFunc.SUM, "l_extendedprice", "total")]), "SELECT round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM lineitem WHERE l_linenumber = 1", digits=2)
planned("agg_sum_i32", QueryPlan("lineitem", aggregates=[Aggregate(AggFunc.SUM, "l_linenumber")]), "SELECT sum(l_linenumber)::DOUBLE AS l_linenumber FROM lineitem")
planned("agg_sum_i64", QueryPlan("orders", aggregates=[Aggregate(AggFunc.SUM, "o_custkey")]), "SELECT sum(o_custkey)::DOUBLE AS o_custkey FROM orders")
planned("agg_count", QueryPlan("lineitem", where=[Predicate("l_quantity", CompareOp.LT, 10.0)], aggregates=[Aggregate(AggFunc.COUNT)]), "SELECT count(*)::DOUBLE AS count FROM lineitem WHERE l_quantity < 10")
planned("count_col", QueryPlan("lineitem", aggregates=[Aggregate(AggFunc.COUNT, "l_quantity", "n")]), "SELECT count(l_quantity)::DOUBLE AS n FROM lineitem")
planned(
    "agg_minmax",
    QueryPlan("orders", aggregates=[Aggregate(AggFunc.MIN, "o_totalprice", "low"), Aggregate(AggFunc.MAX, "o_totalprice", "high"), Aggregate(AggFunc.MIN, "o_custkey", "first_key")]),
    "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_custkey)::DOUBLE AS first_key FROM orders",
)
planned("agg_avg", QueryPlan("part", aggregates=[Aggregate(AggFunc.AVG, "p_size", "mean")]), "SELECT round(avg(p_size), 6) AS mean FROM part", digits=6)
planned("agg_avg_i64", QueryPlan("orders", aggregates=[Aggregate(AggFunc.AVG, "o_custkey", "mean")]), "SELECT round(avg(o_custkey), 6) AS mean FROM orders", digits=6)
planned(
    "agg_empty",
    QueryPlan(
        "lineitem",
        where=[Predicate("l_quantity", CompareOp.GT, 1000.0)],
        aggregates=[Aggregate(f, "" if f is AggFunc.COUNT else "l_quantity", f.value) for f in AggFunc],
    ),
    'SELECT count(*)::DOUBLE AS count, coalesce(sum(l_quantity), 0.0::DOUBLE) AS sum, coalesce(min(l_quantity), 0.0::DOUBLE) AS min, coalesce(max(l_quantity), 0.0::DOUBLE) AS max, coalesce(avg(l_quantity), 0.0::DOUBLE) AS avg FROM lineitem WHERE l_quantity > 1000',
)
planned(
    "agg_long",
    QueryPlan("orders", aggregates=[Aggregate(AggFunc.COUNT, alias="n_rows"), Aggregate(AggFunc.MIN, "o_totalprice", "low"), Aggregate(AggFunc.MAX, "o_totalprice", "high"), Aggregate(AggFunc.SUM, "o_custkey", "keys")]),
    """
    WITH o AS (SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, sum(o_custkey)::DOUBLE AS keys FROM orders)
    SELECT 'n_rows' AS col_name, 'COUNT' AS func, n::DOUBLE AS value, n AS count FROM o UNION ALL SELECT 'low', 'MIN', low, n FROM o
    UNION ALL SELECT 'high', 'MAX', high, n FROM o UNION ALL SELECT 'keys', 'SUM', keys, n FROM o
    """,
    long=True,
)
planned(
    "event_filter",
    QueryPlan("events", where=[Predicate("value", CompareOp.GTE, 50.0)], aggregates=[Aggregate(AggFunc.COUNT, alias="n"), Aggregate(AggFunc.MAX, "value", "high")]),
    "SELECT count(*)::DOUBLE AS n, max(value) AS high FROM events WHERE value >= 50",
)
planned(
    "agg_ignores_limit",
    QueryPlan("part", ["p_name"], aggregates=[Aggregate(AggFunc.COUNT, alias="n")], limit=3),
    "SELECT count(*)::DOUBLE AS n FROM part",
)


@register("agg_f32", "SELECT round(sum(d::DOUBLE), 4) AS total, round(min(d)::DOUBLE, 6) AS low, round(max(d)::DOUBLE, 6) AS high FROM (SELECT l_discount::FLOAT AS d FROM lineitem)")
def agg_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("float").alias("d"))
    found = aggregates.wide(df, [Aggregate(AggFunc.SUM, "d", "total"), Aggregate(AggFunc.MIN, "d", "low"), Aggregate(AggFunc.MAX, "d", "high")])
    return found.select(F.round("total", 4).alias("total"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.nullif("l_linenumber", F.lit(1)).alias("x"))


_NULLS = "(SELECT nullif(l_linenumber, 1) AS x FROM lineitem)"
for _op in (CompareOp.EQ, CompareOp.NEQ, CompareOp.LT, CompareOp.GTE):
    register(f"null_filter_{_op.name}", f"SELECT count(*)::DOUBLE AS n FROM {_NULLS} WHERE x {_op.value} 3")(
        lambda spark, sf_dir, op=_op: aggregates.wide(predicates.apply(_nulls(spark, sf_dir), [Predicate("x", op, 3)]), [Aggregate(AggFunc.COUNT, alias="n")])
    )


@register("null_agg", f"SELECT count(x)::DOUBLE AS n, sum(x)::DOUBLE AS total, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high, count(*)::DOUBLE AS rows FROM {_NULLS}")
def null_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Aggregate(AggFunc.COUNT, "x", "n"), Aggregate(AggFunc.SUM, "x", "total"), Aggregate(AggFunc.MIN, "x", "low"), Aggregate(AggFunc.MAX, "x", "high"), Aggregate(AggFunc.COUNT, alias="rows")]
    return aggregates.wide(_nulls(spark, sf_dir), wanted)


# zone maps


@register("chunk_stats", "SELECT l_orderkey // 4096 AS chunk, count(*) AS n_rows, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.chunk_stats(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity"], 4096)


def _skips(stats: DataFrame, column: str, value: int, kind: T.DataType) -> DataFrame:
    low, high, at = F.col(f"min_{column}"), F.col(f"max_{column}"), predicates.typed_literal(value, kind)
    flags = [zonemaps.can_skip(op, low, high, at).alias(f"skip_{op.name.lower()}") for op in CompareOp]
    return stats.select("chunk", *flags, zonemaps.might_match_range(low, high, at, at + 10).alias("might_match"))


def _skips_sql(tab: str, ordinal: str, rows: int, column: str, value: int) -> str:
    return f"""
    SELECT chunk, low > {value} OR high < {value} AS skip_eq, low = {value} AND high = {value} AS skip_neq, low >= {value} AS skip_lt, low > {value} AS skip_lte,
           high <= {value} AS skip_gt, high < {value} AS skip_gte, NOT (high < {value} OR low > {value} + 10) AS might_match
    FROM (SELECT {ordinal} // {rows} AS chunk, min({column}) AS low, max({column}) AS high FROM {tab} GROUP BY 1)
    """


@register("prune_table", _skips_sql("part", "p_partkey", 256, "p_size", 50))
def prune_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skips(zonemaps.chunk_stats(table(spark, sf_dir, "part"), "p_partkey", ["p_size"], 256), "p_size", 50, T.IntegerType())


@register("prune_monotone", _skips_sql("events", "event_id", 1024, "event_id", 5000))
def prune_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skips(zonemaps.chunk_stats(table(spark, sf_dir, "events"), "event_id", ["event_id"], 1024), "event_id", 5000, T.LongType())


@register("pruned_scan", "SELECT event_id, user_id, value FROM events WHERE event_id >= 7000 AND value < 20.5")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Predicate("event_id", CompareOp.GTE, 7000), Predicate("value", CompareOp.LT, 20.5)]
    return zonemaps.pruned_scan(table(spark, sf_dir, "events"), "event_id", wanted, 1024).select("event_id", "user_id", "value")


# codecs

_RUNS = """
WITH b AS (SELECT p_partkey AS pos, p_partkey // 512 AS chunk, p_size // 10 AS v FROM part),
s AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts FROM b WINDOW w AS (PARTITION BY chunk ORDER BY pos)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY chunk ORDER BY pos)::BIGINT AS run FROM s),
g AS (SELECT chunk, run, min(v)::INT AS value, count(*) AS length FROM r GROUP BY ALL)
"""
_VARINT = "greatest(1, ceil(length(bin({z})) / 7.0))::BIGINT"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_size") / 10).cast("int").alias("v"))
    return codecs.rle_encode(df, "v", "p_partkey", 512)


@register("rle_runs", _RUNS + "SELECT * FROM g")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@register("rle_size", _RUNS + f"SELECT chunk, sum(length)::BIGINT AS n_rows, count(*) AS n_runs, sum(4 + {_VARINT.format(z='length')})::BIGINT AS size FROM g GROUP BY chunk")
def rle_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.rle_size(_runs(spark, sf_dir), 4)


@register("rle_roundtrip", _RUNS + "SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY pos) - 1 AS pos, v::INT AS value FROM b")
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.rle_decode(_runs(spark, sf_dir))


_DELTAS = """
WITH d AS (SELECT o_orderkey // 4096 AS chunk, o_orderkey AS pos, o_custkey - lag(o_custkey, 1, 0) OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS d FROM orders),
z AS (SELECT chunk, pos, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS zigzag, false AS missing FROM d)
"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.delta_encode(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 4096)


@register("delta_zigzag", _DELTAS + "SELECT * FROM z")
def delta_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


@register("delta_size", _DELTAS + f"SELECT chunk, count(*) AS n_rows, sum({_VARINT.format(z='zigzag')})::BIGINT AS size, round(count(*) * 8.0 / sum({_VARINT.format(z='zigzag')}), 6)::DOUBLE AS ratio FROM z GROUP BY chunk")
def delta_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codecs.delta_size(_deltas(spark, sf_dir))
    return found.withColumn("ratio", F.round(compression_ratio(F.col("n_rows") * 8, F.col("size")), 6))


@register("delta_roundtrip", "SELECT o_orderkey // 4096 AS chunk, o_orderkey AS pos, o_custkey AS value FROM orders")
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.delta_decode(_deltas(spark, sf_dir))


def _delta_kinds(df: DataFrame, ordinal: str) -> DataFrame:
    """Each column of df but the ordinal coded and decoded, side by side."""
    found = None
    for f in df.schema:
        if f.name != ordinal:
            own = codecs.delta_decode(codecs.delta_encode(df, f.name, ordinal, 512), f.dataType).select("chunk", "pos", F.col("value").alias(f.name))
            found = own if found is None else found.join(own, ["chunk", "pos"])
    return found


@register(
    "delta_types",
    """
    SELECT p_partkey // 512 AS chunk, p_partkey AS pos, p_size AS i32, p_retailprice::FLOAT AS f32, p_retailprice * -1e300 AS f64, nullif(p_size, 7) AS with_nulls,
           CASE WHEN p_partkey % 2 = 0 THEN 9223372036854775807 - p_partkey ELSE p_partkey - 9223372036854775807 END AS far_apart, nullif(p_retailprice, p_retailprice) AS no_values
    FROM part
    """,
)
def delta_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.lit(2**63 - 1)
    df = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").alias("i32"),
        F.col("p_retailprice").cast("float").alias("f32"),
        (F.col("p_retailprice") * F.lit(-1e300)).alias("f64"),
        F.nullif("p_size", F.lit(7)).alias("with_nulls"),
        F.when(F.col("p_partkey") % 2 == 0, far - F.col("p_partkey")).otherwise(F.col("p_partkey") - far).alias("far_apart"),
        F.nullif("p_retailprice", "p_retailprice").alias("no_values"),
    )
    return _delta_kinds(df, "p_partkey")


@register("delta_wraps", "SELECT v.* FROM (VALUES (0::BIGINT, 0::BIGINT, 4294967294::BIGINT, false), (0, 1, 1, false), (0, 2, 2, false), (0, 3, 0, true)) v(chunk, pos, zigzag, missing)")
def delta_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the largest int to the smallest is one step."""
    df = spark.createDataFrame([(0, 2**31 - 1), (1, 2**31 - 2), (2, 2**31 - 1), (3, None)], "pos long, value int")
    return codecs.delta_encode(df, "value", "pos")


# storage


def _stored(codec: str, delta_columns: list[str] | None = None, sort_by: list[str] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
        catalog = Catalog(spark, shared_folder(spark))
        catalog.create_table("orders", df.schema)
        catalog.write("orders", df, codec, delta_columns, sort_by)
        return catalog.read("orders")

    return query


for _codec in ("none", "snappy", "zstd", "lz4", "rle"):
    register(f"codec_{_codec}", "SELECT o_orderkey, o_totalprice FROM orders")(_stored(_codec))
register("delta_parquet", "SELECT o_orderkey, o_totalprice FROM orders")(_stored("delta", ["o_orderkey"], ["o_orderkey"]))


@register("read_column", "SELECT o_totalprice FROM orders")
def read_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    catalog = Catalog(spark, shared_folder(spark))
    catalog.create_table("orders", df.schema)
    catalog.write("orders", df)
    return catalog.read_column("orders", "o_totalprice")


@register("append_rows", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    catalog = Catalog(spark, shared_folder(spark))
    catalog.create_table("supplier", df.schema)
    catalog.write("supplier", df)
    catalog.append("supplier", df, "zstd")
    return catalog.read("supplier")


@register("csv_ingest", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    folder = shared_folder(spark)
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/csv")
    catalog = Catalog(spark, f"{folder}/db")
    catalog.create_table("part", df.schema)
    ingest_csv(catalog, "part", f"{folder}/csv")
    return catalog.read("part")


# storage of every type, and the engine's other parts

_ALL = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"


def _parts(spark: SparkSession, sf_dir: str, codec: str = "snappy", sort_by: list[str] | None = None, parts: int = 4) -> Catalog:
    """A catalog with `part` in several files, in order of its key or of sort_by."""
    df = table(spark, sf_dir, "part")
    catalog = Catalog(spark, shared_folder(spark))
    catalog.create_table("part", df.schema)
    catalog.write("part", df.repartitionByRange(parts, "p_partkey").sortWithinPartitions("p_partkey") if sort_by is None else df, codec, sort_by=sort_by)
    return catalog


for _codec in ("none", "snappy", "zstd", "lz4", "rle"):
    register(f"stored_types_{_codec}", f"SELECT {_ALL}, nullif(p_size, 7) AS with_nulls, p_retailprice::FLOAT AS f32, p_size % 3 = 0 AS flag FROM part")(
        lambda spark, sf_dir, codec=_codec: _typed(spark, sf_dir, codec)
    )


def _typed(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("*", F.nullif("p_size", F.lit(7)).alias("with_nulls"), F.col("p_retailprice").cast("float").alias("f32"), (F.col("p_size") % 3 == 0).alias("flag"))
    catalog = Catalog(spark, shared_folder(spark))
    catalog.create_table("part", df.schema)
    catalog.write("part", df, codec)
    return catalog.read("part")


# the engine on a catalog's tables


@register("engine_scan", "SELECT p_name, p_size FROM part WHERE p_size >= 40 AND p_retailprice < 1500")
def engine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(_parts(spark, sf_dir, "zstd"))
    return engine.scan("part", ["p_name", "p_size"], [Predicate("p_size", CompareOp.GTE, 40), Predicate("p_retailprice", CompareOp.LT, 1500.0)])


@register("engine_aggregate", "SELECT count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS total, min(p_partkey)::DOUBLE AS low, max(p_retailprice) AS high, round(avg(p_size), 6) AS mean FROM part WHERE p_size < 20")
def engine_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Aggregate(AggFunc.COUNT, alias="n"), Aggregate(AggFunc.SUM, "p_size", "total"), Aggregate(AggFunc.MIN, "p_partkey", "low"), Aggregate(AggFunc.MAX, "p_retailprice", "high"), Aggregate(AggFunc.AVG, "p_size", "mean")]
    return Engine(_parts(spark, sf_dir)).execute(QueryPlan("part", where=[Predicate("p_size", CompareOp.LT, 20)], aggregates=wanted)).withColumn("mean", F.round("mean", 6))


@register("engine_limit", "SELECT p_partkey, p_size FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 30")
def engine_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in stored order; files beyond those that hold them aren't read."""
    return Engine(_parts(spark, sf_dir, parts=8)).execute(QueryPlan("part", ["p_partkey", "p_size"], [Predicate("p_size", CompareOp.GT, 25)], limit=30))


@register("engine_limit_beyond", "SELECT p_partkey FROM part WHERE p_size = 1 ORDER BY p_partkey LIMIT 100000")
def engine_limit_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(_parts(spark, sf_dir, parts=8)).execute(QueryPlan("part", ["p_partkey"], [Predicate("p_size", CompareOp.EQ, 1)], limit=100_000))


@register("engine_figures", "SELECT (SELECT count(*) FROM part) AS rows_scanned, count(*) AS found, sum(p_partkey)::BIGINT AS keys, true AS read_some, true AS timed FROM part WHERE p_partkey < 100")
def engine_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Engine(_parts(spark, sf_dir)).run(QueryPlan("part", ["p_partkey"], [Predicate("p_partkey", CompareOp.LT, 100)]))
    row = (got.rows_scanned, len(got.rows), sum(r[0] for r in got.rows), 0 < len(got.rows) <= got.rows_read <= got.rows_scanned, got.elapsed_ms > 0)
    return spark.createDataFrame([row], "rows_scanned long, found long, keys long, read_some boolean, timed boolean")


@register("plan_nodes", "SELECT v.* FROM (VALUES ('Scan', true), ('PushedFilters', true), ('Filter', true), ('HashAggregate', true), ('Exchange', true), ('Join', false)) v(node, present)")
def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pipeline of a filtered sum is made of."""
    said = Engine(_parts(spark, sf_dir)).explain(QueryPlan("part", where=[Predicate("p_size", CompareOp.EQ, 3)], aggregates=[Aggregate(AggFunc.SUM, "p_size")]))
    return spark.createDataFrame([(n, n in said) for n in ("Scan", "PushedFilters", "Filter", "HashAggregate", "Exchange", "Join")], "node string, present boolean")


@register("required_columns", "SELECT v.* FROM (VALUES ('project', 'p_name p_size p_brand'), ('aggregate', 'p_size p_brand'), ('star', '')) v(plan, required)")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = [Predicate("p_brand", CompareOp.EQ, "x"), Predicate("p_size", CompareOp.GT, 3)]
    plans = {"project": QueryPlan("part", ["p_name", "p_size"], where), "aggregate": QueryPlan("part", ["p_name"], [*where[:1]], [Aggregate(AggFunc.SUM, "p_size"), Aggregate(AggFunc.COUNT)]), "star": QueryPlan("part", where=where)}
    return spark.createDataFrame([(name, " ".join(plan.required)) for name, plan in plans.items()], "plan string, required string")


@register(
    "read_chunks",
    "SELECT chunk, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 700 AS chunk FROM part) GROUP BY chunk",
)
def read_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks pulled until the reader is exhausted, one row for each."""
    reader = ColumnReader(_parts(spark, sf_dir, parts=3), "part", "p_partkey", 700)
    rows = [(i, len(c), c[0], c[-1]) for i, c in enumerate(reader)]
    if not reader.exhausted or reader.next_chunk() is not None:
        raise RuntimeError("the reader isn't at its end")
    return spark.createDataFrame(rows, "chunk long, n long, first_key long, last_key long")


@register(
    "schema_lookups",
    "SELECT v.* FROM (VALUES ('p_partkey', 0, 'INT64', 8), ('p_name', 1, 'STRING', 4), ('p_size', 4, 'INT32', 4), ('p_retailprice', 5, 'FLOAT64', 8), ('missing', -1, NULL, NULL)) v(name, place, type, bytes)",
)
def schema_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _parts(spark, sf_dir)
    schema = catalog.load_schema("part")
    rows = []
    for name in ("p_partkey", "p_name", "p_size", "p_retailprice", "missing"):
        at = catalog.column_index("part", name)
        kind = type_name(column_type(schema, name)) if at >= 0 else None
        rows.append((name, at, kind, element_size(kind) if kind else None))
    return spark.createDataFrame(rows, "name string, place int, type string, bytes int")


@register(
    "sample_rows",
    "SELECT 5000 AS n, 5000 AS ids, true AS customers, true AS amounts, 4 AS statuses, 1700000000 AS first_ts, 1700000000 + 60 * 4999 AS last_ts, true AS repeatable",
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sample_orders(spark, 5000)
    found = df.agg(
        F.count("*").cast("int").alias("n"),
        F.count_distinct("order_id").cast("int").alias("ids"),
        ((F.min("customer_id") >= 1) & (F.max("customer_id") <= 10_000)).alias("customers"),
        ((F.min("amount") >= 1) & (F.max("amount") <= 5000) & (F.max(F.abs(F.col("amount") - F.round("amount", 2))) == 0)).alias("amounts"),
        F.count_distinct("status").cast("int").alias("statuses"),
        F.min("ts").cast("int").alias("first_ts"),
        F.max("ts").cast("int").alias("last_ts"),
    )
    return found.withColumn("repeatable", F.lit(df.exceptAll(sample_orders(spark, 5000)).count() == 0))


@register("harness", "SELECT 'sum' AS name, (SELECT count(*) FROM part) AS rows, true AS timed, true AS rated, true AS printed")
def harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    got = run_benchmark("sum", lambda: consume(df.agg(F.sum("p_size"))), df.count())
    return spark.createDataFrame([(got.name, got.rows, got.elapsed_ms > 0, got.rows_per_second > 0, str(got).startswith("sum: "))], "name string, rows long, timed boolean, rated boolean, printed boolean")


@register("built_columns", "SELECT v.* FROM (VALUES (0::BIGINT, 0, NULL, 'a'), (1, NULL, 1.5::FLOAT, NULL), (2, 20, NULL, ''), (3, NULL, -2.0, 'd')) v(pos, i, f, s)")
def built_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns built row by row with nulls, stored and read again."""
    rows = spark.createDataFrame([(0, 0, None, "a"), (1, None, 1.5, None), (2, 20, None, ""), (3, None, -2.0, "d")], "pos long, i int, f float, s string")
    catalog = Catalog(spark, shared_folder(spark))
    catalog.create_table("built", rows.schema)
    catalog.write("built", rows)
    return catalog.read("built")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
