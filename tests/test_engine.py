"""The reference fixtures, and the gaps around them: nulls, types, edges of chunks, empty results."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella import AggFunc, Aggregate, Catalog, CompareOp, Engine, Predicate, QueryPlan
from lamella.functions import bits, types
from lamella.operators import aggregates, codecs, predicates, zonemaps
from lamella.operators.executor import BenchmarkResult, compile_plan, consume, run_benchmark
from lamella.sources.catalog import ORDINAL
from lamella.sources.csv import ingest_csv, read_csv
from lamella.sources.sample import sample_orders
from lamella.streaming.reader import ColumnReader


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "db"))


def values(df):
    return [r[0] for r in df.collect()]


def one(df, func, column="v"):
    return aggregates.wide(df, [Aggregate(func, column)]).first()[0]


# schema and types


def test_schema_lookups():
    schema = types.make_schema(order_id="INT64", amount="FLOAT64", status="INT32")
    assert [types.column_index(schema, c) for c in ("order_id", "amount", "status", "missing")] == [0, 1, 2, -1]
    assert types.column_type(schema, "amount") == T.DoubleType()
    with pytest.raises(ValueError):
        types.column_type(schema, "missing")


def test_type_names_round_trip():
    for name, width in (("INT32", 4), ("INT64", 8), ("FLOAT32", 4), ("FLOAT64", 8), ("STRING", 4)):
        assert types.type_name(types.type_from_name(name)) == name
        assert types.element_size(name) == width
    with pytest.raises(ValueError):
        types.type_from_name("BOOL")


# filters


@pytest.mark.parametrize(
    ("data", "op", "value", "n"),
    [(range(8), CompareOp.GT, 3, 4), (range(10), CompareOp.GT, 5, 4), ([1, 2, 2, 3, 2], CompareOp.EQ, 2, 3)],
)
def test_filter_fixtures(rows, data, op, value, n):
    df = rows("v int", *[(x,) for x in data])
    assert predicates.apply(df, [Predicate("v", op, value)]).count() == n


def test_positions(rows):
    df = rows("value int, at long", *[(v, i) for i, v in enumerate([0, 1, 5, 6, 3, 10, 2])])
    assert sorted(values(predicates.positions(df, Predicate("value", CompareOp.GT, 4), "at"))) == [2, 3, 5]


def test_conjunction_follows_hints(rows):
    df = rows("status int, amount int", (1, 100), (2, 50), (1, 200), (3, 300))
    wanted = [Predicate("status", CompareOp.EQ, 1, 0.5), Predicate("amount", CompareOp.GT, 150, 0.1)]
    assert [tuple(r) for r in predicates.apply(df, wanted).collect()] == [(1, 200)]
    assert [tuple(r) for r in predicates.apply(df, wanted[::-1]).collect()] == [(1, 200)]
    assert str(predicates.conjunction(df.schema, wanted)).index("amount") < str(predicates.conjunction(df.schema, wanted)).index("status")


def test_select_all_and_none(rows):
    df = rows("v int", *[(i,) for i in range(100)])
    assert predicates.select_all(df).count() == 100
    assert predicates.select_none(df).count() == 0
    assert predicates.apply(df, []).count() == 100


@pytest.mark.parametrize("kind", ["int", "bigint", "float", "double"])
@pytest.mark.parametrize("op", list(CompareOp))
def test_operators_by_type_drop_nulls(rows, kind, op):
    data = [1, 2, 3, None, 2]
    df = rows("v double", *[(None if x is None else float(x),) for x in data]).select(F.col("v").cast(kind).alias("v"))
    table = {CompareOp.EQ: 2, CompareOp.NEQ: 2, CompareOp.LT: 1, CompareOp.LTE: 3, CompareOp.GT: 1, CompareOp.GTE: 3}
    assert predicates.apply(df, [Predicate("v", op, 2)]).count() == table[op]


def test_float_literal_takes_the_columns_type(rows):
    df = rows("f float", (0.05,), (0.06,))
    assert predicates.apply(df, [Predicate("f", CompareOp.EQ, 0.05)]).count() == 1


def test_bad_literals_are_errors(rows):
    df = rows("v int, s string", (1, "a"))
    for p in (Predicate("v", CompareOp.EQ, 1.5), Predicate("v", CompareOp.EQ, 2**40), Predicate("s", CompareOp.EQ, 3), Predicate("x", CompareOp.EQ, 1)):
        with pytest.raises(ValueError):
            predicates.apply(df, [p])
    assert predicates.apply(df, [Predicate("s", CompareOp.EQ, "a")]).count() == 1


# aggregates


def test_aggregate_fixtures(rows):
    df = rows("v int", (10,), (20,), (30,), (40,))
    assert [one(df, f) for f in (AggFunc.MIN, AggFunc.MAX, AggFunc.AVG, AggFunc.SUM, AggFunc.COUNT)] == [10.0, 40.0, 25.0, 100.0, 4.0]
    assert one(rows("v int", *[(i,) for i in range(1, 6)]), AggFunc.SUM) == 15
    assert one(rows("v int", *[(1,)] * 8), AggFunc.SUM) == 8
    assert one(df.where("v in (20, 40)"), AggFunc.SUM) == 60


@pytest.mark.parametrize("kind", ["int", "bigint", "float", "double"])
def test_aggregates_skip_nulls(rows, kind):
    df = rows("v double", (1.0,), (None,), (4.0,)).select(F.col("v").cast(kind).alias("v"))
    assert [one(df, f) for f in AggFunc] == [2.0, 5.0, 1.0, 4.0, 2.5]


@pytest.mark.parametrize("kind", ["int", "bigint", "float", "double"])
def test_empty_aggregates_are_zero(rows, kind):
    df = rows("v double").select(F.col("v").cast(kind).alias("v"))
    assert [one(df, f) for f in AggFunc] == [0.0] * 5
    assert [one(rows("v double", (None,)).select(F.col("v").cast(kind).alias("v")), f) for f in AggFunc] == [0.0] * 5


def test_long_sums_are_exact(rows):
    for data in ([2**53 + 1, 1], [2**63 - 1, 2**63 - 1, -1], [-(2**63), -(2**63)], [-5, 3, 2**44, -(2**22)]):
        assert one(rows("v long", *[(x,) for x in data]), AggFunc.SUM) == float(sum(data))


def test_names_and_long_form(rows):
    df = rows("v int", (1,), (2,))
    found = aggregates.long(df, [Aggregate(AggFunc.COUNT), Aggregate(AggFunc.SUM, "v"), Aggregate(AggFunc.MAX, "v", "top")])
    assert sorted(tuple(r) for r in found.collect()) == [("count", "COUNT", 2.0, 2), ("top", "MAX", 2.0, 2), ("v", "SUM", 3.0, 2)]
    with pytest.raises(ValueError):
        Aggregate(AggFunc.SUM)
    with pytest.raises(ValueError):
        aggregates.wide(rows("s string", ("a",)), [Aggregate(AggFunc.SUM, "s")])


def test_nan_sorts_last(rows):
    df = rows("v double", (1.0,), (math.nan,), (2.0,))
    assert math.isnan(one(df, AggFunc.MAX)) and one(df, AggFunc.MIN) == 1.0
    assert predicates.apply(df, [Predicate("v", CompareOp.GT, 1.5)]).count() == 2


# plans


@pytest.fixture
def orders(catalog, rows):
    df = rows("amount double, status int", (100.0, 1), (200.0, 0), (300.0, 1), (400.0, 1)).coalesce(1)
    catalog.create_table("orders", df.schema)
    catalog.write("orders", df)
    return Engine(catalog)


def test_filtered_sum(orders):
    plan = QueryPlan("orders", where=[Predicate("status", CompareOp.EQ, 1)], aggregates=[Aggregate(AggFunc.SUM, "amount", "total")], limit=1, select=["status"])
    assert orders.execute(plan).collect()[0]["total"] == 800.0
    result = orders.run(plan)
    assert (result.columns, result.aggregates[0].value, result.aggregates[0].count, result.rows_scanned) == (["total"], 800.0, 3, 4)
    assert result.elapsed_ms > 0


def test_projection_and_limit(orders):
    assert orders.run(QueryPlan("orders", ["amount"], limit=2)).rows == [(100.0,), (200.0,)]
    assert orders.run(QueryPlan("orders", ["amount", "amount"], limit=1)).rows == [(100.0, 100.0)]
    assert orders.run(QueryPlan("orders", ["amount"], limit=0)).rows == []
    assert orders.run(QueryPlan("orders", ["amount"], [Predicate("status", CompareOp.EQ, 1)], limit=2)).rows == [(100.0,), (300.0,)]
    assert orders.execute(QueryPlan("orders")).columns == ["amount", "status"]
    assert orders.execute(QueryPlan("orders", ["status"], limit=1), as_double=True).first()[0] == 1.0


def test_unknown_names(orders):
    for plan in (QueryPlan("orders", ["x"]), QueryPlan("orders", where=[Predicate("x", CompareOp.EQ, 1)]), QueryPlan("orders", aggregates=[Aggregate(AggFunc.SUM, "x")]), QueryPlan("nothing")):
        with pytest.raises(ValueError):
            orders.execute(plan)


def test_required_columns():
    plan = QueryPlan("t", ["a"], [Predicate("b", CompareOp.EQ, 1), Predicate("a", CompareOp.EQ, 1)])
    assert plan.required == ("a", "b")
    assert QueryPlan("t").required == ()


def test_plan_is_pushed_down(spark, catalog):
    catalog.create_table("t", sample_orders(spark, 1).schema)
    catalog.write("t", sample_orders(spark, 1000))
    plan = QueryPlan("t", where=[Predicate("status", CompareOp.EQ, 1)], aggregates=[Aggregate(AggFunc.SUM, "amount", "total")])
    text = Engine(catalog).execute(plan)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,1)" in text and "ReadSchema: struct<amount:double,status:int>" in text


# storage


def test_round_trip_keeps_order_and_nulls(catalog, rows, spark):
    df = spark.range(200_000).select(F.col("id").cast("int").alias("value")).coalesce(1)
    catalog.create_table("t", df.schema)
    catalog.write("t", df)
    assert catalog.total_rows("t") == 200_000
    assert catalog.stored("t").where(F.col("value") != F.col(ORDINAL)).count() == 0
    nulls = rows("value int", (0,), (None,), (20,), (None,)).coalesce(1)
    catalog.create_table("n", nulls.schema)
    catalog.write("n", nulls)
    assert [c for c in ColumnReader(catalog, "n", "value")] == [[0, None, 20, None]]


def test_schema_file_and_errors(catalog):
    schema = types.make_schema(order_id="INT64", amount="FLOAT64")
    catalog.create_table("orders", schema)
    assert catalog.load_schema("orders") == schema and catalog.column_index("orders", "amount") == 1
    assert catalog.total_rows("orders") == 0
    with pytest.raises(ValueError):
        catalog.read("orders", ["missing"])
    with pytest.raises(ValueError):
        catalog.load_schema("missing")


def test_write_checks_the_schema(catalog, rows):
    catalog.create_table("t", types.make_schema(v="INT32"))
    with pytest.raises(ValueError):
        catalog.write("t", rows("v long", (1,)))


def test_append_keeps_order(catalog, rows):
    catalog.create_table("t", types.make_schema(value="INT32"))
    catalog.write("t", rows("value int", (1,), (2,)).coalesce(1))
    catalog.append("t", rows("value int", (3,), (4,), (5,)).coalesce(1))
    assert catalog.total_rows("t") == 5
    assert Engine(catalog).run(QueryPlan("t", ["value"], limit=4)).rows == [(1,), (2,), (3,), (4,)]


def test_reader_pulls_chunks(catalog, spark):
    df = spark.range(30).select(F.col("id").cast("int").alias("x")).coalesce(1)
    catalog.create_table("s", df.schema)
    catalog.write("s", df)
    reader = ColumnReader(catalog, "s", "x", rows=10)
    assert [len(reader.next_chunk()) for _ in range(3)] == [10, 10, 10]
    assert reader.next_chunk() is None and reader.exhausted


@pytest.mark.parametrize("n", [65_535, 65_536, 65_537])
def test_chunk_edges(catalog, spark, n):
    df = spark.range(n).select(F.col("id").cast("int").alias("v")).coalesce(1)
    catalog.create_table("e", df.schema)
    catalog.write("e", df)
    assert [len(c) for c in ColumnReader(catalog, "e", "v")] == ([n] if n <= 65_536 else [65_536, 1])


@pytest.mark.parametrize("codec", ["none", "snappy", "zstd", "lz4", "rle", "delta"])
def test_codecs_round_trip_through_storage(catalog, rows, codec):
    df = rows("v long, s string", (1, "a"), (2, None), (2, "b"), (None, "b")).coalesce(1)
    catalog.create_table("c", df.schema)
    catalog.write("c", df, codec, ["v"])
    assert [tuple(r) for r in catalog.read("c").collect()] == [(1, "a"), (2, None), (2, "b"), (None, "b")]
    with pytest.raises(ValueError):
        codecs.make_codec("brotli5")


def test_sorted_layout_lets_parquet_skip(catalog, spark):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("k"))
    catalog.create_table("z", df.schema)
    catalog.write("z", df, sort_by=["k"])
    found = catalog.read("z").where("k < 100")
    consume(found)
    assert found.count() == 100
    assert "PushedFilters: [IsNotNull(k), LessThan(k,100)]" in found._jdf.queryExecution().executedPlan().toString()


def test_scan_explain_and_rows_read(catalog, spark):
    df = spark.range(300_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("v"))
    catalog.create_table("z", df.schema)
    catalog.write("z", df.coalesce(1))
    engine = Engine(catalog)
    assert engine.scan("z", ["v"], [Predicate("k", CompareOp.LT, 10)]).columns == ["v"]
    assert engine.scan("z").count() == 300_000
    plan = QueryPlan("z", where=[Predicate("k", CompareOp.LT, 10)], aggregates=[Aggregate(AggFunc.SUM, "v", "s")])
    assert "LessThan(k,10)" in engine.explain(plan)
    result = engine.run(plan)
    assert result.rows_scanned == 300_000 and 10 <= result.rows_read <= 65_536
    assert engine.run(QueryPlan("z", ["k"])).rows_read == 300_000


# csv


@pytest.fixture
def csv(tmp_path):
    def write(text):
        path = tmp_path / "in.csv"
        path.write_bytes(text.encode())
        return str(path)

    return write


CSV = types.make_schema(id="INT32", name="STRING", amount="FLOAT64")


def test_csv_rules(spark, csv):
    path = csv('x,y,z\r\n1,"a,b",1.5\r\n\r\n2,c\r\n3,d,2,9\r\n4,"q""r", 7\r\n')
    df = read_csv(spark, path, CSV)
    assert [tuple(r) for r in df.collect()] == [(1, "a,b", 1.5), (4, 'q"r', 7.0)]
    assert df.count() == 2 and df.select("name").count() == 2


@pytest.mark.parametrize("bad", ["12abc,n,1", ",n,1", "99999999999,n,1", "1,n,x"])
def test_csv_bad_numbers_abort(spark, csv, catalog, bad):
    catalog.create_table("t", CSV)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CAST_OVERFLOW|cannot be cast"):
        ingest_csv(catalog, "t", csv(f"id,name,amount\n7,ok,2\n{bad}\n"))


def test_csv_lenient_prefix(spark, csv):
    assert [tuple(r) for r in read_csv(spark, csv("h,h,h\n12abc,n, 1.5kg\n"), CSV, lenient=True).collect()] == [(12, "n", 1.5)]


def test_csv_ingest_and_empty(spark, csv, catalog):
    catalog.create_table("t", CSV)
    ingest_csv(catalog, "t", csv("a,b,c\n1,x,2.5\n"))
    assert [tuple(r) for r in catalog.read("t").collect()] == [(1, "x", 2.5)]
    ingest_csv(catalog, "t", csv("a,b,c\n"))
    assert catalog.total_rows("t") == 0


# zone maps


def test_stats_and_skips(rows):
    df = rows("at long, v int", *[(i, v) for i, v in enumerate([10, 20, 5, 100, 30])])
    assert tuple(zonemaps.chunk_stats(df, "at", ["v"]).first()) == (0, 5, 5, 100)
    low, high = F.lit(1), F.lit(3)
    table = {(CompareOp.GT, 10): True, (CompareOp.GT, 2): False, (CompareOp.LT, 1): True, (CompareOp.GTE, 3): False, (CompareOp.LTE, 0): True, (CompareOp.EQ, 4): True, (CompareOp.NEQ, 2): False}
    for (op, t), want in table.items():
        assert rows("x int", (1,)).select(zonemaps.can_skip(op, low, high, F.lit(t))).first()[0] is want
    null = F.lit(None).cast("int")
    one_row = rows("x int", (1,))
    assert one_row.select(zonemaps.can_skip(CompareOp.GT, null, null, F.lit(1)), zonemaps.might_match_range(null, null, F.lit(1), F.lit(2))).first() == (False, True)
    assert one_row.select(*[zonemaps.might_match_range(F.lit(10), F.lit(30), F.lit(a), F.lit(b)) for a, b in ((15, 25), (50, 60))]).first() == (True, False)
    assert one_row.select(zonemaps.can_skip(CompareOp.NEQ, F.lit(7), F.lit(7), F.lit(7))).first()[0] is True


@pytest.mark.parametrize("op", list(CompareOp))
@pytest.mark.parametrize("value", [5.5, 5.1, -5.1, 5.9])
def test_pruning_never_loses_fractions(rows, op, value):
    data = [5.1, 5.9, -5.1, math.inf, -math.inf, 5.5, None]
    df = rows("at long, v double", *enumerate(data))
    wanted = [Predicate("v", op, value)]
    assert sorted(values(zonemaps.pruned_scan(df, "at", wanted, 2).select("at"))) == sorted(values(predicates.apply(df, wanted).select("at")))


# codecs


def test_run_lengths(rows):
    df = rows("at long, v int", *enumerate([1, 1, 1, 2, 2, 3]))
    runs = codecs.rle_encode(df, "v", "at")
    assert sorted(tuple(r) for r in runs.collect()) == [(0, 1, 1, 3), (0, 2, 2, 2), (0, 3, 3, 1)]
    assert [r["value"] for r in codecs.rle_decode(runs).orderBy("chunk", "pos").collect()] == [1, 1, 1, 2, 2, 3]


def test_constant_runs_shrink(spark):
    df = spark.range(65_536).select(F.col("id").alias("at"), F.lit(42).alias("v"))
    r = codecs.rle_size(codecs.rle_encode(df, "v", "at"), 4).first()
    assert (r["n_runs"], r["size"]) == (1, 7) and 65_536 * 4 / r["size"] > 50


@pytest.mark.parametrize("data", [[100, 105, 103, 110, 108], [1000 + i for i in range(500)], [-(2**62), 2**62 - 1, 0]])
def test_deltas(rows, data):
    df = rows("at long, v long", *enumerate(data))
    deltas = codecs.delta_encode(df, "v", "at")
    assert [r["value"] for r in codecs.delta_decode(deltas).orderBy("pos").collect()] == data
    if len(data) == 500:
        assert 8 * len(data) / codecs.delta_size(deltas).first()["size"] > 4


def test_zigzag_and_varint(rows):
    data = [0, -1, 1, -2, 63, -64, 64, 2**63 - 1, -(2**63)]
    df = rows("n long", *[(n,) for n in data])
    z = bits.zigzag_encode(F.col("n"))
    found = df.select("n", z.alias("z"), bits.zigzag_decode(z).alias("back"), bits.varint_length(z).alias("size")).collect()
    for r in found:
        want = (2 * r["n"] if r["n"] >= 0 else -2 * r["n"] - 1) % 2**64
        assert r["z"] % 2**64 == want and r["back"] == r["n"] and r["size"] == max(1, -(-want.bit_length() // 7))
    assert df.limit(1).select(bits.compression_ratio(F.lit(10), F.lit(4)), bits.compression_ratio(F.lit(10), F.lit(0))).first() == (2.5, 0.0)


# harness


def test_harness():
    r = run_benchmark("noop", lambda: sum(range(1000)), 1000)
    assert r.name == "noop" and r.rows == 1000 and r.elapsed_ms > 0 and r.rows_per_second > 0
    assert BenchmarkResult("x", 5, 0.0).rows_per_second == 0.0
    assert "noop" in str(r)


def test_mod_thousand_scans(spark):
    df = spark.range(100_000).select((F.col("id") % 1000).cast("int").alias("v"))
    assert one(df, AggFunc.SUM) == 49_950_000 and df.count() == 100_000
    plan = QueryPlan("t", where=[Predicate("v", CompareOp.LT, 500)], aggregates=[Aggregate(AggFunc.COUNT)])
    assert compile_plan(df.limit(50_000), plan).first()[0] == 25_000


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("int", [100, 105, None, 103, -(2**31), 2**31 - 1, 0]),
        ("bigint", [2**63 - 1, -(2**63), None, 0, -1, 1 << 53, None]),
        ("float", [1.5, 2.75, -3.25, None, float("inf"), -0.0, 3.4028234663852886e38]),
        ("double", [1.5, 2.7, -3.2, None, 5e-324, -0.0, float("-inf"), 1.7976931348623157e308]),
        ("double", [None, None]),
    ],
)
def test_delta_of_any_number_comes_back(rows, kind, values):
    df = rows(f"pos long, v {kind}", *enumerate(values))
    coded = codecs.delta_encode(df, "v", "pos", 4)
    got = codecs.delta_decode(coded, df.schema["v"].dataType).orderBy("pos")
    assert [repr(r["value"]) for r in got.collect()] == [repr(v) for v in values]
    assert got.schema["value"].dataType == df.schema["v"].dataType
    assert codecs.delta_size(coded).agg({"size": "sum"}).first()[0] >= len(values)


def test_delta_keeps_nan(rows):
    df = rows("pos long, v double", (0, float("nan")), (1, 2.0), (2, float("nan")))
    got = [r["value"] for r in codecs.delta_decode(codecs.delta_encode(df, "v", "pos"), df.schema["v"].dataType).orderBy("pos").collect()]
    assert got[0] != got[0] and got[1] == 2.0 and got[2] != got[2]


def test_delta_refuses_other_types(rows):
    for schema, value in (("pos long, v string", "a"), ("pos long, v boolean", True), ("pos long, v decimal(5,2)", None)):
        with pytest.raises(ValueError, match="no "):
            codecs.delta_encode(rows(schema, (0, value)), "v", "pos")


def test_limit_reads_no_more_files_than_it_needs(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "id % 10 as v")
    catalog.create_table("t", df.schema)
    catalog.write("t", df)
    assert [e.rows for e in catalog.extents("t")] == [500] * 8 and catalog.total_rows("t") == 4000
    engine = Engine(catalog)
    found = engine.execute(QueryPlan("t", ["id"], [Predicate("v", CompareOp.EQ, 3)], limit=20))
    assert [r["id"] for r in found.collect()] == list(range(3, 203, 10))
    assert len(found.inputFiles()) == 1
    assert len(engine.execute(QueryPlan("t", limit=501)).inputFiles()) == 4
    assert [r["id"] for r in engine.execute(QueryPlan("t", ["id"], [Predicate("v", CompareOp.EQ, 3)], limit=400)).collect()] == list(range(3, 4000, 10))
    assert engine.execute(QueryPlan("t", [], [Predicate("v", CompareOp.GT, 50)], limit=3)).collect() == []
    with pytest.raises(ValueError, match="unknown column"):
        engine.execute(QueryPlan("t", ["nothing"], limit=3))


def test_reader_goes_file_by_file(spark, tmp_path, monkeypatch):
    from lamella.streaming import reader

    monkeypatch.setattr(reader, "FETCH_ROWS", 64)
    catalog = Catalog(spark, str(tmp_path))
    df = spark.range(0, 1000, 1, 3).selectExpr("id", "nullif(id, 7) as v")
    catalog.create_table("t", df.schema)
    catalog.write("t", df)
    catalog.append("t", df)
    chunks = list(reader.ColumnReader(catalog, "t", "v", 150))
    assert [len(c) for c in chunks] == [150] * 13 + [50]
    assert [v for c in chunks for v in c] == [None if i == 7 else i for i in range(1000)] * 2
    empty = Catalog(spark, str(tmp_path / "other"))
    empty.create_table("e", df.schema)
    assert reader.ColumnReader(empty, "e", "v").next_chunk() is None


def test_pruned_scan_filters_ranges_of_chunks(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "id div 100 as v")
    wanted = [Predicate("v", CompareOp.EQ, 4)]
    stats = zonemaps.chunk_stats(df, "id", ["v"], 50)
    for ranges in (500, 0):
        monkeypatch.setattr(zonemaps, "FILTER_RANGES", ranges)
        found = zonemaps.pruned_scan(df, "id", wanted, 50, stats)
        assert sorted(r["id"] for r in found.collect()) == list(range(400, 500))
        assert ("Join" in found._jdf.queryExecution().toString()) == (ranges == 0)
    none = zonemaps.pruned_scan(df, "id", [Predicate("v", CompareOp.GT, 99)], 50)
    assert none.collect() == []
