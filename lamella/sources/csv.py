"""CSV ingest with a declared schema: columns by position, rows of another arity skipped, bad numbers an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.sources.catalog import Catalog

#: What a number may begin with where trailing characters are ignored.
_PREFIX = {"integer": r"^\s*([+-]?[0-9]+)", "fraction": r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"}


def _parse(column: Column, kind: T.DataType, lenient: bool) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(column, F.lit(""))
    text = F.coalesce(column, F.lit(""))
    if lenient:
        text = F.regexp_extract(text, _PREFIX["integer" if isinstance(kind, T.IntegerType | T.LongType) else "fraction"], 1)
    return F.trim(text).cast(kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """The file's rows in the schema's types.

    The first line is a header and its names are ignored. Blank lines and rows with another number of
    fields are dropped. Quotes hold commas, a doubled quote is one. An empty or non-numeric field in a
    numeric column is an error when the rows are used; lenient takes a leading number and ignores the
    rest. All fields of a row are always read, and as text: a reader that prunes columns would let rows
    of another arity pass, and one that parses numbers would drop rows instead of failing.
    """
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
    rows = (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return rows.select(*[_parse(F.col(f"c{i}"), f.dataType, lenient).alias(f.name) for i, f in enumerate(schema)])


def ingest_csv(catalog: Catalog, table: str, path: str, lenient: bool = False, codec: str = "none") -> None:
    """Replace the table's rows by the file's; nothing is replaced if a number can't be read."""
    rows = read_csv(catalog.spark, path, catalog.load_schema(table), lenient)
    catalog.write(table, rows, codec)
