"""Tables under a base path: a schema file and Parquet data with a stored row number."""

from __future__ import annotations

import json
import posixpath
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.types import column_index, column_type
from lamella.operators.codecs import make_codec
from lamella.operators.zonemaps import CHUNK_ROWS

#: Column of the stored order; hidden from a table's schema.
ORDINAL = "__ordinal"


@dataclass(frozen=True)
class Extent:
    """A data file and what it holds of the stored order."""

    name: str
    first: int
    last: int
    rows: int


class Catalog:
    """Creates, writes and reads tables below base; works with any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        path = self._path(self.base)
        path.getFileSystem(self._conf()).mkdirs(path)

    def _conf(self) -> object:
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _data(self, table: str) -> str:
        return posixpath.join(self.base, table, "data")

    def _schema_file(self, table: str) -> str:
        return posixpath.join(self.base, table, "schema.json")

    def create_table(self, table: str, schema: T.StructType) -> None:
        """Store the schema and make the table empty; a table of that name is replaced."""
        if ORDINAL in schema.fieldNames():
            raise ValueError(f"{ORDINAL} is reserved")
        self._put(self._schema_file(table), {"table_name": table, "schema": schema.jsonValue()})
        self.write(table, self.spark.createDataFrame([], schema))

    def _put(self, file: str, value: object) -> None:
        path = self._path(file)
        out = path.getFileSystem(self._conf()).create(path, True)
        out.write(bytearray(json.dumps(value, indent=2).encode()))
        out.close()

    def _get(self, file: str) -> dict | None:
        path = self._path(file)
        if not path.getFileSystem(self._conf()).exists(path):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(file).collect()))

    def load_schema(self, table: str) -> T.StructType:
        found = self._get(self._schema_file(table))
        if found is None:
            raise ValueError(f"unknown table: {table}")
        return T.StructType.fromJson(found["schema"])

    def extents(self, table: str) -> list[Extent]:
        """The table's data files in stored order, as noted when it was last written."""
        self.load_schema(table)
        found = self._get(posixpath.join(self.base, table, "extents.json"))
        return [Extent(**e) for e in found["files"]] if found else []

    def _note_extents(self, table: str, schema: T.StructType, before: list[Extent], start: int) -> None:
        """Take the bounds of new files, those from row number start on, from a read of that column alone."""
        name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")
        new = self._stored(table, schema).select(name, ORDINAL).where(F.col(ORDINAL) >= start).groupBy("name").agg(F.min(ORDINAL), F.max(ORDINAL), F.count(F.lit(1))).collect()
        files = sorted([*before, *(Extent(*r) for r in new)], key=lambda e: e.first)
        self._put(posixpath.join(self.base, table, "extents.json"), {"files": [asdict(e) for e in files]})

    def write(self, table: str, df: DataFrame, codec: str = "snappy", delta_columns: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "overwrite") -> None:
        """Write df's rows, which must have the table's columns and types, in row groups of 65,536.

        Stored order is df's order, or that of sort_by, by which ranges of rows go to files, so that
        row-group bounds let filters on those columns skip most of them. A delta codec is for sorted
        integer columns and names them in delta_columns.
        """
        schema = self.load_schema(table)
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"{df.schema.simpleString()} isn't the schema of {table}: {schema.simpleString()}")
        if sort_by:
            for c in sort_by:
                column_type(schema, c)
            df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        before = self.extents(table) if mode == "append" else []
        start = ((before[-1].last >> 33) + 1) << 33 if before else 0
        stored = df.withColumn(ORDINAL, F.lit(start).cast("long") + F.monotonically_increasing_id())
        options = make_codec(codec).writer_options(delta_columns or [])
        stored.write.mode(mode).options(**options).option("parquet.block.row.count.limit", str(CHUNK_ROWS)).parquet(self._data(table))
        self._note_extents(table, schema, before, start)

    def append(self, table: str, df: DataFrame, codec: str = "snappy") -> None:
        self.write(table, df, codec, mode="append")

    def _stored(self, table: str, schema: T.StructType, files: list[Extent] | None = None) -> DataFrame:
        paths = [self._data(table)] if files is None else [posixpath.join(self._data(table), e.name) for e in files]
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(ORDINAL, T.LongType())])).parquet(*paths)

    def stored(self, table: str, files: list[Extent] | None = None) -> DataFrame:
        """The table, or some of its files, with its ORDINAL column."""
        return self._stored(table, self.load_schema(table), files)

    def read(self, table: str, columns: list[str] | None = None) -> DataFrame:
        """The named columns (all if none are named), in the order named."""
        schema = self.load_schema(table)
        for c in columns or []:
            column_type(schema, c)
        return self._stored(table, schema).select(*[F.col(f"`{c}`") for c in columns or schema.fieldNames()])

    def read_column(self, table: str, column: str) -> DataFrame:
        return self.read(table, [column])

    def column_index(self, table: str, column: str) -> int:
        return column_index(self.load_schema(table), column)

    def total_rows(self, table: str) -> int:
        return sum(e.rows for e in self.extents(table))
