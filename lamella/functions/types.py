"""The five column types: names, widths, Spark types, lookups in a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES: dict[str, tuple[T.DataType, int]] = {
    "INT32": (T.IntegerType(), 4),
    "INT64": (T.LongType(), 8),
    "FLOAT32": (T.FloatType(), 4),
    "FLOAT64": (T.DoubleType(), 8),
    "STRING": (T.StringType(), 4),
}


def type_from_name(name: str) -> T.DataType:
    if name not in _TYPES:
        raise ValueError(f"unknown type: {name}")
    return _TYPES[name][0]


def type_name(kind: T.DataType) -> str:
    for name, (spark_type, _) in _TYPES.items():
        if spark_type == kind:
            return name
    raise ValueError(f"no column type for {kind.simpleString()}")


def element_size(kind: T.DataType | str) -> int:
    """Bytes of one value (a string's reserved slot)."""
    return _TYPES[kind if isinstance(kind, str) else type_name(kind)][1]


def make_schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(c, type_from_name(k)) for c, k in columns.items()])


def column_index(schema: T.StructType, name: str) -> int:
    """The column's position, -1 if it isn't there."""
    return schema.fieldNames().index(name) if name in schema.fieldNames() else -1


def column_type(schema: T.StructType, name: str) -> T.DataType:
    if name not in schema.fieldNames():
        raise ValueError(f"unknown column: {name}")
    return schema[name].dataType
