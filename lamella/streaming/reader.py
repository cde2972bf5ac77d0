"""Chunks of one column, pulled one at a time in stored order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from lamella.operators.zonemaps import CHUNK_ROWS
from lamella.sources.catalog import ORDINAL, Catalog

#: Rows that are fetched at once, about.
FETCH_ROWS = 16 * CHUNK_ROWS


class ColumnReader:
    """next_chunk() gives the next values, at most `rows`, and None at the end.

    Files are read one after another in stored order, as far as they are pulled, in Arrow batches of
    a range of row numbers, which Parquet's bounds find without reading the rest; nothing is sorted
    beyond such a batch, and memory holds one.
    """

    def __init__(self, catalog: Catalog, table: str, column: str, rows: int = CHUNK_ROWS) -> None:
        catalog.read_column(table, column)
        self._parts = self._fetch(catalog, table, column)
        self._held = pa.chunked_array([], pa.null())
        self._rows = rows
        self.exhausted = False

    @staticmethod
    def _fetch(catalog: Catalog, table: str, column: str) -> Iterator[pa.ChunkedArray]:
        for extent in catalog.extents(table):
            file = catalog.stored(table, [extent]).select(ORDINAL, F.col(f"`{column}`").alias("value"))
            for start in range(extent.first, extent.last + 1, FETCH_ROWS):
                yield file.where((F.col(ORDINAL) >= start) & (F.col(ORDINAL) < start + FETCH_ROWS)).toArrow().sort_by(ORDINAL).column("value")

    def next_chunk(self) -> list | None:
        while len(self._held) < self._rows and (more := next(self._parts, None)) is not None:
            self._held = pa.chunked_array([*(self._held.chunks if len(self._held) else []), *more.chunks], more.type)
        if not len(self._held):
            self.exhausted = True
            return None
        chunk, self._held = self._held[: self._rows], self._held[self._rows :]
        return chunk.to_pylist()

    def __iter__(self) -> Iterator[list]:
        while (chunk := self.next_chunk()) is not None:
            yield chunk
