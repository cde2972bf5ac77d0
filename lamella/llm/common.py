"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside these six ASCII spaces.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch of texts at most (a longer text is a batch of its own).
BATCH_BYTES = 4 << 20

M1 = np.uint64(0xFF51AFD7ED558CCD)
M2 = np.uint64(0xC4CEB9FE1A85EC53)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lamella-checkpoint-")
    sc.setCheckpointDir(path)
    return path


#: The frames that were cut within `scratch`, if any is open.
_made: list[DataFrame] | None = None


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    found = df.checkpoint(eager=True)
    if _made is not None:
        _made.append(found)
    return found


def drop_cut(df: DataFrame) -> None:
    """Delete what `cut` wrote for df, once nothing that is still to run reads it."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        drop_written(df.sparkSession, file.get())


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Everything that is cut within goes at its end."""
    global _made
    before, _made = _made, []
    try:
        yield
    finally:
        made, _made = _made, before
        for df in made:
            drop_cut(df)


def row_columns(docs: DataFrame) -> list[Column]:
    """All columns of docs, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path; for rows with long texts."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns (doc_id and text by default) of docs, about to go to Python.

    Bounds the session's Arrow batches by bytes as well as rows, unless a smaller bound is set, so
    that a worker's memory doesn't follow the length of texts.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, "67108864b").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return docs.select(*(columns or ("doc_id", "text")))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 4; remainder 2 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def release_memory() -> None:
    """Give freed memory back to the system; Python workers live on after a task, and others need it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", block_chars: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about block_chars bytes of text each, nulls in that column made empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        filled = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, column, filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False))
        each = ends[-1] / max(1, round(ends[-1] / block_chars)) if len(ends) else 0
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + each, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, filled
    release_memory()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and the offsets of each text's words in it."""
    parts = pc.ascii_split_whitespace(texts)
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    kept = full.to_numpy(zero_copy_only=False)
    if not kept.all():
        counts = np.concatenate(([0], np.cumsum(kept)))
        words, offsets = words.filter(full), counts[offsets]
    return words, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


def hash_words(words: pa.Array) -> np.ndarray:
    """xxh3 of each word's UTF-8 bytes; each distinct word of the block is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
