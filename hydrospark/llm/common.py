"""Small pieces that several text operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.grouped import ship_package

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tidied(batches, fn):
    """A task's rows; when it ends, what it freed goes back to the machine, as its worker waits for the next."""
    try:
        yield from fn(batches)
    finally:
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
            trim(0)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(partial(_tidied, fn=fn), schema)


def shuffle_parts(df: DataFrame) -> int:
    """Partitions for a shuffle about as large as ``df``: never fewer than its scan has."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(wanted, df.rdd.getNumPartitions())


def ascii_lower(column) -> F.Column:
    return F.translate(column, UPPER, LOWER_CASE)


def held_out(doc_id, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``remainder``; a missing id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes of text, or one longer row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind.type) for c, kind in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _kept_rows(batches, flags, state):
    for rows in batches:
        yield rows.filter(pa.array(flags(rows.column("text"), state), pa.bool_()))


def keep_texts(docs: DataFrame, flags, state) -> DataFrame:
    """Rows of ``docs`` whose text is flagged by ``flags(text column, state)``; columns pass through unchanged."""
    ship_package(docs.sparkSession)
    return docs.mapInArrow(partial(_kept_rows, flags=flags, state=state), docs.schema)
