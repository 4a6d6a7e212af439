"""Cutting lineage: intermediate tables written to the cluster's shared folder.

Loops would otherwise grow one plan without end.  A cut writes parquet below
``spark.checkpoint.dir`` and reads it back, so a lost executor only costs a
re-read, later stages prune columns, and rows are counted while they are written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Raster tables with more rows are never broadcast for the size of their files: ids that run and a
#: raster's one name are packed there into a hundredth of what the rows take in memory.  A row takes some
#: 200 bytes in a broadcast, and a step may still explode it into a handful before it joins.
BROADCAST_ROWS = 20_000


def scratch_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.hydrospark.scratchDir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hydrospark-")
        spark.conf.set("spark.hydrospark.scratchDir", folder)
    return folder.rstrip("/")


_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the scratch tables written inside when it ends; nothing may read them after.

    Scopes of other threads, and an outer one, keep their own tables.
    """
    written: list[str] = []
    token = _scope.set(written)
    try:
        yield
    finally:
        _scope.reset(token)
        for table in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, **metrics: Column):
    """Write ``df`` to scratch and return the table read back.

    With keyword aggregates the result is ``(table, {name: value})``; they are
    computed while writing, so a loop learns its stop condition for free.

    Tables of more than ``BROADCAST_ROWS`` rows with a ``raster_id`` join by shuffle; what has one
    row per raster goes to them by ``tiling.attach``.
    """
    if getattr(df, "_is_cut", False) and not metrics:
        return df
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    if (written := _scope.get()) is not None:
        written.append(path)
    asked, schema, seen = dict(metrics), df.schema, {}
    if "raster_id" in df.columns:
        asked["_rows"] = F.count("*")
    if asked:
        watched = Observation(uuid.uuid4().hex)
        df = df.observe(watched, *[value.alias(name) for name, value in asked.items()])
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    if asked:
        seen = watched.get
        if seen.get("_rows", 0) > BROADCAST_ROWS:
            table = table.hint("merge")
    table._is_cut = True
    return (table, {name: seen[name] for name in metrics}) if metrics else table
