"""Grouped pandas steps; makes sure the executors can import this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to Spark once per application, for its Python workers."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="hydrospark-code-")) / "hydrospark.zip"
    with zipfile.ZipFile(bundle, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path("hydrospark") / source.relative_to(root))
    context.addPyFile(str(bundle))
    _shipped.add(context.applicationId)


def map_groups(df: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    ship_package(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(fn, schema)


def map_tables(df: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    """``fn`` from Arrow table to Arrow table for every group; columns it does not touch stay as they are."""
    ship_package(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(fn, schema)


def map_pairs(left: DataFrame, right: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    ship_package(left.sparkSession)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, schema)


def widened(df: DataFrame, **added: str) -> StructType:
    """Schema of ``df`` plus new columns."""
    schema = StructType(list(df.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return schema
