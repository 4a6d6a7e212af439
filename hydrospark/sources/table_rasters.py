"""Height rasters derived from the order, part and event tables.

Keys count up from 0; cell = (key div W, key % W) with W = ceil(sqrt(orders)).
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.operators.grid import densify
from hydrospark.schema import KEYS
from hydrospark.scratch import BROADCAST_ROWS
from hydrospark.sources.rasters import cells_from_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_width(spark: SparkSession, sf_dir: str) -> int:
    return ceil(sqrt(_table(spark, sf_dir, "orders").count()))


def sparse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise: floor(o_totalprice / 2000), last raster row ragged."""
    w = grid_width(spark, sf_dir)
    return cells_from_table(
        _table(spark, sf_dir, "orders"), f"o_orderkey div {w}", f"o_orderkey % {w}", "floor(o_totalprice / 2000)", "orders")


def dem_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(sparse_orders(spark, sf_dir))


def dem_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3x3 blocks of equal height taken from p_size: flats and closed basins."""
    w = grid_width(spark, sf_dir)
    part = _table(spark, sf_dir, "part")
    parts = part.count()
    cells = _table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {w}").alias("r"), F.expr(f"o_orderkey % {w}").alias("c"))
    block = F.expr(f"((r div 3) * {ceil(w / 3)} + (c div 3)) % {parts}")
    sizes = part.select("p_partkey", "p_size")
    joined = cells.withColumn("p_partkey", block).join(sizes.hint("merge") if parts > BROADCAST_ROWS else sizes, "p_partkey")
    return densify(cells_from_table(joined, "r", "c", "p_size", "blocks"))


def dem_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valley draining east, with small bumps and a clamped plateau."""
    w = grid_width(spark, sf_dir)
    cells = _table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {w}").alias("r"), F.expr(f"o_orderkey % {w}").alias("c"))
    height = f"least(255, abs(r - {w // 2}) * 3 + ({w - 1} - c) * 2 + (r * 31 + c * 17) % 5)"
    return densify(cells_from_table(cells, "r", "c", height, "valley"))


def dem_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rasters from one table: raster = key % 4, cell from key div 4."""
    n = _table(spark, sf_dir, "orders").count()
    w = ceil(sqrt(ceil(n / 4)))
    orders = _table(spark, sf_dir, "orders")
    name = F.concat(F.lit("orders_"), F.expr("o_orderkey % 4").cast("string"))
    return densify(cells_from_table(
        orders, f"(o_orderkey div 4) div {w}", f"(o_orderkey div 4) % {w}", "floor(o_totalprice / 2000)", name))


def mask_events(spark: SparkSession, sf_dir: str, raster: DataFrame) -> DataFrame:
    """Mask of the shape of ``raster``: False where event_id % 11 = 0, True elsewhere."""
    w = grid_width(spark, sf_dir)
    off = _table(spark, sf_dir, "events").select(
        F.expr(f"event_id div {w}").cast("int").alias("row"), F.expr(f"event_id % {w}").cast("int").alias("col"),
        (F.col("event_id") % 11 != 0).alias("_on"))
    return raster.select(*KEYS).join(off, ["row", "col"], "left").select(*KEYS, F.coalesce("_on", F.lit(True)).alias("mask"))


def arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction raster with cycles: (o_custkey % 9) - 1."""
    w = grid_width(spark, sf_dir)
    cells = cells_from_table(
        _table(spark, sf_dir, "orders"), f"o_orderkey div {w}", f"o_orderkey % {w}", "(o_custkey % 9) - 1", "arrows")
    return densify(cells).select(*KEYS, F.when(F.col("valid"), F.col("height").cast("int")).otherwise(-1).alias("direction"))
