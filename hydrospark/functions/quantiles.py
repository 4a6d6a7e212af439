"""Exact quantiles per raster without gathering or sorting a raster.

A mergeable sketch brackets the wanted rank; one more pass counts what lies below the
bracket and collapses the values inside it, which alone are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.scratch import cut
from hydrospark.tiling import attach

#: Inverse of the rank error of the sketch, as a share of a raster's values.
ACCURACY = 10_000


def exact_quantile(df: DataFrame, value: str, q: float, out: str, accuracy: int = ACCURACY) -> DataFrame:
    """Linearly interpolated quantile of ``value`` per raster (NULLs ignored; rasters of NULLs alone are absent).

    Two passes at any size: the bracket holds some ``4 / accuracy`` of the values, is dealt by
    ranges and ordered within each range.  Were a bracket to miss the rank, its raster
    would run again with a wider one.
    """
    values = cut(df.where(F.col(value).isNotNull()).select("raster_id", F.col(value).cast("double").alias("v")))
    done, slack = None, 2 / accuracy
    while True:
        sides = F.array(F.lit(max(q - slack, 0.0)), F.lit(min(q + slack, 1.0)))
        bracket = values.groupBy("raster_id").agg(
            F.count("*").alias("n"), F.percentile_approx("v", sides, accuracy).alias("side"),
            F.min("v").alias("least"), F.max("v").alias("most"))
        low, high = F.lit(q <= slack), F.lit(q + slack >= 1)
        bracket = cut(bracket.select(
            "raster_id", (F.lit(q) * (F.col("n") - 1)).alias("place"),
            F.when(low, F.col("least")).otherwise(F.col("side")[0]).alias("lo"),
            F.when(high, F.col("most")).otherwise(F.col("side")[1]).alias("hi")))
        picked, seen = cut(_picked(values, bracket), missed=F.count_if(F.expr("v0 IS NULL OR v1 IS NULL")))
        good = picked.where("v0 IS NOT NULL AND v1 IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        if not seen["missed"]:
            break
        values, slack = cut(attach(values, good.select("raster_id", F.lit(True).alias("good")), F.col("v")).where("good IS NULL").drop("good")), slack * 8
    return done.select("raster_id", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("place") - F.floor("place"))).alias(out))


def _picked(values: DataFrame, bracket: DataFrame) -> DataFrame:
    """``raster_id, place`` and the values ``v0``, ``v1`` at the ranks around it; NULL where the bracket misses one."""
    # All values below a bracket become one NULL, which comes first in its order.
    inside = attach(values, bracket, F.col("v")).where("v <= hi").select(
        "raster_id", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).groupBy("raster_id", "v").agg(F.count("*").alias("n"))
    held = cut(inside.repartitionByRange("raster_id", "v").withColumn("part", F.spark_partition_id()))
    ranks = bracket.select("raster_id", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.floor("place").alias("rank")), F.struct(F.lit(1).alias("k"), F.ceil("place").alias("rank")))).alias("r"))
    ranks = ranks.select("raster_id", "r.*")
    before = Window.partitionBy("raster_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = held.groupBy("raster_id", "part").agg(F.sum("n").alias("in_part")).withColumn("upto", F.sum("in_part").over(before))
    wanted = ranges.join(ranks, "raster_id").where("upto > rank AND upto - in_part <= rank").select(
        "raster_id", "part", "k", (F.col("rank") - F.col("upto") + F.col("in_part")).alias("inner_rank"))
    upto = Window.partitionBy("raster_id", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = held.withColumn("upto", F.sum("n").over(upto)).join(wanted, ["raster_id", "part"])
    found = placed.where("upto > inner_rank AND upto - n <= inner_rank").groupBy("raster_id").agg(
        F.max(F.when(F.col("k") == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("v1"))
    return bracket.select("raster_id", "place").join(found, "raster_id", "left")
