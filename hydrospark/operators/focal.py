"""Moving-window operators over the cell table: JVM windows, or NumPy on one tile where a cell looks at all its neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.functions.quantiles import exact_quantile
from hydrospark.operators.grid import each_neighbor, extent, from_neighbors, is_close, with_neighbors, without_neighbors
from hydrospark.schema import TILE_KEYS
from hydrospark.scratch import cut
from hydrospark.tiling import attach, own_cells, tile_side, with_halo


def _coalesced(n: Column, field: str = "valid") -> Column:
    return F.coalesce(n[field], F.lit(False))


def _window_sums(g: DataFrame, radius: int, sums: dict[str, Column], side: int | None = None) -> DataFrame:
    """Sums over the (2r+1)^2 window: down the columns, then across the partials."""
    side = side or tile_side(g.sparkSession)
    down = Window.partitionBy(*TILE_KEYS, "col").orderBy("row").rowsBetween(-radius, radius)
    across = Window.partitionBy(*TILE_KEYS, "row").orderBy("col").rowsBetween(-radius, radius)
    tiled = with_halo(g, side, radius).repartition(*TILE_KEYS)
    first = tiled.select("*", *[F.sum(v).over(down).alias(f"_{k}") for k, v in sums.items()])
    second = first.select("*", *[F.sum(f"_{k}").over(across).alias(k) for k in sums])
    return second.where(own_cells(side)).select(*g.columns, *sums)


def box_smooth(g: DataFrame, kernel_size: int, side: int | None = None) -> DataFrame:
    """Mean of the valid cells in the window; invalid cells keep their height."""
    radius = max((kernel_size - 1) // 2, 0)
    if radius == 0:
        return g
    ok = F.col("valid")
    sums = {
        "w_sum": F.when(ok, F.col("height").cast("double")).otherwise(0.0),
        "w_n": ok.cast("int"),
    }
    mean = (F.col("w_sum") / F.col("w_n")).cast("float")
    out = _window_sums(g, radius, sums, side)
    return out.withColumn("height", F.when(ok, mean).otherwise(F.col("height"))).drop("w_sum", "w_n")


def max_gradient(g: DataFrame) -> DataFrame:
    """``gradient``: largest absolute height step to a valid neighbour (0 on invalid cells)."""
    steps = each_neighbor(
        lambda n, i: F.when(F.col("valid") & _coalesced(n), F.abs(F.col("height") - n["height"]))
    )
    zero = F.lit(0.0).cast("float")
    return without_neighbors(
        with_neighbors(g, ["height", "valid"]).withColumn("gradient", F.greatest(zero, *steps).cast("float"))
    )


def local_variance(g: DataFrame) -> DataFrame:
    """``variance``: population variance of the valid cells in the 3x3 window (0 on invalid cells)."""
    ok = F.col("valid")
    h = F.col("height").cast("double")
    sums = {
        "w_sum": F.when(ok, h).otherwise(0.0),
        "w_sq": F.when(ok, h * h).otherwise(0.0),
        "w_n": ok.cast("int"),
    }
    mean = F.col("w_sum") / F.col("w_n")
    spread = F.greatest(F.col("w_sq") / F.col("w_n") - mean * mean, F.lit(0.0)).cast("float")
    out = _window_sums(g, 1, sums)
    zero = F.lit(0.0).cast("float")
    return out.withColumn("variance", F.when(ok, spread).otherwise(zero)).drop("w_sum", "w_sq", "w_n")


def _low_score(g: DataFrame, raw: str, out: str) -> DataFrame:
    """1 - raw scaled by its 95th percentile over the valid cells, clipped to [0, 1]."""
    g = cut(g)
    p95 = exact_quantile(g.where("valid"), raw, 0.95, "_p95")
    scale = F.when(F.col("_p95") <= 1e-6, 1.0).otherwise(F.col("_p95"))
    score = F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(raw) / scale))
    # A raster without valid cells has no percentile; its scores are 0.
    return attach(g, p95).withColumn(out, F.coalesce(score, F.lit(0.0))).drop("_p95", raw)


def gradient_score(g: DataFrame) -> DataFrame:
    return _low_score(max_gradient(g), "gradient", "gradient_score")


def variance_score(g: DataFrame) -> DataFrame:
    return _low_score(local_variance(g), "variance", "variance_score")


def sink_pass(g: DataFrame) -> DataFrame:
    """One local sink lift over interior cells; adds ``lifted``.

    A valid cell strictly below all valid neighbours rises to their mean when no
    neighbour is close to it, otherwise to their minimum.
    """
    boxed = attach(with_neighbors(g, ["height", "valid"]), extent(g))
    h = F.col("height")
    values = each_neighbor(lambda n, i: F.when(_coalesced(n), n["height"]))
    lowest = F.least(*values)
    zero = F.lit(0.0).cast("float")
    total, count, level = zero, F.lit(0), F.lit(False)
    for v in values:
        total = (total + F.coalesce(v, zero)).cast("float")
        count = count + v.isNotNull().cast("int")
        level = level | F.coalesce(is_close(v, h), F.lit(False))
    interior = (
        (F.col("row") > 0) & (F.col("row") < F.col("n_rows") - 1)
        & (F.col("col") > 0) & (F.col("col") < F.col("n_cols") - 1)
    )
    sink = interior & F.col("valid") & lowest.isNotNull() & (h < lowest)
    raised = F.when(level, lowest).otherwise((total / count).cast("float"))
    out = boxed.withColumn("lifted", F.coalesce(sink, F.lit(False)))
    out = out.withColumn("height", F.when(F.col("lifted"), raised).otherwise(h).cast("float"))
    return without_neighbors(out).drop("n_rows", "n_cols")


def d8_strict(g: DataFrame) -> DataFrame:
    """``direction``: steepest strictly downhill valid neighbour, first code on ties, -1 if none."""
    def code(table, near, own):
        found = kernels.steepest(kernels.layer(table, "height", np.nan), kernels.layer(table, "valid", False), near)
        return {"direction": pa.array(found, pa.int32())}

    return from_neighbors(g, code, direction="integer")


def outlet_drop(g: DataFrame, label: str = "label") -> DataFrame:
    """``drop``: largest positive fall from a labelled cell to a valid neighbour of another label (cell ids, >= 0)."""
    def fall(table, near, own):
        height, valid, of = (kernels.layer(table, c, fill) for c, fill in (("height", np.nan), ("valid", False), (label, -1)))
        d = (height - height[near]).astype(np.float32)
        falls = valid & (of >= 0) & valid[near] & (near >= 0) & (of[near] != of) & (d > 0)
        return {"drop": pa.array(np.where(falls, d, np.float32(0)).max(axis=0), pa.float32())}

    return from_neighbors(g, fall, drop="float")
