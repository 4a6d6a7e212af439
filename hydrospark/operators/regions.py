"""Flat regions: outlets, closed-flat repair, outlet segments and flat directions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.config import FlowDirectionConfig
from hydrospark.operators.components import connected_components, flat_regions
from hydrospark.operators.focal import outlet_drop
from hydrospark.operators.geodesic import COST_UNIT, region_distances
from hydrospark.operators.grid import each_neighbor, from_neighbors, with_neighbors
from hydrospark.schema import D8_STEPS, KEYS, cell_id, id_row
from hydrospark.scratch import cut
from hydrospark.tiling import lookup_by_tile, tile_side

CLOSE = 1e-6
SLOPE_STEP = 0.0010000000474974513  # fixed value: 1e-3 in single precision


def flat_outlets(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Per region: size, ``has_lower`` outlet, ``spill`` height and ``anchor`` cell id."""
    h = F.col("height")

    def outside(n):
        return F.coalesce(n["valid"], F.lit(False)) & ~n[label].eqNullSafe(F.col(label))

    lower = [F.coalesce(outside(n) & (n["height"] < h - CLOSE), F.lit(False)) for n in each_neighbor(lambda n, i: n)]
    spill = each_neighbor(lambda n, i: F.when(outside(n) & ~(n["height"] < h - CLOSE), n["height"]))
    any_lower = lower[0]
    for one in lower[1:]:
        any_lower = any_lower | one
    cells = with_neighbors(labelled, ["height", "valid", label]).where(F.col(label).isNotNull()).select(
        "raster_id", label, cell_id().alias("_id"), any_lower.alias("_lower"), F.least(*spill).alias("_spill")
    )
    best = F.min(F.when(F.col("_spill").isNotNull(), F.struct("_spill", "_id")))
    return cells.groupBy("raster_id", label).agg(
        F.count("*").alias("size"), F.bool_or("_lower").alias("has_lower"), best.alias("_b")
    ).select("raster_id", label, "size", "has_lower", F.col("_b._spill").alias("spill"), F.col("_b._id").alias("anchor"))


def repair_closed_flats(g: DataFrame) -> DataFrame:
    """Lift flats without a lower outlet above their spill height, sloping towards the
    spill anchor; adds ``repaired``."""
    side = tile_side(g.sparkSession)
    labelled = cut(flat_regions(g, "_flat"))
    closed = cut(flat_outlets(labelled, "_flat").where("size > 1 AND NOT has_lower AND spill IS NOT NULL"))
    if closed.isEmpty():
        return labelled.drop("_flat").withColumn("repaired", F.lit(False))
    held = cut(lookup_by_tile(labelled, closed.select("raster_id", "_flat", "spill", "anchor"), "_flat", side).where("spill IS NOT NULL"))
    start = cell_id() == F.col("anchor")
    far = region_distances(held.select(
        *KEYS, F.col("_flat").alias("region"),
        F.when(start, F.lit(0).cast("bigint")).alias("cost"), F.when(start, F.lit(0).cast("bigint")).alias("source"),
    ))
    lifted = held.select(*KEYS, "spill").join(far.select(*KEYS, "dist"), KEYS).select(
        *KEYS, (F.col("spill").cast("double") + F.lit(SLOPE_STEP) * (F.col("dist") + 1)).cast("float").alias("_new")
    )
    return labelled.drop("_flat").join(lifted, KEYS, "left").withColumn(
        "repaired", F.col("_new").isNotNull()
    ).withColumn("height", F.coalesce("_new", "height")).drop("_new")


def segment_cells(g: DataFrame) -> DataFrame:
    """Adds ``seg`` to outlet cells (``drop`` > 0): first cell id of their 8-connected
    group inside the same region."""
    return connected_components(g, F.col("drop") > 0, F.col("label"), 0.0, "seg")


def segment_stats(cells: DataFrame, length_weight: float) -> DataFrame:
    n = F.count("*")
    return cells.where("seg IS NOT NULL").groupBy("raster_id", "label", "seg").agg(
        (F.avg(F.col("drop").cast("double")) + F.lit(float(length_weight)) * F.log1p(n)).alias("strength"),
        F.avg("row").alias("center_row"), F.avg("col").alias("center_col"), n.alias("n_cells"),
    )


def outlet_segments(g: DataFrame, cfg: FlowDirectionConfig | None = None) -> DataFrame:
    """Outlet segments per flat region, numbered in scan order of their first cell."""
    cfg = cfg or FlowDirectionConfig()
    drops = outlet_drop(cut(flat_regions(g)))
    stats = cut(segment_stats(segment_cells(drops), cfg.flat_outlet_length_weight))
    # Numbered per raster row first, so no window holds all segments of a large region.
    per_row = stats.groupBy("raster_id", "label", id_row("seg").alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("raster_id", "label").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_row.select("raster_id", "label", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("raster_id", "label", "_r").orderBy("seg")
    return stats.withColumn("_r", id_row("seg")).withColumn("_k", F.row_number().over(inside) - 1).join(
        offset, ["raster_id", "label", "_r"]
    ).select("raster_id", "label", (F.col("_off") + F.col("_k")).cast("int").alias("segment"),
             "strength", "center_row", "center_col", "n_cells")


def nearest_segments(cells: DataFrame, cfg: FlowDirectionConfig | None = None) -> DataFrame:
    """The segment of each reached region cell (see ``assign_segments``): keys, ``seg_of``, ``dist`` and the segment's figures."""
    cfg = cfg or FlowDirectionConfig()
    side = tile_side(cells.sparkSession)
    grouped = cut(segment_cells(cells))
    stats = cut(segment_stats(grouped, cfg.flat_outlet_length_weight).drop("label"))
    seeded = lookup_by_tile(grouped, stats.select("raster_id", "seg", "strength"), "seg", side)
    start = F.round(F.col("strength") * F.lit(-float(cfg.flat_outlet_distance_weight) * COST_UNIT)).cast("bigint")
    near = region_distances(seeded.select(
        *KEYS, F.col("label").alias("region"), F.when(F.col("seg").isNotNull(), start).alias("cost"), F.col("seg").alias("source"),
    ))
    return lookup_by_tile(cut(near.select(*KEYS, F.col("source").alias("seg_of"), "dist")), stats.withColumnRenamed("seg", "seg_of"), "seg_of", side)


def assign_segments(cells: DataFrame, cfg: FlowDirectionConfig | None = None) -> DataFrame:
    """Give region cells (``label``, ``drop``) the segment minimising distance minus
    weighted strength: adds ``seg_of``, ``dist`` and the segment's figures."""
    return cells.join(nearest_segments(cells, cfg), KEYS, "left")


def flat_directions(g: DataFrame, cfg: FlowDirectionConfig | None = None) -> DataFrame:
    """``flat_direction`` of cells with ``dist`` > 0: best scored neighbour of the same
    segment that is nearer to it; -1 where no score is positive.  ``g`` must be dense."""
    cfg = cfg or FlowDirectionConfig()
    w = [np.float32(x) for x in (cfg.slope_weight, cfg.flat_escape_weight, cfg.outlet_proximity_weight, cfg.continuity_weight)]

    def choose(table, near, own):
        segment, dist = kernels.layer(table, "seg_of", -1), kernels.layer(table, "dist", 0)
        texture, strength, goal_r, goal_c, goal = (
            kernels.layer(table, c, np.nan).astype(np.float64) for c in ("texture_height", "strength", "_goal_r", "_goal_c", "_goal"))
        nearer = (near >= 0) & (segment >= 0) & (segment[near] == segment) & (dist[near] < dist)
        steps = np.array(D8_STEPS, dtype=np.float64)[:, :, None]
        single = lambda score: np.where(nearer, score, 0).astype(np.float32)

        def scaled(score):
            top = score.max(axis=0)
            return np.where(top > 0, score.astype(np.float64) / top, 0).astype(np.float32)

        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (steps[:, 0] * goal_r + steps[:, 1] * goal_c) / (np.hypot(steps[:, 0], steps[:, 1]) * goal)
            total = scaled(single(np.fmax(0.0, texture - texture[near]))) * w[0]
            total = total + single((dist - dist[near]) / np.maximum(dist, 1)) * w[1]
            total = total + scaled(single(strength / (1.0 + dist[near]))) * w[2]
            total = total + scaled(single(np.where(goal > 0, np.fmax(0.0, cosine), 0.0))) * w[3]
        found = (dist > 0) & (total.max(axis=0) > 0)
        return {"flat_direction": pa.array(np.where(found, total.argmax(axis=0), -1), pa.int32())}

    goal_r, goal_c = F.col("center_row") - F.col("row"), F.col("center_col") - F.col("col")
    goals = g.select("*", goal_r.alias("_goal_r"), goal_c.alias("_goal_c"), F.hypot(goal_r, goal_c).alias("_goal"))
    return from_neighbors(goals, choose, flat_direction="integer").drop("_goal_r", "_goal_c", "_goal")
