"""Terrain conditioning: auto mask, sink filling and the preprocess composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.config import PreprocessConfig
from hydrospark.functions.quantiles import exact_quantile
from hydrospark.operators import grid
from hydrospark.operators.components import border_connected, filter_components
from hydrospark.operators.flooding import fill_depressions
from hydrospark.operators.focal import box_smooth, gradient_score, variance_score
from hydrospark.operators.iterative_fill import MAX_FILL_ROUNDS, iterative_fill
from hydrospark.schema import KEYS
from hydrospark.scratch import cut
from hydrospark.tiling import attach

INVALID_SCORE = 0.58  # fixed value


def _auto_mask_core(g: DataFrame, border_sensitivity: float, texture_sensitivity: float) -> DataFrame:
    """``auto_mask`` on one resolution; ``g`` has ``min_region`` (cells) per raster."""
    # Without valid border cells every valid cell counts, so the median must not gather a raster.
    border = cut(grid.border_values(g.select(*KEYS, "height", "valid")))
    spread = F.stddev_pop(F.col("height").cast("double"))
    model = border.groupBy("raster_id").agg(F.when(spread <= 1e-6, 1.0).otherwise(spread).alias("_std")).join(
        exact_quantile(border, "height", 0.5, "_mid"), "raster_id")
    reach = F.greatest(F.lit(1.0), F.col("_std") * F.lit(2.25 / max(border_sensitivity, 0.1)))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    weight = F.lit(float(texture_sensitivity))
    scored = attach(variance_score(gradient_score(g)), model)
    alike = clip(1.0 - F.abs(F.col("height").cast("double") - F.col("_mid")) / reach).cast("float").cast("double")
    score = 0.45 * alike + 0.30 * clip(F.col("gradient_score") * weight) + 0.25 * clip(F.col("variance_score") * weight)
    judged = scored.withColumn("_cand", F.coalesce(F.col("valid") & (score >= INVALID_SCORE), F.lit(False))).select(
        *g.columns, "_cand")
    joined = border_connected(judged, "_cand", "_out")
    masked = joined.withColumn("auto_mask", F.col("valid") & ~F.col("_out")).drop("_cand", "_out")
    kept = filter_components(masked, "auto_mask", True, F.col("min_region"))
    holes = F.greatest(F.lit(32), F.floor(F.col("min_region") / 2).cast("int"))
    return filter_components(kept, "auto_mask", False, holes)


def auto_mask(g: DataFrame, cfg: PreprocessConfig | None = None, scale: int = 1) -> DataFrame:
    """Adds ``auto_mask``: valid cells that do not look like border background.

    Judged at full resolution, whatever the raster's size; a caller may ask for block means
    of ``scale`` cells instead.
    """
    cfg = cfg or PreprocessConfig()
    g = cut(g)
    smallest = grid.scale_area(cfg.auto_mask_min_region_size, scale)
    coarse = grid.block_mean(g, scale).withColumn("min_region", smallest)
    if scale > 1:
        coarse = grid.densify(coarse)
    judged = _auto_mask_core(cut(coarse), cfg.auto_mask_border_sensitivity, cfg.auto_mask_texture_sensitivity)
    out = grid.upsample_mask(judged.select(*KEYS, "auto_mask"), g, scale, "auto_mask")
    return out.withColumn("auto_mask", F.coalesce("auto_mask", F.lit(False)) & F.col("valid"))


def fill_sinks_iterative(g: DataFrame, max_iterations: int = MAX_FILL_ROUNDS) -> tuple[DataFrame, int, bool]:
    """The iterative fill of all rasters: the cells, the most rounds any raster took, and whether all finished."""
    cells, per_raster = iterative_fill(g, max_iterations)
    seen = per_raster.agg(F.max("rounds").alias("rounds"), F.coalesce(F.bool_and("finished"), F.lit(True)).alias("finished")).first()
    return cells, seen["rounds"] or 0, seen["finished"]


def fill_policy(cfg: PreprocessConfig) -> tuple[str, float | None]:
    """Which fill to run, and its depth cap.  ``auto`` is the full flood at every size, so
    that an answer never depends on how large a raster is."""
    if not cfg.fill_sinks:
        return "none", None
    cap = cfg.max_fill_depth
    if cfg.deep_basin_mode == "preserve" and cap is None:
        cap = 0.0
    return ("legacy", None) if cfg.fill_sink_algorithm == "legacy" else ("priority_flood", cap)


def fill_depth(before: DataFrame, after: DataFrame) -> DataFrame:
    """``fill_depth`` per cell: how far a fill raised it (0 on invalid cells)."""
    zero = F.lit(0.0).cast("float")
    rise = F.greatest((F.col("height") - F.col("_before")).cast("float"), zero)
    return after.join(before.select(*KEYS, F.col("height").alias("_before")), KEYS).withColumn(
        "fill_depth", F.when(F.col("valid"), rise).otherwise(zero)).drop("_before")


def fill_audit(g: DataFrame) -> DataFrame:
    """Changed cells, deepest and mean fill per raster."""
    deep = F.col("fill_depth") > 0
    depth = F.col("fill_depth").cast("double")
    return g.groupBy("raster_id").agg(
        F.count_if(deep).alias("changed"),
        F.max(depth).alias("max_depth"),
        F.coalesce(F.avg(F.when(deep, depth)), F.lit(0.0)).alias("mean_depth"),
    )


def _filled(work: DataFrame, cfg: PreprocessConfig) -> DataFrame:
    how, cap = fill_policy(cfg)
    if how == "none":
        return work.withColumn("fill_depth", F.lit(0.0).cast("float"))
    work = cut(work)
    if how == "priority_flood":
        return fill_depressions(work, cap)
    after, per_raster = iterative_fill(work, cfg.max_fill_rounds)
    per_raster = per_raster.withColumnsRenamed({"rounds": "fill_rounds", "finished": "fill_finished"})
    return attach(fill_depth(work, after), per_raster)


def preprocess(g: DataFrame, cfg: PreprocessConfig | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Nodata, height mapping, user mask, auto mask, smoothing and filling.

    Returns the cells with ``height`` (filled), ``valid``, ``texture_height`` (smoothed,
    before filling), ``fill_depth`` and, when it was used, ``auto_mask``.  After an iterative fill
    also ``fill_rounds`` and ``fill_finished`` of the raster: unfinished heights say so.
    """
    cfg = cfg or PreprocessConfig()
    cells = grid.height_mapping(grid.valid_mask(g, cfg.preserve_nodata, cfg.nodata_value), cfg.height_mapping)
    if cfg.use_mask:
        if mask is None:
            raise ValueError("use_mask needs a mask")
        cells = grid.apply_mask(cells, mask)
    if cfg.use_auto_mask:
        cells = auto_mask(cells, cfg)
        cells = cells.withColumn("valid", F.col("valid") & F.col("auto_mask"))
    inside, outside = grid.split_roi(cut(cells), cfg)
    if cfg.smooth:
        inside = box_smooth(inside, cfg.smooth_kernel_size)
    worked = _filled(inside.withColumn("texture_height", F.col("height")), cfg)
    rest = outside.withColumn("texture_height", F.col("height")).withColumn("fill_depth", F.lit(0.0).cast("float"))
    return worked.unionByName(rest, allowMissingColumns=True)
