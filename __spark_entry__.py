"""Registered queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles
from hydrospark.config import (
    ChannelExtractConfig, FlowDirectionConfig, PipelineConfig, PreprocessConfig,
)
from hydrospark.operators import (
    channels, components, conditioning, flooding, flowgraph, focal, grid, regions, render, routing,
)
from hydrospark.operators.iterative_fill import iterative_fill
from hydrospark.plans.pipeline import extract_channels, run_pipeline
from hydrospark.schema import cell_id
from hydrospark.scratch import cut, scratch_dir
from hydrospark.sources import stages
from hydrospark.sources import table_rasters as tr
from hydrospark.sources.rasters import as_mask
from hydrospark.tiling import attach

try:
    import corpus_pipeline
    from hydrospark.llm import queries as text_queries
except ImportError:  # the text operators are a part of their own
    corpus_pipeline = text_queries = None

TESTDATA = Path("/root/testdata")
THRESHOLD = 20

Query = Callable[[SparkSession, str], DataFrame]
CELL = ["row", "col"]


def _cells(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Row, column and the named columns; floating values rounded as doubles."""
    return df.select(*CELL, *_rounded(df, names, digits))


def _rounded(df: DataFrame, names, digits: int = 6):
    kinds = dict(df.dtypes)
    return [
        F.round(F.col(n).cast("double"), digits).alias(n) if kinds[n] in ("float", "double") else F.col(n) for n in names
    ]


def _masked(raster, spark: SparkSession, sf: str) -> DataFrame:
    cells = cut(raster(spark, sf))
    return grid.apply_mask(cells, tr.mask_events(spark, sf, cells))


def _fives(spark, sf):
    return tr.dem_orders(spark, sf).withColumn("fives", F.col("valid") & (F.col("height") % 5 == 0))


def _labelled_blocks(spark, sf):
    return cut(components.flat_regions(tr.dem_blocks(spark, sf)))


def _valley_accumulated(spark, sf, raster=None):
    directed = focal.d8_strict(raster if raster is not None else tr.dem_valley(spark, sf))
    return flowgraph.flow_accumulation(directed)


def _valley_channels(spark, sf):
    return channels.channel_threshold(_valley_accumulated(spark, sf), THRESHOLD)


def channel_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Which valley cells drain at least ``THRESHOLD`` cells."""
    return _cells(_valley_channels(spark, sf).where("channel = 1"), "accumulation")


def neighbor_gather(spark, sf):
    around = grid.with_neighbors(tr.dem_orders(spark, sf), ["height"])
    flat = around.select(*CELL, *[F.col(f"n{i}.height").alias(f"n{i}") for i in range(8)])
    return _cells(flat, *[f"n{i}" for i in range(8)])


def _tall(spark, sf):
    return tr.dem_orders(spark, sf).withColumn("valid", F.col("valid") & (F.col("height") > 240))


def upsample_mask(spark, sf):
    tall = cut(_tall(spark, sf))
    coarse = grid.block_mean(tall, 4).select("raster_id", *CELL, F.col("valid").alias("mask"))
    return _cells(grid.upsample_mask(coarse, tall, 4), "mask")


def scale_area(spark, sf):
    scales = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").cast("int").alias("scale")).distinct()
    return scales.select("scale", grid.scale_area(2048, F.col("scale")).alias("area"))


def connected(spark, sf):
    labelled = cut(components.connected_components(_fives(spark, sf), "fives").where("label IS NOT NULL"))
    return labelled.join(components.scan_order_ids(labelled), ["raster_id", "label"]).select(*CELL, "component")


def component_sizes(spark, sf):
    sizes = components.component_sizes(components.connected_components(_fives(spark, sf), "fives"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


def flat_outlets(spark, sf):
    found = regions.flat_outlets(_labelled_blocks(spark, sf))
    return found.select("label", "size", "has_lower", *_rounded(found, ["spill"]), "anchor")


def outlet_segments(spark, sf):
    found = regions.outlet_segments(tr.dem_blocks(spark, sf))
    return found.select("label", "segment", *_rounded(found, ["strength", "center_row", "center_col"]), "n_cells")


def assign_segments(spark, sf):
    drops = cut(focal.outlet_drop(_labelled_blocks(spark, sf)).where("valid"))
    placed = regions.assign_segments(drops)
    return _cells(placed, "label", "seg_of", "dist", "strength")


def flat_directions(spark, sf):
    drops = cut(focal.outlet_drop(_labelled_blocks(spark, sf)))
    placed = regions.assign_segments(drops.where("valid")).drop("height", "valid", "label", "drop")
    dense = drops.select("raster_id", *CELL, F.col("height").alias("texture_height")).join(placed, ["raster_id", *CELL], "left")
    return _cells(regions.flat_directions(dense), "flat_direction")


def fill_audit(spark, sf):
    audit = conditioning.fill_audit(flooding.fill_depressions(tr.dem_blocks(spark, sf)))
    return audit.select("changed", *_rounded(audit, ["max_depth", "mean_depth"]))


def fill_policy(spark, sf):
    sizes = tr.dem_orders(spark, sf).groupBy("raster_id").agg(F.count("*").alias("pixels"))
    how, _ = conditioning.fill_policy(PreprocessConfig())
    return sizes.select(F.lit(how).alias("algorithm"), "pixels")


def fill_sinks(spark, sf):
    """All of the operator's rounds, with how many changed something and whether that was the end."""
    filled, per_raster = iterative_fill(tr.dem_blocks(spark, sf))
    return _cells(attach(filled, per_raster), "height", "rounds", "finished", digits=4)


def _measures(**frames: DataFrame) -> DataFrame:
    """One row per name: the number each one-column frame of one row holds."""
    rows = [df.select(F.lit(name).alias("measure"), F.col(df.columns[0]).cast("long").alias("value")) for name, df in frames.items()]
    out = rows[0]
    for one in rows[1:]:
        out = out.unionByName(one)
    return out


def flow_ends(spark, sf):
    """What every complete routing obeys: no valid cell without a direction, none on a cycle, and what arrives at
    the ends is all cells."""
    routed = cut(routing.flow_direction(tr.dem_blocks(spark, sf)))
    done = flowgraph.flow_accumulation(routed)
    ends = flowgraph.flow_terminal(routed).where("kind = 'exit'").select("raster_id", "terminal").distinct()
    at = done.select("raster_id", cell_id().alias("terminal"), "accumulation").join(ends, ["raster_id", "terminal"])
    return _measures(
        open_cells=routed.agg(F.count_if(F.col("valid") & (F.col("direction") < 0))), arrived=at.agg(F.sum("accumulation")),
        on_cycles=flowgraph.flow_cycles(routed).agg(F.count("*")))


def cycles_left(spark, sf):
    """Cells on cycles before and after the repair."""
    heights = tr.dem_orders(spark, sf)
    arrows = cut(heights.join(tr.arrows(spark, sf).withColumn("raster_id", F.lit("orders")).hint("merge"), ["raster_id", *CELL]))
    count = lambda g: flowgraph.flow_cycles(g).agg(F.count("*"))
    return _measures(before=count(arrows), after=count(cut(routing.repair_cycles(arrows))))


def component_exit(spark, sf):
    open_cells = routing.unresolved_components(routing.resolve_flats(focal.d8_strict(tr.dem_blocks(spark, sf))))
    _, picks = routing.component_exit(cut(open_cells))
    return picks.select("catch", "row", "col", "dir", "reach", "nxt")


def route_components(spark, sf):
    open_cells = routing.unresolved_components(routing.resolve_flats(focal.d8_strict(tr.dem_blocks(spark, sf))))
    return _cells(routing.route_components(*routing.component_exit(cut(open_cells))), "routed")


def resolve_flats(spark, sf):
    return _cells(routing.resolve_flats(focal.d8_strict(tr.dem_blocks(spark, sf))), "direction")


def resolve_residual(spark, sf):
    return _cells(routing.resolve_residual(focal.d8_strict(tr.dem_blocks(spark, sf))), "direction")


def repair_cycles(spark, sf):
    heights = tr.dem_orders(spark, sf)
    arrows = tr.arrows(spark, sf).withColumn("raster_id", F.lit("orders"))
    return _cells(routing.repair_cycles(heights.join(arrows.hint("merge"), ["raster_id", *CELL])), "direction")


def trim_edges(spark, sf):
    return _cells(channels.trim_edges(grid.edge_contact(_valley_channels(spark, sf))), "channel")


def channel_mask(spark, sf):
    layers = _valley_accumulated(spark, sf, _masked(tr.dem_valley, spark, sf))
    return _cells(channels.channel_mask(layers, ChannelExtractConfig(THRESHOLD, 6)), "channel")


def auto_mask(spark, sf):
    cfg = PreprocessConfig(auto_mask_min_region_size=64)
    return _cells(conditioning.auto_mask(_masked(tr.dem_valley, spark, sf), cfg), "auto_mask")


def preprocess(spark, sf):
    cells = cut(tr.dem_orders(spark, sf))
    cfg = PreprocessConfig(fill_sink_algorithm="priority_flood", use_mask=True)
    done = conditioning.preprocess(cells, cfg, tr.mask_events(spark, sf, cells))
    return _cells(done, "height", "valid", "texture_height", "fill_depth", digits=4)


def channels_end_to_end(spark, sf):
    cfg = PipelineConfig(
        preprocess=PreprocessConfig(fill_sink_algorithm="priority_flood"),
        flow_direction=FlowDirectionConfig(), channel_extract=ChannelExtractConfig(THRESHOLD, 2))
    return _cells(extract_channels(tr.dem_valley(spark, sf), cfg), "direction", "accumulation", "channel")


def _run_dir(spark) -> str:
    return f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}"


def write_stage(spark, sf):
    return _cells(stages.write_stage(tr.dem_orders(spark, sf), _run_dir(spark), "io"), "height", "valid")


def stage_resume(spark, sf):
    """Preprocess in one run, routing in a second one that reuses the finished stages."""
    run_dir = _run_dir(spark)
    cfg = PipelineConfig(preprocess=PreprocessConfig(fill_sink_algorithm="priority_flood"))
    cells = tr.dem_valley(spark, sf)
    run_pipeline(cells, run_dir, cfg, end_stage="preprocess")
    run_pipeline(cells, run_dir, cfg, end_stage="flow_direction")
    return _cells(stages.read_stage(spark, run_dir, "flow_direction"), "direction")


def render_input(spark, sf):
    cells = cut(tr.dem_orders(spark, sf))
    return _cells(render.render_input(cells, tr.mask_events(spark, sf, cells)), *"rgba")


def composite(spark, sf):
    cells = cut(tr.dem_orders(spark, sf))
    shown = render.render_mask(tr.mask_events(spark, sf, cells), "mask")
    gray = cells.select("raster_id", *CELL, F.col("height").cast("int").alias("gray"))
    return _cells(render.composite({"input_preview": gray, "user_mask": shown}), *"rgba")


def layer_catalog(spark, sf):
    cells = cut(tr.dem_orders(spark, sf))
    inputs = cells.join(as_mask(cells), ["raster_id", *CELL])
    found = stages.layer_catalog({"io": inputs, "flow_direction": focal.d8_strict(cells)})
    return found.drop("raster_id", "position")


def cycle_guard(spark, sf):
    """Number of cells that run into a cycle; the guard raises when it is not 0."""
    return flowgraph.flow_terminal(tr.arrows(spark, sf)).agg(F.count_if(F.col("kind") == "cycle").alias("stuck"))


def multi_raster_accumulation(spark, sf):
    done = flowgraph.flow_accumulation(focal.d8_strict(tr.dem_multi(spark, sf)))
    return done.select("raster_id", *CELL, "accumulation")


def _tiled(run: Query) -> Query:
    """The query with tiles of 16 cells and a fan of 2, so that small grids reach every level of the solvers."""
    small = {"spark.hydrospark.tileSide": "16", "spark.hydrospark.tileFan": "2"}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = {key: spark.conf.get(key, None) for key in small}
        for key, value in small.items():
            spark.conf.set(key, value)
        try:
            return run(spark, sf_dir)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return query


#: Queries registered once more with small tiles, on the same SQL.
TILED = ["connected_components", "flat_regions", "fill_depressions", "flow_accumulation", "flow_cycles"]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "cells_from_table": lambda s, d: _cells(tr.sparse_orders(s, d), "height"),
        "densify": lambda s, d: _cells(tr.dem_orders(s, d), "height", "valid"),
        "neighbor_gather": neighbor_gather,
        "height_mapping": lambda s, d: _cells(grid.height_mapping(tr.dem_orders(s, d), "dark_is_high"), "height"),
        "valid_mask": lambda s, d: _cells(grid.valid_mask(tr.dem_orders(s, d), True, 30.0), "valid"),
        "apply_mask": lambda s, d: _cells(_masked(tr.dem_orders, s, d), "valid"),
        "roi_crop": lambda s, d: _cells(grid.crop(_tall(s, d)), "height", "valid"),
        "block_mean": lambda s, d: _cells(grid.block_mean(_masked(tr.dem_orders, s, d), 4), "height", "valid"),
        "analysis_scale": lambda s, d: grid.analysis_scale(tr.dem_orders(s, d)).drop("raster_id"),
        "upsample_mask": upsample_mask,
        "scale_area": scale_area,
        "overview": lambda s, d: _cells(grid.overview(_masked(tr.dem_orders, s, d), 50), "height", "valid"),
        "overview_codes": lambda s, d: _cells(
            grid.overview(focal.d8_strict(tr.dem_orders(s, d)), 50, means=(), codes={"direction": list(range(-1, 8))}), "direction"),
        "overview_colors": lambda s, d: _cells(
            grid.overview(render.render_direction(focal.d8_strict(tr.dem_orders(s, d))), 50, means=tuple("rgb")), *"rgb", digits=3),
        "pyramid": lambda s, d: (lambda p: p.select("level", "scale", *CELL, *_rounded(p, ["height", "valid"], 3)))(
            grid.pyramid(_masked(tr.dem_orders, s, d), 50)),
        "edge_contact": lambda s, d: _cells(grid.edge_contact(_masked(tr.dem_orders, s, d)), "edge_contact"),
        "border_values": lambda s, d: _cells(grid.border_values(_masked(tr.dem_orders, s, d)), "height"),
        "box_smooth": lambda s, d: _cells(focal.box_smooth(_masked(tr.dem_orders, s, d), 5), "height", digits=4),
        "gradient_score": lambda s, d: _cells(focal.gradient_score(_masked(tr.dem_orders, s, d)), "gradient_score"),
        "variance_score": lambda s, d: _cells(focal.variance_score(_masked(tr.dem_orders, s, d)), "variance_score", digits=5),
        "sink_pass": lambda s, d: _cells(focal.sink_pass(_masked(tr.dem_orders, s, d)), "height", "lifted", digits=4),
        "d8_strict": lambda s, d: _cells(focal.d8_strict(_masked(tr.dem_orders, s, d)), "direction"),
        "outlet_drop": lambda s, d: _cells(
            focal.outlet_drop(_labelled_blocks(s, d)).withColumnRenamed("drop", "drop_height"), "drop_height"),
        "connected_components": connected,
        "component_sizes": component_sizes,
        "flat_regions": lambda s, d: _cells(_labelled_blocks(s, d).where("valid"), "label"),
        "border_connected": lambda s, d: _cells(
            components.border_connected(tr.dem_orders(s, d), "valid AND height % 3 = 0"), "connected"),
        "filter_components": lambda s, d: _cells(components.filter_components(_fives(s, d), "fives", True, 4), "fives"),
        "flat_outlets": flat_outlets,
        "repair_closed_flats": lambda s, d: _cells(
            regions.repair_closed_flats(tr.dem_blocks(s, d)), "height", "repaired", digits=4),
        "outlet_segments": outlet_segments,
        "assign_segments": assign_segments,
        "flat_directions": flat_directions,
        "auto_mask": auto_mask,
        "fill_sinks_iterative": fill_sinks,
        "fill_depressions": lambda s, d: _cells(flooding.fill_depressions(tr.dem_blocks(s, d)), "height", "fill_depth"),
        "fill_depressions_capped": lambda s, d: _cells(flooding.fill_depressions(tr.dem_blocks(s, d), 2.0), "height"),
        "fill_audit": fill_audit,
        "fill_policy": fill_policy,
        "preprocess": preprocess,
        "flow_edges": lambda s, d: flowgraph.flow_edges(focal.d8_strict(tr.dem_orders(s, d))).drop("raster_id"),
        "flow_terminal": lambda s, d: _cells(flowgraph.flow_terminal(focal.d8_strict(tr.dem_valley(s, d))), "terminal", "hops"),
        "flow_kind": lambda s, d: _cells(flowgraph.flow_terminal(tr.arrows(s, d)), "kind"),
        "unresolved_components": lambda s, d: _cells(
            routing.unresolved_components(focal.d8_strict(tr.dem_blocks(s, d))).where("comp IS NOT NULL"), "comp"),
        "component_exit": component_exit,
        "route_components": route_components,
        "resolve_flats": resolve_flats,
        "resolve_residual": resolve_residual,
        "flow_cycles": lambda s, d: _cells(flowgraph.flow_cycles(tr.arrows(s, d)), "cycle"),
        "repair_cycles": repair_cycles,
        "cycles_left": cycles_left,
        "flow_ends": flow_ends,
        "flow_direction": lambda s, d: _cells(routing.flow_direction(tr.dem_blocks(s, d)), "direction"),
        "flow_accumulation": lambda s, d: _cells(_valley_accumulated(s, d), "accumulation"),
        "flow_accumulation_noise": lambda s, d: _cells(_valley_accumulated(s, d, tr.dem_orders(s, d)), "accumulation"),
        "flow_accumulation_multi": multi_raster_accumulation,
        "cycle_guard": cycle_guard,
        "channel_cells": channel_cells,
        "channel_threshold": lambda s, d: _cells(_valley_channels(s, d), "channel"),
        "trim_edges": trim_edges,
        "filter_short": lambda s, d: _cells(channels.filter_short(_valley_channels(s, d), 6), "channel"),
        "channel_mask": channel_mask,
        "channels_end_to_end": channels_end_to_end,
        "terrain_stats": lambda s, d: (lambda t: t.select(
            "n_rows", "n_cols", *_rounded(t, ["min_height", "max_height", "mean_height"])))(
                render.terrain_stats(_masked(tr.dem_orders, s, d))),
        "render_terrain": lambda s, d: _cells(render.render_terrain(_masked(tr.dem_orders, s, d)), "gray"),
        "render_fill_depth": lambda s, d: _cells(render.render_fill_depth(flooding.fill_depressions(tr.dem_blocks(s, d))), "gray"),
        "render_direction": lambda s, d: _cells(render.render_direction(focal.d8_strict(tr.dem_orders(s, d))), *"rgb"),
        "render_accumulation": lambda s, d: _cells(render.render_accumulation(_valley_accumulated(s, d)), "gray"),
        "render_mask": lambda s, d: _cells(render.render_mask(_masked(tr.dem_orders, s, d)), "gray"),
        "render_channel": lambda s, d: _cells(render.render_channel(_valley_channels(s, d)), *"rgba"),
        "render_input": render_input,
        "composite": composite,
        "direction_counts": lambda s, d: render.direction_counts(focal.d8_strict(tr.dem_orders(s, d))).drop("raster_id"),
        "layer_catalog": layer_catalog,
        "write_stage": write_stage,
        "stage_resume": stage_resume,
    }
    found |= {f"{name}_tiled": _tiled(found[name]) for name in TILED}
    if text_queries:
        found |= text_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query, where SQL can express it on whole tables."""
    found = dict(oracles.ORACLES)
    found |= {f"{name}_tiled": found[name] for name in TILED}
    if text_queries:
        found |= text_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def entry(spark: SparkSession) -> DataFrame:
    return queries()["channel_cells"](spark, str(TESTDATA / "sf0.001"))
