"""Single-direction flow: strict D8, flat routing, residual repair and cycle repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.config import FlowDirectionConfig
from hydrospark.operators.components import connected_components, flat_regions
from hydrospark.operators.exits import catchments, exit_forest, exit_ways, first_choices
from hydrospark.operators.flowgraph import flow_cycles
from hydrospark.operators.focal import d8_strict, outlet_drop
from hydrospark.operators.geodesic import region_distances
from hydrospark.operators.regions import flat_directions, nearest_segments
from hydrospark.schema import KEYS, cell_id
from hydrospark.scratch import cut
from hydrospark.tiling import lookup_by_tile, tile_side


def resolve_flats(g: DataFrame, cfg: FlowDirectionConfig | None = None) -> DataFrame:
    """Route unresolved cells of flat regions that have an outlet towards their segments."""
    cfg = cfg or FlowDirectionConfig()
    side = tile_side(g.sparkSession)
    g = cut(g)
    drops = cut(outlet_drop(flat_regions(g)))
    open_flats = drops.where("label IS NOT NULL").groupBy("raster_id", "label").agg(
        F.count("*").alias("n"), F.bool_or(F.col("direction") == -1).alias("dry"), F.bool_or(F.col("drop") > 0).alias("outlet"),
    ).where("n > 1 AND dry AND outlet").select("raster_id", "label", F.lit(True).alias("_open"))
    members = cut(lookup_by_tile(drops.select(*KEYS, "label", "drop"), open_flats, "label", side).where("_open").drop("_open"))
    if members.isEmpty():
        return g
    placed = nearest_segments(members, cfg).select(*KEYS, "seg_of", "dist", "strength", "center_row", "center_col")
    base = g if "texture_height" in g.columns else g.withColumn("texture_height", F.lit(0.0).cast("float"))
    routed = flat_directions(base.join(placed, KEYS, "left"), cfg)
    chosen = F.when((F.col("direction") == -1) & (F.col("flat_direction") >= 0), F.col("flat_direction"))
    return routed.withColumn("direction", F.coalesce(chosen, F.col("direction"))).select(*g.columns)


def unresolved_components(g: DataFrame, out: str = "comp") -> DataFrame:
    """Label the 8-connected valid cells without a direction."""
    return connected_components(g, F.col("valid") & (F.col("direction") < 0), out=out)


def component_exit(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each component (``comp``) would let its water out on the given directions.

    Returns the cells with ``catch`` and ``hops``, and one row per component: ``catch``, anchor
    ``row``/``col``, exit ``dir``, ``reach`` (upstream steps absorbed into the component) and
    ``nxt`` (component the exit drains into, if any).

    Preference: a neighbour of the component whose water does not come back; the grid or
    mask border; the same two after absorbing the inflowing cells step by step.
    """
    cells = cut(catchments(g))
    return cells, cut(first_choices(exit_ways(cells)))


def route_components(cells: DataFrame, picks: DataFrame) -> DataFrame:
    """New directions (keys, ``routed``) of the picked components and their absorbed
    cells: the anchor takes the exit, the others the neighbour nearer to the anchor
    with the smallest rise, then the lowest code."""
    side = tile_side(cells.sparkSession)
    held = lookup_by_tile(
        cells.select(*KEYS, "height", "catch", "hops"),
        picks.select("raster_id", "catch", cell_id().alias("anchor"), "dir", "reach"), "catch", side,
    ).where("hops <= reach")
    start = cell_id() == F.col("anchor")
    zero = F.lit(0).cast("bigint")
    members = cut(held.select(
        *KEYS, F.col("catch").alias("region"), F.when(start, zero).alias("cost"), F.when(start, zero).alias("source"),
        "height", F.when(start, F.col("dir")).alias("dir")))
    near = region_distances(members.drop("dir"), toward=True)
    ends = members.where("dir IS NOT NULL").select(*KEYS, "dir")
    return near.join(ends, KEYS, "left").select(*KEYS, F.coalesce("dir", F.when(F.col("toward") >= 0, F.col("toward"))).cast("int").alias("routed"))


def _drained(g: DataFrame) -> DataFrame:
    """Directions with every component (``comp``) led out: one trace, one exit each, one rewrite of their cells."""
    cells = cut(catchments(g))
    routed = route_components(cells, exit_forest(exit_ways(cells)))
    return g.join(routed, KEYS, "left").withColumn("direction", F.coalesce("routed", "direction")).drop("routed")


def resolve_residual(g: DataFrame) -> DataFrame:
    """Give every remaining unresolved component an exit; exits of different components form no loop."""
    columns = g.columns
    g, left = cut(unresolved_components(g), cells=F.count_if(F.col("comp").isNotNull()))
    return (_drained(g) if left["cells"] else g).select(*columns)


def repair_cycles(g: DataFrame) -> DataFrame:
    """Break all flow cycles: each is a component that gets an exit.

    Only catchments that hold a cycle take part, and since their exits form no loop, one pass leaves none.
    """
    columns = g.columns
    g = cut(g)
    loops, seen = cut(flow_cycles(g), n=F.count("*"))
    if not seen["n"]:
        return g
    return _drained(cut(g.join(loops.withColumnRenamed("cycle", "comp"), KEYS, "left"))).select(*columns)


def flow_direction(g: DataFrame, cfg: FlowDirectionConfig | None = None) -> DataFrame:
    """Full D8 routing: strict pass, flats, residual components, cycle repair."""
    return repair_cycles(resolve_residual(resolve_flats(d8_strict(g), cfg)))

