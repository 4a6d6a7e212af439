"""Where closed components let their water out: a graph with one node per component.

Cells are traced once.  What is left of them is one row per pair of adjacent catchments,
the best way from one to the other; all rounds run on those rows, and the cells are
written once, when every component has its exit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.grouped import map_groups
from hydrospark.operators.flowgraph import flow_terminal
from hydrospark.operators.grid import from_neighbors
from hydrospark.schema import cell_id
from hydrospark.scratch import cut
from hydrospark.tiling import attach, lookup_salted

OUTSIDE = -1  # node that stands for everything that drains away
EVERYTHING = 2**62
WAY = ["cls", "hops", "rise", "level", "row", "col", "dir"]  # ways compare in this order


def catchments(g: DataFrame) -> DataFrame:
    """Adds ``catch`` (component each cell drains into, NULL if it leaves) and ``hops``.
    Component cells (``comp`` is set) end every trace."""
    traced = cut(flow_terminal(g.withColumn("direction", F.when(F.col("comp").isNull(), F.col("direction")).otherwise(-1))))
    ends = traced.where("comp IS NOT NULL").select("raster_id", cell_id().alias("terminal"), F.col("comp").alias("catch"))
    return lookup_salted(traced.drop("direction", "kind"), ends, ["raster_id", "terminal"], F.struct("row", "col")).drop("terminal")


def exit_ways(cells: DataFrame) -> DataFrame:
    """The best way out of each component towards each adjacent catchment.

    One row per (``c``, ``nxt``).  Ways from a component's own cells come first, by the smallest rise;
    then the grid or mask border; then ways from cells upstream, the fewest steps first; then a
    border that only upstream cells touch.  Each tile hands on its best way for every pair.
    """
    def best_of_tile(table, near, own):
        valid, height, catch, hops = (kernels.layer(table, c, fill) for c, fill in (
            ("valid", False), ("height", np.nan), ("catch", OUTSIDE), ("hops", 0)))
        height = height.astype(np.float64)
        inside = valid[near] & (near >= 0)
        to = np.where(inside, catch[near], OUTSIDE)
        # A way leads into another catchment, or off the grid or mask; ids are never negative.
        at = np.nonzero(own & valid & (catch >= 0) & (~inside | (to != catch)))
        d, cell = at
        border, upstream = ~inside[at], hops[cell] != 0
        level = np.where(border, 0.0, height[near[at]])
        rise = np.where(border, 0.0, level - height[cell])
        found = {
            "c": catch[cell], "nxt": to[at], "cls": border + 2 * upstream, "hops": np.where(border, 0, hops[cell]),
            "rise": rise, "level": level, "row": kernels.layer(table, "row", 0)[cell], "col": kernels.layer(table, "col", 0)[cell], "dir": d}
        # NULL heights come first, as they do in Spark's order.
        key = lambda name: np.where(np.isnan(found[name]), -np.inf, found[name]) if name in ("rise", "level") else found[name]
        order = np.lexsort([key(name) for name in [*WAY[::-1], "nxt", "c"]])
        first = np.ones(len(order), dtype=bool)
        c, nxt = found["c"][order], found["nxt"][order]
        first[1:] = (c[1:] != c[:-1]) | (nxt[1:] != nxt[:-1])
        keep = order[first]
        kinds = {"cls": pa.int32(), "row": pa.int32(), "col": pa.int32(), "dir": pa.int32(), "rise": pa.float64(), "level": pa.float64()}
        return pa.table({k: pa.array(v[keep], kinds.get(k, pa.int64()), from_pandas=True) for k, v in found.items()})

    found = from_neighbors(
        cells.select("raster_id", "row", "col", "height", "valid", "catch", "hops"), best_of_tile, own_columns=False,
        c="long", nxt="long", cls="integer", hops="long", rise="double", level="double", row="integer", col="integer", dir="integer")
    return cut(found.groupBy("raster_id", "c", "nxt").agg(F.min(F.struct(*WAY)).alias("w")).select("raster_id", "c", "nxt", "w.*"))


def _reach(ways: DataFrame) -> DataFrame:
    """Chosen ways as exits: ``catch``, its anchor ``row``/``col``, ``dir``, ``reach`` (steps upstream
    that are routed anew) and ``nxt`` (NULL: the water leaves)."""
    reach = F.when(F.col("cls") == 3, F.lit(EVERYTHING)).otherwise(F.col("hops")).cast("long")
    return ways.select("raster_id", F.col("c").alias("catch"), "row", "col", "dir", reach.alias("reach"),
                       F.when(F.col("nxt") != OUTSIDE, F.col("nxt")).alias("nxt"))


def first_choices(ways: DataFrame) -> DataFrame:
    """Every component's best way, all on the same snapshot; choices may form loops."""
    best = ways.groupBy("raster_id", "c").agg(F.min(F.struct(*WAY, "nxt")).alias("w"))
    return _reach(best.select("raster_id", "c", "w.*"))


def _doubled(state: DataFrame, total: int) -> DataFrame:
    """(``id``, ``nxt``, ``high``) with every pointer moved on by its target's; OUTSIDE and unknown targets stay."""
    ahead = state.select("raster_id", F.col("id").alias("nxt"), F.col("nxt").alias("n2"), F.col("high").alias("h2"))
    return lookup_salted(state, ahead, ["raster_id", "nxt"], F.col("id"), rows=total).select(
        "raster_id", "id", F.coalesce("n2", "nxt").alias("nxt"), F.greatest("high", F.coalesce("h2", "high")).alias("high"),
        (~F.coalesce("n2", "nxt").eqNullSafe(F.col("nxt"))).alias("moved"), (F.coalesce("h2", "high") > F.col("high")).alias("grew"))


def _roots(picks: DataFrame, total: int) -> DataFrame:
    """Where the choices of groups lead: (``raster_id``, ``id``, ``root``), the root being OUTSIDE or the
    last group (scan order) of the loop that is reached."""
    start = picks.select("raster_id", F.col("g").alias("id"), F.col("ng").alias("nxt"), F.col("ng").alias("high"))
    # ``high`` is the largest group met after leaving; the last of a loop is the one that meets itself as the
    # largest.  Ids are unique, so once no maximum grows every loop has seen its own.
    state, grew = start, True
    while grew:
        state, seen = cut(_doubled(state, total), n=F.count_if("grew"))
        grew = seen["n"] > 0
    last = state.where("id = high").select("raster_id", "id", F.lit(True).alias("last"))
    state = start.join(last, ["raster_id", "id"], "left").select(
        "raster_id", "id", F.when(F.col("last"), F.col("id")).otherwise(F.col("nxt")).alias("nxt"), F.lit(0).cast("long").alias("high"))
    moved = True
    while moved:
        state, seen = cut(_doubled(state, total), n=F.count_if("moved"))
        moved = seen["n"] > 0
    return state.select("raster_id", "id", F.col("nxt").alias("root"))


def _turned(exits: DataFrame, starts: DataFrame) -> DataFrame:
    """Exits with the paths that begin at ``starts`` (``c``: a component, ``nxt``: its new next one) turned round."""
    marked = cut(starts.select("raster_id", "c").distinct())
    jump, size, grown = exits.select("raster_id", "c", "nxt"), None, marked.count()
    while grown != size:
        size = grown
        ahead = marked.join(jump, ["raster_id", "c"]).where(F.col("nxt") != OUTSIDE).select("raster_id", F.col("nxt").alias("c"))
        marked, seen = cut(marked.unionByName(ahead).distinct(), n=F.count("*"))
        grown = seen["n"]
        jump = cut(jump.join(jump.select("raster_id", F.col("c").alias("nxt"), F.col("nxt").alias("n2")), ["raster_id", "nxt"])
                   .select("raster_id", "c", F.col("n2").alias("nxt")))
    path = exits.join(marked, ["raster_id", "c"], "left_semi")
    back = path.select("raster_id", F.col("nxt").alias("c"), F.col("c").alias("nxt"))
    kept = exits.join(marked, ["raster_id", "c"], "left_anti")
    return kept.unionByName(back).unionByName(starts.select("raster_id", "c", "nxt"))


def _joined_forest(ways: DataFrame) -> DataFrame:
    """Exits (``raster_id, c, nxt``) of all components, in rounds of joins over ways.

    Groups of components, at first one each, choose in rounds; a group is named by its root,
    whose water the others' exits lead to.  It takes the root's best way to another group,
    or, where the root has none, the best of its members, and the exits between that member and
    the root are turned round.  In a loop of choices the last group (scan order) waits and is the root
    of what has joined; so at most half of the groups are left after each round.
    """
    open_, seen = cut(ways.select("raster_id", F.col("c").alias("g"), F.col("nxt").alias("ng"), "c", "nxt", *WAY), n=F.count("*"))
    exits = None
    while seen["n"]:
        rows = seen["n"]
        order = F.struct((F.col("c") != F.col("g")).alias("far"), *WAY, "c", "nxt", "ng")
        picks, chosen = cut(open_.groupBy("raster_id", "g").agg(F.min(order).alias("p")).select("raster_id", "g", "p.far", "p.c", "p.nxt", "p.ng"),
                            n=F.count("*"))
        roots = _roots(picks, chosen["n"])
        settled, found = cut(picks.join(roots.where("id <> root").select("raster_id", F.col("id").alias("g")), ["raster_id", "g"], "left_semi"),
                             far=F.count_if("far"))
        near = settled.where("NOT far").select("raster_id", "c", "nxt")
        if found["far"]:
            near = _turned(exits, settled.where("far").select("raster_id", "c", "nxt")).unionByName(near)
        elif exits is not None:
            near = near.unionByName(exits)
        exits = cut(near)
        led = lambda key: roots.select("raster_id", F.col("id").alias(key), F.col("root").alias(f"_{key}"))
        moved = lookup_salted(open_.join(led("g"), ["raster_id", "g"]).where(F.col("_g") != OUTSIDE), led("ng"), ["raster_id", "ng"], F.col("c"), rows=rows)
        moved = moved.select("raster_id", F.col("_g").alias("g"), F.coalesce("_ng", F.lit(OUTSIDE)).cast("long").alias("ng"), "c", "nxt", *WAY).where("g <> ng")
        best = F.min(F.struct((F.col("c") != F.col("g")).alias("far"), *WAY, "c", "nxt")).alias("p")
        open_, seen = cut(moved.groupBy("raster_id", "g", "ng").agg(best).select("raster_id", "g", "ng", "p.*").drop("far"), n=F.count("*"))
    return ways.select("raster_id", "c", "nxt").limit(0) if exits is None else exits


def _one_raster_forest(ways: pd.DataFrame) -> pd.DataFrame:
    """``_joined_forest`` for the ways of one raster, held in one task."""
    keys = list(zip(*(ways[name].tolist() for name in WAY)))
    pairs = list(zip(ways["c"].tolist(), ways["nxt"].tolist()))
    open_ = {pair: (False, key, *pair) for pair, key in zip(pairs, keys)}  # (group, next group): best way, far ones last
    exits = {}
    while open_:
        picks = {}
        for (g, ng), (far, key, c, nxt) in open_.items():
            picks[g] = min(picks.get(g, (True, (math.inf,))), (far, key, c, nxt, ng))
        roots = {OUTSIDE: OUTSIDE}
        for start in picks:
            path, at = {}, start
            while at not in roots and at not in path:
                path[at] = len(path)
                at = picks[at][4]
            end = roots[at] if at in roots else max(list(path)[path[at]:])
            roots.update(dict.fromkeys(path, end))
        for g, (far, _, c, nxt, _) in picks.items():
            while roots[g] != g:
                after = exits.get(c) if far else None
                exits[c] = nxt
                if after is None:
                    break
                c, nxt = after, c  # the path from the member to its root is turned round
        moved = {}
        for (g, ng), (_, key, c, nxt) in open_.items():
            g, ng = roots[g], roots[ng]
            if g not in (OUTSIDE, ng):
                way = (c != g, key, c, nxt)
                moved[g, ng] = min(moved.get((g, ng), way), way)
        open_ = moved
    return pd.DataFrame({"raster_id": ways["raster_id"].iloc[0], "c": list(exits), "nxt": list(exits.values())})


#: Ways of a raster that one task may hold; rasters with more go by joins, with the same result.
HELD_WAYS = 500_000


def exit_forest(ways: DataFrame) -> DataFrame:
    """One exit per component such that no choices form a loop (see ``_joined_forest`` for how they choose)."""
    sizes, seen = cut(ways.groupBy("raster_id").agg(F.count("*").alias("n")), large=F.count_if(F.col("n") > HELD_WAYS))
    sized = attach(ways, sizes, F.col("c"))
    few = sized.where(F.col("n") <= HELD_WAYS).drop("n")
    exits = map_groups(few, ["raster_id"], _one_raster_forest, "raster_id string, c long, nxt long")
    if seen["large"]:
        exits = exits.unionByName(_joined_forest(sized.where(F.col("n") > HELD_WAYS).drop("n")))
    return _reach(ways.join(exits, ["raster_id", "c", "nxt"]))
