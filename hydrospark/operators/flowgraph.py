"""The flow graph: downstream edges, traces, cycles and upstream counts.

Every cell has at most one downstream cell.  Tiles resolve the paths inside
themselves; only the cells where water leaves a tile ("gates", about 4/side of
all cells) take part in the iterated joins, which double their reach each round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.grouped import map_groups, map_pairs, widened
from hydrospark.operators.grid import extent
from hydrospark.schema import D8_STEPS, KEYS, TILE_KEYS, cell_id, id_col, id_row, step_col, step_row
from hydrospark.scratch import BROADCAST_ROWS, cut
from hydrospark.tiling import attach, lookup_salted, on_tile_border, tile_of, tile_side, with_tile

NO_DIRECTION = -1


def flow_edges(g: DataFrame) -> DataFrame:
    """One row per cell that drains into another grid cell: (raster_id, row, col, dst_row, dst_col)."""
    d = F.col("direction")
    moved = attach(g.where(d >= 0), extent(g)).select(
        *KEYS, "n_rows", "n_cols",
        (F.col("row") + step_row(d)).alias("dst_row"), (F.col("col") + step_col(d)).alias("dst_col"),
    )
    return moved.where(
        F.col("dst_row").between(0, F.col("n_rows") - 1) & F.col("dst_col").between(0, F.col("n_cols") - 1)
    ).drop("n_rows", "n_cols")


def _or_null(values: np.ndarray, keep: np.ndarray):
    return pd.Series(values, dtype="Int64").where(pd.Series(keep), pd.NA).array


def _tile_steps(pdf: pd.DataFrame):
    """Positions of one tile's cells: flat index, in-tile successor, leaving flag."""
    rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    code = pdf["direction"].to_numpy().astype(np.int64)
    r0, c0 = rows.min(), cols.min()
    shape = (rows.max() - r0 + 1, cols.max() - c0 + 1)
    place = kernels.paint(rows, cols, np.arange(len(rows)), r0, c0, shape, -1, np.int64)
    steps = np.array(D8_STEPS + [(0, 0)])
    to_r, to_c = rows + steps[code, 0], cols + steps[code, 1]
    inside = (to_r >= r0) & (to_r < r0 + shape[0]) & (to_c >= c0) & (to_c < c0 + shape[1])
    target = np.where(inside, place[np.where(inside, to_r - r0, 0), np.where(inside, to_c - c0, 0)], -1)
    nxt = np.where((code >= 0) & (target >= 0), target, np.arange(len(rows)))
    leaving = (code >= 0) & (target < 0)
    ids = (rows.astype(np.int64) << 32) + cols
    dst = (to_r.astype(np.int64) << 32) + to_c
    return nxt, leaving, ids, dst


def _local_paths(g: DataFrame, side: int) -> DataFrame:
    """Resolve each path up to its end inside the tile.

    Adds ``_end`` (id of the end cell), ``_hops``, ``_dst`` (id of the cell the
    end cell drains to when that lies outside the tile), ``_loop`` (smallest id of
    the in-tile cycle the path runs into) and ``_on_loop``, ``_acc``.
    """
    tiled = with_tile(g, side)
    schema = widened(tiled, _end="long", _hops="long", _dst="long", _loop="long", _on_loop="boolean", _acc="long")
    names = schema.fieldNames()

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        nxt, leaving, ids, dst = _tile_steps(pdf)
        end, hops, loops = kernels.follow(nxt, np.ones(len(nxt), dtype=np.int64))
        on_loop = np.zeros(len(nxt), dtype=bool)
        on_loop[end[loops]] = True  # images after enough steps are exactly the cycle cells
        members = np.flatnonzero(on_loop)
        loop = np.full(len(nxt), -1, dtype=np.int64)
        if members.size:
            first = kernels.smallest_member(len(nxt), members, nxt[members])
            smallest = np.full(len(nxt), np.iinfo(np.int64).max)
            np.minimum.at(smallest, first[members], ids[members])
            loop[loops] = smallest[first[end[loops]]]
        leaves = leaving[end] & ~loops
        return pdf.assign(
            _end=ids[end], _hops=hops,
            _dst=_or_null(dst[end], leaves), _loop=_or_null(loop, loops),
            _on_loop=on_loop, _acc=kernels.upstream_totals(nxt, np.ones(len(nxt))),
        )[names]

    return cut(map_groups(tiled, TILE_KEYS, paths, schema))


def _gates(local: DataFrame, side: int) -> DataFrame:
    """Cells where water leaves a tile, each with the next gate, or its end, downstream.

    Columns: id, dst (NULL off the grid), acc, nxt (next gate), last (end cell if there is no next
    gate), loop, len (steps to ``nxt`` or ``last``).
    """
    leaves = F.col("_dst").isNotNull() & (cell_id() == F.col("_end"))
    rim = cut(
        local.where(on_tile_border(side) | leaves)
        .select("raster_id", cell_id().alias("id"), "_end", "_hops", "_dst", "_loop", "_acc")
    )
    leaving = rim.where("id = _end AND _dst IS NOT NULL").select("raster_id", "id", F.col("_dst").alias("dst"), F.col("_acc").alias("acc"))
    entry = rim.select(
        "raster_id", F.col("id").alias("dst"), F.col("_end").alias("e_end"), (F.col("_hops") + 1).alias("e_len"),
        F.col("_dst").isNotNull().alias("e_leaves"), F.col("_loop").alias("loop"),
    )
    return cut(leaving.join(entry, ["raster_id", "dst"], "left").select(
        "raster_id", "id", F.when(F.col("e_end").isNotNull(), F.col("dst")).alias("dst"), "acc",
        F.when(F.col("e_leaves"), F.col("e_end")).alias("nxt"),
        F.when(~F.col("e_leaves"), F.col("e_end")).when(F.col("e_leaves").isNull(), F.col("id")).alias("last"),
        "loop", F.coalesce("e_len", F.lit(0)).alias("len"),
    ))


def _chase(gates: DataFrame) -> DataFrame:
    """Follow every gate to its end: adds ``last``, ``loop`` and ``len``; gates on
    or above a cross-tile cycle keep a ``nxt`` (which then lies on the cycle) and
    ``low``, the smallest gate met on the way."""
    state, seen = cut(gates.select("raster_id", "id", "nxt", "last", "loop", "len", F.col("id").alias("low")),
                      total=F.count("*"), open=F.count_if(F.col("nxt").isNotNull()))
    # Gates that have arrived are written once; rounds go on with the others alone.
    settled, moving, left = state.where("nxt IS NULL"), state.where("nxt IS NOT NULL"), seen["open"]
    for _ in range(math.ceil(math.log2(seen["total"] + 1)) + 2 if left else 0):
        ahead = settled.unionByName(moving).select(
            "raster_id", F.col("id").alias("nxt"), F.col("nxt").alias("n2"), F.col("last").alias("l2"),
            F.col("loop").alias("o2"), F.col("len").alias("s2"), F.col("low").alias("w2"),
        )
        if left <= BROADCAST_ROWS:  # few gates look up few others
            ahead = ahead.join(F.broadcast(moving.select("raster_id", "nxt").distinct()), ["raster_id", "nxt"], "left_semi")
        jumped = lookup_salted(moving, ahead.hint("merge"), ["raster_id", "nxt"], F.col("id"), rows=left).select(
            "raster_id", "id", F.col("n2").alias("nxt"), F.col("l2").alias("last"), F.col("o2").alias("loop"),
            (F.col("len") + F.col("s2")).alias("len"), F.least("low", "w2").alias("low"),
        )
        jumped, seen = cut(jumped, open=F.count_if(F.col("nxt").isNotNull()))
        settled, moving, left = settled.unionByName(jumped.where("nxt IS NULL")), jumped.where("nxt IS NOT NULL"), seen["open"]
        if not left:
            return cut(settled)
    return cut(settled.unionByName(moving))


def _trace(g: DataFrame):
    side = tile_side(g.sparkSession)
    local = _local_paths(g, side)
    gates = _gates(local, side)
    return local, gates, _chase(gates)


def _effective(g: DataFrame) -> DataFrame:
    """Invalid cells end every trace."""
    if "valid" not in g.columns:
        return g
    return g.withColumn("direction", F.when(F.col("valid"), F.col("direction")).otherwise(NO_DIRECTION))


def flow_terminal(g: DataFrame) -> DataFrame:
    """Adds where each cell's water ends: ``terminal`` (cell id), ``kind`` (exit or
    cycle) and ``hops``.  On a cycle ``terminal`` and ``hops`` are NULL."""
    g = cut(g)
    local, _, ends = _trace(_effective(g).select(*KEYS, "direction"))
    side = tile_side(g.sparkSession)
    arrived = ends.select(
        "raster_id", tile_of(id_row("id"), side).alias("trow"), tile_of(id_col("id"), side).alias("tcol"),
        F.col("id").alias("_end"), "nxt", "last", "loop", "len",
    )
    looped = F.col("_loop").isNotNull() | F.col("loop").isNotNull() | F.col("nxt").isNotNull()
    solved = local.join(arrived, [*TILE_KEYS, "_end"], "left").select(
        *KEYS,
        F.when(~looped, F.coalesce("last", "_end")).alias("terminal"),
        F.when(looped, "cycle").otherwise("exit").alias("kind"),
        F.when(~looped, F.col("_hops") + F.coalesce("len", F.lit(0))).alias("hops"),
    )
    return g.join(solved, KEYS)


def flow_cycles(g: DataFrame) -> DataFrame:
    """Cells on directed cycles: keys and ``cycle`` (smallest cell id on the cycle)."""
    side = tile_side(g.sparkSession)
    # A step into an inactive cell ends there, so it can never close a cycle.
    local, gates, ends = _trace(cut(_effective(g).select(*KEYS, "direction")))
    inner = local.where("_on_loop").select(*KEYS, F.col("_loop").alias("cycle"))
    on_cycle = cut(ends.where("nxt IS NOT NULL").select("raster_id", F.col("nxt").alias("id")).distinct())
    if on_cycle.isEmpty():
        return inner
    ring = on_cycle.join(gates, ["raster_id", "id"]).join(ends.select("raster_id", "id", "low"), ["raster_id", "id"])
    entries = ring.select(
        "raster_id", id_row("dst").alias("row"), id_col("dst").alias("col"),
        F.col("low").alias("ring"), F.lit(1).alias("_entry"),
    )
    exits = ring.select(
        "raster_id", tile_of(id_row("nxt"), side).alias("trow"), tile_of(id_col("nxt"), side).alias("tcol"),
        F.col("nxt").alias("_end"), F.col("low").alias("_ring"),
    ).distinct()
    tied = local.join(exits, [*TILE_KEYS, "_end"]).join(entries.drop("ring"), KEYS, "left")
    cells = tied.select(*KEYS, "trow", "tcol", "direction", "_ring", F.coalesce("_entry", F.lit(0)).alias("_entry"))

    def on_path(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pd.MultiIndex.from_arrays([pdf["row"], pdf["col"]])
        steps = np.array(D8_STEPS + [(0, 0)])[pdf["direction"].to_numpy()]
        to = at.get_indexer(pd.MultiIndex.from_arrays([pdf["row"] + steps[:, 0], pdf["col"] + steps[:, 1]]))
        nxt = np.where(to >= 0, to, np.arange(len(pdf)))
        below = kernels.upstream_totals(nxt, pdf["_entry"].to_numpy()) > 0
        return pdf.loc[below, [*KEYS, "_ring"]]

    crossing = cut(map_groups(cells, TILE_KEYS, on_path, "raster_id string, row int, col int, _ring long"))
    smallest = crossing.groupBy("raster_id", "_ring").agg(F.min(cell_id()).alias("cycle"))
    named = lookup_salted(crossing, smallest, ["raster_id", "_ring"], F.struct("row", "col"))
    return inner.unionByName(named.select(*KEYS, "cycle"))


def assert_acyclic(g: DataFrame) -> DataFrame:
    """Return ``g`` unchanged, or raise with the number of cells that run into a cycle."""
    stuck = flow_terminal(g).where("kind = 'cycle'").count()
    if stuck:
        raise ValueError(f"flow directions contain cycles: {stuck} cells are on or drain into one")
    return g


def flow_accumulation(g: DataFrame) -> DataFrame:
    """``accumulation``: number of cells draining through each cell, itself included.

    Validity plays no part: every grid cell counts.  Cycles raise an error.
    """
    side = tile_side(g.sparkSession)
    g = cut(g)
    flow = g.select(*KEYS, "direction")
    local = _local_paths(flow, side)
    gates = _gates(local, side)
    # Looped paths never leave their tile, so they show up here or as open gates.
    state = gates.select("raster_id", "id", "nxt", F.col("acc").alias("s"))
    total = gates.count()
    left = 1 if total else 0
    for _ in range(math.ceil(math.log2(total + 1)) + 2 if total else 0):
        arriving = state.where("nxt IS NOT NULL").groupBy("raster_id", F.col("nxt").alias("id")).agg(F.sum("s").alias("add"))
        ahead = state.select("raster_id", F.col("id").alias("nxt"), F.col("nxt").alias("n2"))
        jumped = lookup_salted(state.where("nxt IS NOT NULL"), ahead, ["raster_id", "nxt"], F.col("id"), rows=total).select(
            "raster_id", "id", F.col("n2").alias("nxt"), "s"
        )
        state, seen = cut(
            jumped.unionByName(state.where("nxt IS NULL")).join(arriving, ["raster_id", "id"], "left").select(
                "raster_id", "id", "nxt", (F.col("s") + F.coalesce("add", F.lit(0))).alias("s")
            ),
            open=F.count_if(F.col("nxt").isNotNull()),
        )
        left = seen["open"]
        if not left:
            break
    if left or not local.where("_on_loop").isEmpty():
        assert_acyclic(flow)
    inflow = (
        gates.where("dst IS NOT NULL").select("raster_id", "id", "dst").join(state, ["raster_id", "id"])
        .groupBy("raster_id", "dst").agg(F.sum("s").alias("inflow"))
        .select("raster_id", id_row("dst").alias("row"), id_col("dst").alias("col"), "inflow")
    )
    tiled = with_tile(g, side)
    schema = widened(tiled, accumulation="long")
    names = schema.fieldNames()

    def accumulate(cells: pd.DataFrame, incoming: pd.DataFrame) -> pd.DataFrame:
        nxt, _, ids, _ = _tile_steps(cells)
        weight = np.ones(len(cells))
        if len(incoming):
            order = np.argsort(ids)
            into = (incoming["row"].to_numpy().astype(np.int64) << 32) + incoming["col"].to_numpy()
            spot = np.searchsorted(ids[order], into).clip(0, len(ids) - 1)
            hit = ids[order][spot] == into
            weight[order[spot[hit]]] += incoming["inflow"].to_numpy()[hit]
        return cells.assign(accumulation=kernels.upstream_totals(nxt, weight))[names]

    return map_pairs(tiled, with_tile(inflow, side), TILE_KEYS, accumulate, schema).drop("trow", "tcol")
