"""Cheapest arrival inside labelled regions, exchanged between tiles until stable.

Each tile settles its own cells; the states of cells that touch the same region
in another tile travel to that tile's halo, and only tiles that received a better
state run again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.grouped import map_pairs
from hydrospark.schema import KEYS, TILE_KEYS
from hydrospark.scratch import BROADCAST_ROWS, cut
from hydrospark.tiling import own_cells, tile_side, with_halo

COST_UNIT = 1_000_000  # one step, so that costs compare as integers
FAR = np.iinfo(np.int64).max // 4
STATE = "raster_id string, row int, col int, cost long, source long, dist int"


def _toward(region, dist, source, height):
    """Code of the neighbour nearer to the source, in the same region, with the smallest rise (-1: none)."""
    rows, cols = region.shape
    best, code = np.full(region.shape, np.inf), np.full(region.shape, -1)
    here = (slice(1, rows - 1), slice(1, cols - 1))
    for i, (dr, dc) in enumerate(kernels.D8_STEPS):
        there = (slice(1 + dr, rows - 1 + dr), slice(1 + dc, cols - 1 + dc))
        rise = height[there] - height[here]
        better = (region[there] == region[here]) & (source[there] >= 0) & (dist[there] < dist[here]) & (rise < best[here])
        best[here][better], code[here][better] = rise[better], i
    return code


def region_distances(members: DataFrame, toward: bool = False) -> DataFrame:
    """Nearest source per member cell: (keys, cost, source, dist); unreached cells are absent.

    ``members``: keys, ``region`` (BIGINT), and on seed cells ``cost`` (BIGINT, in
    ``COST_UNIT``) and ``source`` (BIGINT >= 0).  Ties go to the lower source.
    With ``toward``, ``members`` also have a ``height``, and each cell gets the code of its
    neighbour that is nearer, least risen, first (-1 at the sources).
    """
    side = tile_side(members.sparkSession)
    layers = {"row": None, "col": None, "region": None, "cost": FAR, "source": -1} | ({"height": None} if toward else {})
    lists = [
        F.collect_list(F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(fill))).alias(c)
        for c, fill in layers.items()
    ]
    blocks = cut(with_halo(members, side, 1).groupBy(*TILE_KEYS).agg(*lists))

    def settle(rim_only: bool):
        def run(block: pd.DataFrame, incoming: pd.DataFrame) -> pd.DataFrame:
            if block.empty:
                return pd.DataFrame(columns=["raster_id", "row", "col", "cost", "source", "dist", *(["toward"] if toward and not rim_only else [])])
            b = block.iloc[0]
            r0, c0 = int(b["trow"]) * side - 2, int(b["tcol"]) * side - 2
            shape = (side + 4, side + 4)
            lay = lambda values, fill: kernels.paint(b["row"], b["col"], values, r0, c0, shape, fill, np.int64)
            region, cost, source = lay(b["region"], -1), lay(b["cost"], FAR), lay(b["source"], -1)
            dist = np.zeros(shape, dtype=np.int64)
            if len(incoming):
                at = (incoming["row"].to_numpy() - r0, incoming["col"].to_numpy() - c0)
                cost[at], source[at], dist[at] = (incoming[k].to_numpy() for k in ("cost", "source", "dist"))
            kernels.spread(region, cost, source, dist, COST_UNIT)
            emit = np.zeros(shape, dtype=bool)
            emit[2:-2, 2:-2] = (source >= 0)[2:-2, 2:-2]
            if rim_only:
                halo = np.full(shape, -1, dtype=np.int64)
                ring = np.zeros(shape, dtype=bool)
                ring[1:-1, 1:-1] = True
                ring[2:-2, 2:-2] = False
                halo[ring] = region[ring]
                meets = np.zeros(shape, dtype=bool)
                for dr, dc in kernels.D8_STEPS:
                    meets[1:-1, 1:-1] |= (
                        halo[1 + dr:shape[0] - 1 + dr, 1 + dc:shape[1] - 1 + dc] == region[1:-1, 1:-1]
                    )
                emit &= meets
            r, c = np.nonzero(emit)
            out = pd.DataFrame({
                "raster_id": b["raster_id"], "row": r + r0, "col": c + c0,
                "cost": cost[r, c], "source": source[r, c], "dist": dist[r, c],
            })
            if toward and not rim_only:
                height = kernels.paint(b["row"], b["col"], b["height"], r0, c0, shape, 0.0, np.float64)
                out["toward"] = _toward(region, dist, source, height)[r, c]
            return out
        return run

    def arriving(states: DataFrame) -> DataFrame:
        return with_halo(states, side, 1).where(~own_cells(side))

    best = "min(struct(cost, source, dist))"
    states, seen = cut(map_pairs(blocks, arriving(_no_states(members)), TILE_KEYS, settle(True), STATE), n=F.count("*"))
    changed = states
    while seen["n"]:
        # Tiles are few and known here, so those that rest are left out before anything is shuffled.
        active, tiles = cut(arriving(changed).select(*TILE_KEYS).distinct(), n=F.count("*"))
        active = F.broadcast(active) if tiles["n"] <= BROADCAST_ROWS else active
        again = map_pairs(
            blocks.join(active, TILE_KEYS, "left_semi"),
            arriving(states).join(active, TILE_KEYS, "left_semi"), TILE_KEYS, settle(True), STATE,
        )
        merged, seen = cut(
            states.withColumn("_old", F.lit(True)).unionByName(again.withColumn("_old", F.lit(False)))
            .groupBy(*KEYS).agg(
                F.expr(best).alias("b"), F.expr(f"{best} FILTER (WHERE _old)").alias("o"),
            ).select(*KEYS, "b.*", (~F.col("b").eqNullSafe(F.col("o"))).alias("_new")), n=F.count_if("_new"),
        )
        states = merged.drop("_new")
        changed = merged.where("_new").drop("_new")
    return map_pairs(blocks, arriving(states), TILE_KEYS, settle(False), STATE + (", toward int" if toward else ""))


def _no_states(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], STATE)
