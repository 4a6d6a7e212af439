"""The iterative sink fill: local sink lift and closed-flat repair, in rounds over the whole grid.

A tile runs many rounds at once on its cells and a halo around them.  What lies outside the block may
change in ways the tile can't see, so it is unknown; a cell becomes unknown only when an unknown
neighbour could decide it: a cell with a known neighbour that is not higher is no sink, and a flat with a
proven lower neighbour is not closed, whatever lies beyond.  A tile whose own cells all stay known has
exactly the result of rounds over the whole grid.  The others run again with a wider halo; rasters with
a tile that is still open then (a closed flat wider than that) go by rounds over their whole grid.

Inside a block only cells and flats next to a change are looked at again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.grouped import map_groups, widened
from hydrospark.operators.focal import sink_pass
from hydrospark.operators.grid import extent
from hydrospark.operators.regions import CLOSE, SLOPE_STEP, repair_closed_flats
from hydrospark.schema import KEYS, TILE_KEYS
from hydrospark.scratch import cut
from hydrospark.tiling import attach, tile_side, with_halo

MAX_FILL_ROUNDS = 32  # fixed value
HALO = 64
#: Above this height neighbouring single-precision values differ by more than ``CLOSE``, so a flat is exactly level.
LEVEL_ABOVE = 16.001


def _near(mask: np.ndarray) -> np.ndarray:
    """Cells of ``mask`` and their neighbours."""
    out = mask.copy()
    for dr, dc in kernels.D8_STEPS:
        out[max(0, dr):mask.shape[0] + min(0, dr), max(0, dc):mask.shape[1] + min(0, dc)] |= \
            mask[max(0, -dr):mask.shape[0] + min(0, -dr), max(0, -dc):mask.shape[1] + min(0, -dc)]
    return out


def _lift(h, v, k, at, shifts):
    """Sink lift of the cells ``at`` (flat indices): indices and new heights of those lifted, and those now unknown."""
    count, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.float32)
    lowest, level, unseen = np.full(len(at), np.inf, np.float32), np.zeros(len(at), bool), np.zeros(len(at), bool)
    mine = h[at].astype(np.float64)
    for shift in shifts:
        n = at + shift
        seen = v[n] & k[n]
        unseen |= ~k[n]
        value = h[n]
        total = np.where(seen, total + value, total)
        count += seen
        lowest = np.where(seen, np.minimum(lowest, value), lowest)
        level |= seen & (np.abs(value.astype(np.float64) - mine) <= 1e-8 + 1e-5 * np.abs(mine))
    below = h[at] < lowest
    mean = (total.astype(np.float64) / np.maximum(count, 1)).astype(np.float32)
    sink = below & ~unseen & (count > 0)
    return at[sink], np.where(level, lowest, mean)[sink], at[below & unseen]


def _repair(h, v, k, label, on, pairs, shifts, shape, cells):
    """Closed flats among the cells ``on``: indices and new heights, and the cells now unknown; updates ``label``."""
    a, b = pairs
    both = on[a] & on[b]
    a, b = a[both], b[both]
    close = np.abs(h[a].astype(np.float64) - h[b]) <= CLOSE
    first = kernels.smallest_member(len(h), a[close], b[close])
    at = np.flatnonzero(on)
    label[at] = first[at]
    name, by = np.unique(label[at], return_inverse=True)
    lower, proven, open_ = np.zeros(len(name), bool), np.zeros(len(name), bool), np.zeros(len(name), bool)
    spill = np.full(len(at), np.inf, np.float32)
    mine = h[at].astype(np.float64)
    for shift in shifts:
        n = at + shift
        open_[by[~k[n]]] = True
        out = v[n] & k[n] & (label[n] != label[at])
        drop = mine - h[n]
        under = out & (h[n] < mine - CLOSE)
        lower[by[under]] = True
        proven[by[under & ((mine > LEVEL_ABOVE) | (drop > CLOSE * cells))]] = True
        spill = np.where(out & ~under, np.minimum(spill, h[n]), spill)
    doubtful = open_ & ~proven
    size = np.bincount(by, minlength=len(name))
    least = np.full(len(name), np.inf, np.float32)
    np.minimum.at(least, by, spill)
    closed = ~doubtful & ~lower & (size > 1) & np.isfinite(least)
    hidden = at[doubtful[by]]
    inside = closed[by]
    if not inside.any():
        return at[:0], h[:0], hidden
    # The anchor is the first cell (scan order) at the lowest spill height.
    anchors = at[inside & (spill == least[by])]
    keep = np.unique(label[anchors], return_index=True)[1]
    region = np.full(len(h), -1, np.int64)
    region[at[inside]] = label[at[inside]]
    source, cost, dist = np.full(len(h), -1, np.int64), np.full(len(h), np.iinfo(np.int64).max // 4), np.zeros(len(h), np.int64)
    source[anchors[keep]], cost[anchors[keep]] = 0, 0
    kernels.spread(*(x.reshape(shape) for x in (region, cost, source, dist)), 1)
    lifted = at[inside]
    return lifted, (least[by[inside]].astype(np.float64) + SLOPE_STEP * (dist[lifted] + 1)).astype(np.float32), hidden


def fill_rounds(height, valid, known, inner, rounds, cells):
    """Rounds on one block (2-D arrays with a rim of one cell that is never written).

    ``inner``: cells not on the raster's own border; ``cells``: size of the raster.
    Returns heights, what is still known, and per cell the last round that changed it (0: none).
    """
    shape = height.shape
    shifts = [dr * shape[1] + dc for dr, dc in kernels.D8_STEPS]
    h, v, k = height.astype(np.float32).ravel(), valid.ravel(), (known | ~valid).ravel()
    k[~known.ravel() & ~valid.ravel()] = False  # outside the block nothing is known, not even validity
    rim = np.ones(shape, bool)
    rim[1:-1, 1:-1] = False
    body = ~rim.ravel()
    pairs = kernels.grid_pairs(shape)
    label, last = np.full(h.size, -1, np.int64), np.zeros(h.size, np.int64)
    dirty = body.copy()
    for turn in range(1, rounds + 1):
        before = k.copy()
        at, value, hidden = _lift(h, v, k, np.flatnonzero(dirty & body & v & k & inner.ravel()), shifts)
        h[at] = value
        k[hidden] = False
        changed = np.zeros(h.size, bool)
        changed[at] = changed[hidden] = True
        # Flats next to this round's lifts, and those next to what changed in the round before.
        touched = (_near(changed.reshape(shape)).ravel() | dirty) & v
        names = np.unique(label[touched & (label >= 0)])
        on = touched | np.isin(label, names)
        label[~k] = -1
        flats, value, hidden = _repair(h, v, k, label, on & body & v & k, pairs, shifts, shape, cells)
        h[flats] = value
        k[hidden] = False
        changed[flats] = changed[hidden] = True
        last[at] = last[flats] = turn
        if not changed.any() and (before == k).all():
            break
        dirty = _near(changed.reshape(shape)).ravel()
    return h.reshape(shape), k.reshape(shape), last.reshape(shape)


def _settled_blocks(tiled: DataFrame, side: int, halo: int, rounds: int) -> DataFrame:
    """Rounds per tile; own cells with ``_h`` (new height), ``_last`` (round) and ``_open`` (tile not settled)."""
    kept = [c for c in tiled.columns if c not in ("n_rows", "n_cols")]
    schema = widened(tiled.select(*kept), _h="float", _last="integer", _open="boolean")
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n_rows, n_cols = int(pdf["n_rows"].iloc[0]), int(pdf["n_cols"].iloc[0])
        r0, c0 = int(pdf["row"].min()) - 1, int(pdf["col"].min()) - 1
        shape = (int(pdf["row"].max()) - r0 + 2, int(pdf["col"].max()) - c0 + 2)
        lay = lambda name, fill, kind: kernels.paint(pdf["row"], pdf["col"], pdf[name].to_numpy(), r0, c0, shape, fill, kind)
        height, valid = lay("height", 0, np.float32), lay("valid", False, bool)
        rows, cols = np.arange(shape[0]) + r0, np.arange(shape[1]) + c0
        off = ((rows < 0) | (rows >= n_rows))[:, None] | ((cols < 0) | (cols >= n_cols))[None, :]
        known = off.copy()
        known[1:-1, 1:-1] = True
        inner = ((rows > 0) & (rows < n_rows - 1))[:, None] & ((cols > 0) & (cols < n_cols - 1))[None, :]
        height, seen, last = fill_rounds(height, valid, known, inner, rounds, n_rows * n_cols)
        own = pdf[(pdf["row"] // side == pdf["trow"]) & (pdf["col"] // side == pdf["tcol"])]
        r, c = own["row"].to_numpy() - r0, own["col"].to_numpy() - c0
        ok = seen[r, c] | ~own["valid"].to_numpy().astype(bool)
        return own.assign(_h=height[r, c], _last=last[r, c].astype(np.int32), _open=not ok.all())[names]

    return map_groups(tiled, TILE_KEYS, run, schema)


def _whole_grid_rounds(g: DataFrame, rounds: int) -> DataFrame:
    """The same rounds, each over the whole grid: ``g`` with ``_h`` and ``_last``."""
    state = cut(g.withColumn("_last", F.lit(0)))
    for turn in range(1, rounds + 1):
        nxt = repair_closed_flats(cut(sink_pass(state)))
        moved = F.col("lifted") | F.col("repaired")
        state, seen = cut(nxt.withColumn("_last", F.when(moved, turn).otherwise(F.col("_last"))).select(*g.columns, "_last"),
                          n=F.count_if(F.col("_last") == turn))
        if not seen["n"]:
            break
    return state.withColumn("_h", F.col("height"))


def _advance(g: DataFrame, rounds: int) -> DataFrame:
    """``g`` after so many rounds, with ``_h`` (new height) and ``_last`` (last round that changed the cell)."""
    side = tile_side(g.sparkSession)
    halo = int(g.sparkSession.conf.get("spark.hydrospark.fillHalo", str(HALO)))
    sized = cut(attach(g, extent(g)))
    done, left = None, None
    for reach in (halo, 2 * halo, 4 * halo):
        blocks = with_halo(sized, side, reach)
        if left is not None:
            blocks = blocks.join(left, TILE_KEYS, "left_semi")
        found, seen = cut(_settled_blocks(blocks, side, reach, rounds), n=F.count_if("_open"))
        settled = found.where("NOT _open").drop("_open", "trow", "tcol")
        done = settled if done is None else done.unionByName(settled)
        if not seen["n"]:
            return done
        left = found.where("_open").select(*TILE_KEYS).distinct()
    rest = left.select("raster_id", F.lit(True).alias("_rest")).distinct()
    whole = _whole_grid_rounds(attach(g, rest).where("_rest").drop("_rest"), rounds)
    return attach(done, rest).where("_rest IS NULL").drop("_rest").unionByName(whole)


def iterative_fill(g: DataFrame, max_iterations: int = MAX_FILL_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Alternate the local sink lift and the closed-flat repair until nothing changes, or for ``max_iterations`` rounds.

    Returns the cells and one row per raster: ``rounds`` that changed something, and whether it ``finished``
    (a round without a change was left).  Invalid cells and other columns stay as they are.
    """
    columns, used = g.columns, 0
    g, tally = cut(g), None
    while used < max_iterations:
        rounds = min(MAX_FILL_ROUNDS, max_iterations - used)
        found = cut(_advance(g, rounds))
        turns = found.groupBy("raster_id").agg(F.max("_last").alias("last")).where("last > 0").select(
            "raster_id", (F.col("last") + used).alias("last"))
        tally = turns if tally is None else tally.unionByName(turns)
        full = not found.where(F.col("_last") == rounds).isEmpty()
        g, used = found.withColumn("height", F.col("_h")).select(*columns), used + rounds
        if not full:
            break
    rasters = g.select("raster_id").distinct()
    if tally is None:
        return g, rasters.select("raster_id", F.lit(0).alias("rounds"), F.lit(False).alias("finished"))
    last = tally.groupBy("raster_id").agg(F.max("last").alias("rounds"))
    per = rasters.join(last, "raster_id", "left").select("raster_id", F.coalesce("rounds", F.lit(0)).cast("int").alias("rounds"))
    return cut(g), cut(per.withColumn("finished", F.col("rounds") < max_iterations))
