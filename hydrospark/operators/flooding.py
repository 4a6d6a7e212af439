"""Depression filling: every cell rises to its lowest pass to an outlet.

Tiles flood from their rim and from true outlets, super-tiles and then wider squares
flood the graph of rim labels, and whatever crosses the widest squares is merged by picking each
group's lowest pass per round (the number of groups at least halves).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.grouped import map_groups, widened
from hydrospark.operators.grid import edge_contact
from hydrospark.schema import KEYS, TILE_KEYS, id_col, id_row
from hydrospark.scratch import cut
from hydrospark.tiling import lookup_salted, next_square, on_tile_border, tile_fan, tile_of, tile_side, with_tile

OUT = -1  # label of everything that drains out by itself
LOW = float("-inf")
EDGE = "raster_id string, a long, b long, w double, v long, label long, level double"


def _lowest(a, b, w):
    """Lowest weight per unordered label pair, equal labels dropped."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    keep = lo != hi
    pairs = pd.DataFrame({"a": lo[keep], "b": hi[keep], "w": w[keep]})
    return pairs.groupby(["a", "b"], as_index=False, sort=False)["w"].min()


def _stacked(top: pd.DataFrame, bottom: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Two row kinds under one set of columns; ids stay exact integers."""
    size = len(top) + len(bottom)
    out = {}
    for name in names:
        kind = (top if name in top else bottom)[name].dtype
        parts = [f[name].array if name in f else [pd.NA] * len(f) for f in (top, bottom)]
        kind = "Int64" if kind.kind == "i" else "Float64" if kind.kind == "f" else object
        out[name] = pd.concat([pd.Series(p, dtype=kind) for p in parts], ignore_index=True)
    return pd.DataFrame(out, index=range(size))


def fill_depressions(g: DataFrame, max_fill_depth: float | None = None) -> DataFrame:
    """Raise ``height`` to the lowest level at which water leaves; adds ``fill_depth``."""
    side, fan = tile_side(g.sparkSession), tile_fan(g.sparkSession)
    g = cut(edge_contact(g))
    tiled = with_tile(g, side)
    schema = widened(tiled, _level="double", _label="long", a="long", b="long", w="double")
    names = schema.fieldNames()

    def flood_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = rows.min(), cols.min()
        shape = (rows.max() - r0 + 1, cols.max() - c0 + 1)
        lay = lambda values, fill, kind: kernels.paint(rows, cols, values, r0, c0, shape, fill, kind).ravel()
        valid = lay(pdf["valid"].to_numpy(), False, bool)
        outlet = lay(pdf["edge_contact"].to_numpy(), False, bool)
        height = lay(pdf["height"].to_numpy(), 0, np.float64)
        rim = lay(((rows % side) % (side - 1) == 0) | ((cols % side) % (side - 1) == 0), False, bool)
        n = valid.size
        flat = np.arange(n)
        ids = ((flat // shape[1] + r0) << 32) + flat % shape[1] + c0
        a, b = kernels.grid_pairs(shape)
        both = valid[a] & valid[b]
        a, b = a[both], b[both]
        label = np.where(outlet, OUT, ids)
        seeds = np.flatnonzero(valid & (rim | outlet))
        level, label = kernels.flood(n, a, b, np.maximum(height[a], height[b]), height, label, seeds)
        at = (rows - r0) * shape[1] + (cols - c0)
        cells = pdf.assign(_level=level[at], _label=label[at])
        passes = _lowest(label[a], label[b], np.maximum(level[a], level[b]))
        passes["raster_id"] = pdf["raster_id"].iloc[0]
        return _stacked(cells, passes, names)

    both = cut(map_groups(tiled, TILE_KEYS, flood_tile, schema))
    cells = both.where("a IS NULL").drop("a", "b", "w")
    inner = both.where("a IS NOT NULL").select("raster_id", "a", "b", "w")
    levels = _label_levels(inner.unionByName(_rim_passes(cells, side)), side * fan)

    leveled = cells.join(
        levels.select("raster_id", tile_of(id_row("v"), side).alias("trow"), tile_of(id_col("v"), side).alias("tcol"),
                      F.col("v").alias("_label"), "level"),
        [*TILE_KEYS, "_label"], "left",
    )
    top = F.greatest(F.col("_level"), F.coalesce("level", F.lit(LOW))).cast("float")
    if max_fill_depth is not None:
        top = F.least(top, (F.col("height") + F.lit(float(max_fill_depth))).cast("float"))
    zero = F.lit(0.0).cast("float")
    filled = F.when(F.col("valid"), top).otherwise(F.col("height"))
    return (
        leveled.withColumn("_top", filled)
        .withColumn("fill_depth", F.when(F.col("valid"), F.greatest(F.col("_top") - F.col("height"), zero)).otherwise(zero))
        .withColumn("height", F.col("_top"))
        .select(*[c for c in g.columns if c != "edge_contact"], "fill_depth")
    )


def _rim_passes(cells: DataFrame, side: int) -> DataFrame:
    """Lowest passes between labels that touch across a tile border."""
    rim = cells.where("valid").where(on_tile_border(side)).select(*TILE_KEYS, "row", "col", "_level", "_label")
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in kernels.HALF_STEPS])
    half = rim.withColumn("_s", F.explode(steps)).select(
        "raster_id", F.col("trow").alias("t1"), F.col("tcol").alias("u1"),
        (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"),
        F.col("_level").alias("l1"), F.col("_label").alias("x"),
    )
    return (
        half.join(rim, KEYS)
        .where("(trow <> t1 OR tcol <> u1) AND x <> _label")
        .groupBy("raster_id", F.least("x", "_label").alias("a"), F.greatest("x", "_label").alias("b"))
        .agg(F.min(F.greatest("l1", "_level")).alias("w"))
    )


def _label_levels(passes: DataFrame, big: int) -> DataFrame:
    """Level of every rim label: (raster_id, v, level), flooded in squares of ``big`` cells a side, then in wider
    and wider ones, and by joins where a square would hold too much for one task.  OUT labels have none."""
    # OUT is the smaller end of any pair it is part of; it belongs to the other end's super-tile.
    same = (F.col("a") == OUT) | (
        (tile_of(id_row("a"), big) == tile_of(id_row("b"), big)) & (tile_of(id_col("a"), big) == tile_of(id_col("b"), big))
    )
    passes, seen = cut(
        passes.withColumn("_same", F.coalesce(same, F.lit(True)))
        .withColumn("srow", tile_of(id_row("b"), big)).withColumn("scol", tile_of(id_col("b"), big)),
        across=F.count_if(~F.col("_same")),
    )

    def flood_group(pdf: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        code = code.reshape(-1, 2)
        rows, cols = names >> 32, names & 0xFFFFFFFF
        edge = (rows % big == 0) | (rows % big == big - 1) | (cols % big == 0) | (cols % big == big - 1)
        seeds = np.flatnonzero(edge | (names == OUT))
        level, label = kernels.flood(
            len(names), code[:, 0], code[:, 1], pdf["w"].to_numpy(), np.full(len(names), LOW), names, seeds
        )
        a, b = code[:, 0], code[:, 1]
        left = _lowest(label[a], label[b], np.maximum(pdf["w"].to_numpy(), np.maximum(level[a], level[b])))
        nodes = pd.DataFrame({"v": names, "label": label, "level": level})
        out = _stacked(nodes[nodes["v"] != OUT], left, ["a", "b", "w", "v", "label", "level"])
        return out.assign(raster_id=pdf["raster_id"].iloc[0])[["raster_id", *out.columns]]

    solved = cut(map_groups(passes.where("_same"), ["raster_id", "srow", "scol"], flood_group, EDGE))
    nodes = solved.where("v IS NOT NULL").select("raster_id", "v", "label", "level")
    open_pairs = solved.where("a IS NOT NULL").select("raster_id", "a", "b", "w")
    if not seen["across"] and open_pairs.isEmpty():
        return nodes.select("raster_id", "v", "level")
    # Passes across super-tiles join rim labels, which are their own label at level -inf.
    across = passes.where("NOT _same").select("raster_id", "a", "b", "w")
    left, wider = open_pairs.unionByName(across), next_square(passes.sparkSession, big)
    tops = cut(_label_levels(left, wider)) if wider else merge_by_lowest_pass(left)
    lifted = lookup_salted(
        nodes, tops.select("raster_id", F.col("v").alias("label"), F.col("level").alias("top")),
        ["raster_id", "label"], F.col("v"),
    ).select("raster_id", "v", F.greatest("level", F.coalesce("top", F.lit(LOW))).alias("level"))
    return lifted.unionByName(
        tops.select("raster_id", "v", "level").join(nodes, ["raster_id", "v"], "left_anti")
    )


def merge_by_lowest_pass(edges: DataFrame) -> DataFrame:
    """Lowest pass of every node to OUT over (raster_id, a, b, w): (raster_id, v, level).

    Each round every group hooks onto the neighbour behind its lowest pass.
    Water in a group must rise to that pass, so its nodes take the maximum of the
    passes of all groups they have been part of.
    """
    edges = cut(edges.groupBy("raster_id", "a", "b").agg(F.min("w").alias("w")))
    ends = edges.select("raster_id", F.col("a").alias("v")).unionByName(edges.select("raster_id", F.col("b").alias("v")))
    nodes = cut(ends.where(F.col("v") != OUT).distinct().select("raster_id", "v", F.col("v").alias("grp"), F.lit(LOW).alias("level")))
    while not edges.isEmpty():
        order = F.struct("w", "a", "b")
        both = edges.select("raster_id", F.col("a").alias("grp"), F.struct("w", "a", "b", F.col("b").alias("to")).alias("e")).unionByName(
            edges.select("raster_id", F.col("b").alias("grp"), F.struct("w", "a", "b", F.col("a").alias("to")).alias("e")))
        pick = cut(both.where(F.col("grp") != OUT).groupBy("raster_id", "grp").agg(F.min("e").alias("e"))
                   .select("raster_id", "grp", F.col("e.to").alias("to"), F.col("e.w").alias("w")))
        back = pick.select("raster_id", F.col("grp").alias("to"), F.col("to").alias("back"))
        # Most groups may hook onto the outside at once; it never hooks back, so they need no join.
        inner = pick.where(F.col("to") != OUT).join(back, ["raster_id", "to"], "left").select(
            "raster_id", "grp", "w",
            F.when((F.col("back") == F.col("grp")) & (F.col("grp") < F.col("to")), F.col("grp")).otherwise(F.col("to")).alias("root"))
        hook = cut(inner.unionByName(pick.where(F.col("to") == OUT).select("raster_id", "grp", "w", F.col("to").alias("root"))))
        hook = _to_roots(hook)
        nodes = cut(lookup_salted(nodes, hook, ["raster_id", "grp"], F.col("v")).select(
            "raster_id", "v", F.coalesce("root", "grp").alias("grp"), F.greatest("level", F.coalesce("w", F.lit(LOW))).alias("level")))
        for end in ("a", "b"):
            to = hook.select("raster_id", F.col("grp").alias(end), "root")
            edges = lookup_salted(edges, to, ["raster_id", end], order).withColumn(end, F.coalesce("root", end)).drop("root")
        edges = cut(edges.where("a <> b").groupBy("raster_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .agg(F.min("w").alias("w")))
    return nodes.select("raster_id", "v", "level")


def _to_roots(hook: DataFrame) -> DataFrame:
    """Replace ``root`` by the end of its chain (pointer doubling)."""
    while True:
        ahead = hook.select("raster_id", F.col("grp").alias("root"), F.col("root").alias("r2"))
        hook, seen = cut(
            lookup_salted(hook, ahead, ["raster_id", "root"], F.col("grp"))
            .select("raster_id", "grp", "w", F.coalesce("r2", "root").alias("root"), (F.coalesce("r2", "root") != F.col("root")).alias("_m")),
            moved=F.count_if(F.col("_m")),
        )
        hook = hook.drop("_m")
        if not seen["moved"]:
            return hook
