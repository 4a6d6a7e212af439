"""Connected components and region operators.

Each tile labels its own cells, super-tiles merge the labels that meet across tile
borders, wider squares those that still meet, and only what meets across the widest
squares goes through iterated joins.  The label of a component is the ``cell_id`` of its
first cell in scan order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.grouped import map_groups, widened
from hydrospark.operators.grid import extent
from hydrospark.schema import KEYS, TILE_KEYS, id_row
from hydrospark.scratch import cut
from hydrospark.tiling import (
    attach, lookup_by_tile, lookup_salted, next_square, on_tile_border, tile_fan, tile_of, tile_side, with_tile,
)


def connected_components(
    g: DataFrame, active, same: Column | None = None, tolerance: float = 0.0, out: str = "label"
) -> DataFrame:
    """Label 8-connected cells where ``active`` holds; NULL elsewhere.

    With ``same``, two neighbours connect only if their ``same`` values differ by
    at most ``tolerance``.
    """
    side, fan = tile_side(g.sparkSession), tile_fan(g.sparkSession)
    active = F.expr(active) if isinstance(active, str) else active
    same = F.lit(0) if same is None else same
    carried = g.columns
    g = cut(g)
    marked = with_tile(g, side).withColumn("_on", F.coalesce(active, F.lit(False))).withColumn("_val", F.coalesce(same, F.lit(0)))  # a NULL would turn a BIGINT into a double on its way
    local = _local_labels(marked, side, tolerance)

    rim = cut(
        local.where("_label IS NOT NULL").where(on_tile_border(side))
        .select(*TILE_KEYS, "row", "col", "_val", "_label")
    )
    merged = _merge_labels(_meeting_labels(rim, tolerance), side * fan)
    tiled = local.join(
        merged.select("raster_id", tile_of(id_row("_label"), side).alias("trow"),
                      tile_of(F.col("_label").bitwiseAND(F.lit(0xFFFFFFFF)), side).alias("tcol"), "_label", "_root"),
        [*TILE_KEYS, "_label"], "left",
    )
    return tiled.select(*carried, F.coalesce("_root", "_label").alias(out))


def _local_labels(marked: DataFrame, side: int, tolerance: float) -> DataFrame:
    """Add ``_label`` per tile: first cell of the component inside the tile."""
    schema = widened(marked.drop("_on"), _label="long")
    names = schema.fieldNames()

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = rows.min(), cols.min()
        shape = (rows.max() - r0 + 1, cols.max() - c0 + 1)
        on = kernels.paint(rows, cols, pdf["_on"].to_numpy(), r0, c0, shape, False, bool).ravel()
        val = np.nan_to_num(pdf["_val"].to_numpy())
        val = kernels.paint(rows, cols, val, r0, c0, shape, 0, val.dtype).ravel()
        a, b = kernels.grid_pairs(shape)
        joined = on[a] & on[b] & (np.abs(val[a] - val[b]) <= tolerance)
        first = kernels.smallest_member(on.size, a[joined], b[joined])
        flat = (rows - r0) * shape[1] + (cols - c0)
        root = first[flat].astype(np.int64)
        ids = ((root // shape[1] + r0) << 32) + root % shape[1] + c0
        labels = pd.array(ids, dtype="Int64")
        labels[~on[flat]] = pd.NA
        return pdf.assign(_label=labels)[names]

    return cut(map_groups(marked, TILE_KEYS, label, schema))


def _meeting_labels(rim: DataFrame, tolerance: float) -> DataFrame:
    """Distinct label pairs that touch across a tile border."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in kernels.HALF_STEPS])
    half = rim.withColumn("_s", F.explode(steps)).select(
        "raster_id", "trow", "tcol", (F.col("row") + F.col("_s.dr")).alias("row"),
        (F.col("col") + F.col("_s.dc")).alias("col"), F.col("_val").alias("_v1"), F.col("_label").alias("a"),
    )
    other = rim.select(*KEYS, F.col("trow").alias("t2"), F.col("tcol").alias("u2"), "_val", F.col("_label").alias("b"))
    return (
        half.join(other, KEYS)
        .where("trow <> t2 OR tcol <> u2")
        .where(F.abs(F.col("_v1") - F.col("_val")) <= tolerance)
        .select("raster_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _super_of(label: str, big: int) -> list[Column]:
    return [tile_of(id_row(label), big), tile_of(F.col(label).bitwiseAND(F.lit(0xFFFFFFFF)), big)]


def _merge_labels(pairs: DataFrame, big: int) -> DataFrame:
    """Roots of labels under ``pairs``: (raster_id, _label, _root), merged in squares of ``big`` cells a side,
    then in wider and wider ones, and by joins where a square would hold too much for one task."""
    (ra, ca), (rb, cb) = _super_of("a", big), _super_of("b", big)
    pairs, seen = cut(
        pairs.withColumn("_inside", (ra == rb) & (ca == cb)).withColumn("srow", ra).withColumn("scol", ca),
        across=F.count_if(~F.col("_inside")),
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        code = code.reshape(-1, 2)
        root = kernels.smallest_member(len(names), code[:, 0], code[:, 1])
        return pd.DataFrame({"raster_id": pdf["raster_id"].iloc[0], "_label": names, "_root": names[root]})

    inner = map_groups(
        pairs.where("_inside"), ["raster_id", "srow", "scol"], merge, "raster_id string, _label long, _root long"
    )
    if not seen["across"]:
        return inner
    inner = cut(inner)
    outer = pairs.where("NOT _inside").select("raster_id", "a", "b")
    for end in ("a", "b"):
        outer = (
            outer.join(inner.withColumnRenamed("_label", end), ["raster_id", end], "left")
            .withColumn(end, F.coalesce("_root", end)).drop("_root")
        )
    outer, wider = outer.where("a <> b").distinct(), next_square(pairs.sparkSession, big)
    tops = cut(_merge_labels(outer, wider).select("raster_id", F.col("_label").alias("v"), F.col("_root").alias("root"))) if wider else graph_roots(outer)
    known = inner.select("raster_id", "_label", F.col("_root").alias("v"))
    lifted = lookup_salted(known, tops, ["raster_id", "v"], F.col("_label")).select(
        "raster_id", "_label", F.coalesce("root", "v").alias("_root")
    )
    alone = tops.select("raster_id", F.col("v").alias("_label"), F.col("root").alias("_root"))
    return lifted.unionByName(alone.join(inner, ["raster_id", "_label"], "left_anti"))


def graph_roots(edges: DataFrame) -> DataFrame:
    """Smallest node of each component of (raster_id, a, b): (raster_id, v, root).

    Rounds of hooking onto the smallest neighbouring parent and pointer jumping.
    Edges are never rewritten, so no node gains neighbours; only the look-up of
    a parent can be hot, and that one is salted.
    """
    both = cut(edges.select("raster_id", F.col("a").alias("u"), F.col("b").alias("w")).unionByName(
        edges.select("raster_id", F.col("b").alias("u"), F.col("a").alias("w"))
    ))
    state = cut(both.groupBy("raster_id", F.col("u").alias("v")).agg(F.least(F.min("w"), F.first("u")).alias("p")))
    while True:
        seen_at = both.join(state.select("raster_id", F.col("v").alias("w"), F.col("p").alias("pw")), ["raster_id", "w"])
        best = seen_at.groupBy("raster_id", F.col("u").alias("v")).agg(F.min("pw").alias("m"))
        own = state.join(best, ["raster_id", "v"]).withColumn("m", F.least("m", "p"))
        own = cut(own)
        hooked = own.groupBy("raster_id", F.col("p").alias("v")).agg(F.min("m").alias("h"))
        moved = cut(
            own.join(hooked, ["raster_id", "v"], "left")
            .select("raster_id", "v", F.col("p").alias("old"), F.least("m", F.coalesce("h", "m")).alias("p"))
        )
        up = moved.select("raster_id", F.col("v").alias("p"), F.col("p").alias("gp"))
        jumped = lookup_salted(moved, up, ["raster_id", "p"], F.col("v"))
        state, seen = cut(
            jumped.select("raster_id", "v", "old", F.least("p", F.coalesce("gp", "p")).alias("p")),
            changed=F.count_if(F.col("old") != F.col("p")),
        )
        if not seen["changed"]:
            return state.select("raster_id", "v", F.col("p").alias("root"))


def component_sizes(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.where(F.col(label).isNotNull()).groupBy("raster_id", label).agg(F.count("*").alias("size"))


def scan_order_ids(labels: DataFrame, label: str = "label", out: str = "component") -> DataFrame:
    """0-based component numbers in scan order of their first cell.

    Counted per raster row first, so neither window ever sees more than one row
    or one column of a raster.
    """
    by_row = labels.select("raster_id", label).distinct().withColumn("_r", id_row(label))
    per_row = by_row.groupBy("raster_id", "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("raster_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_row.select("raster_id", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("raster_id", "_r").orderBy(label)
    return by_row.withColumn("_k", F.row_number().over(within) - 1).join(offsets, ["raster_id", "_r"]).select(
        "raster_id", label, (F.col("_off") + F.col("_k")).cast("bigint").alias(out)
    )


def flat_regions(g: DataFrame, out: str = "label") -> DataFrame:
    """Regions of valid neighbours whose heights differ by at most 1e-6 step by step."""
    return connected_components(g, F.col("valid"), F.col("height").cast("double"), 1e-6, out)


def border_connected(g: DataFrame, active, out: str = "connected") -> DataFrame:
    """Keep only the components of ``active`` that own a raster-border cell."""
    labelled = cut(connected_components(g, active, out="_lab"))
    dims = extent(g)
    edge = (
        (F.col("row") == 0) | (F.col("col") == 0)
        | (F.col("row") == F.col("n_rows") - 1) | (F.col("col") == F.col("n_cols") - 1)
    )
    touching = (
        attach(labelled.where("_lab IS NOT NULL"), dims).where(edge)
        .select("raster_id", "_lab").distinct().withColumn("_hit", F.lit(True))
    )
    side = tile_side(g.sparkSession)
    return lookup_by_tile(labelled, touching, "_lab", side).select(
        *g.columns, F.coalesce("_hit", F.lit(False)).alias(out)
    )


def filter_components(g: DataFrame, col: str, keep_value: bool, min_size) -> DataFrame:
    """Flip components of ``keep_value`` smaller than ``min_size`` (number or per-raster column)."""
    labelled = cut(connected_components(g, F.col(col) == F.lit(keep_value), out="_lab"))
    limit = F.greatest(F.lit(1), min_size if isinstance(min_size, Column) else F.lit(int(min_size)))
    sizes = component_sizes(labelled, "_lab").withColumnRenamed("size", "_size")
    small = F.coalesce(F.col("_size") < limit, F.lit(False))
    looked = lookup_by_tile(labelled, sizes, "_lab", tile_side(g.sparkSession))
    value = F.when(small, F.lit(not keep_value)).otherwise(F.col(col))
    return looked.withColumn(col, value).select(*g.columns)

