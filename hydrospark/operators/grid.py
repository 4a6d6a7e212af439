"""Grid shaping: densify, neighbours, masks, crops and block resampling."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark import kernels
from hydrospark.config import PreprocessConfig
from hydrospark.grouped import map_tables, widened
from hydrospark.schema import KEYS, TILE_KEYS
from hydrospark.scratch import cut
from hydrospark.tiling import attach, own_cells, tile_side, with_halo

ANALYSIS_MAX_SIDE = 1536  # fixed value


def extent(g: DataFrame) -> DataFrame:
    return g.groupBy("raster_id").agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")
    )


def densify(g: DataFrame) -> DataFrame:
    """Add the missing cells of each raster's bounding box as invalid cells.

    Only the gaps are generated: each cell looks at the next cell of its raster
    row and emits the columns in between; rows without any cell come from the
    row skeleton.  Nothing is joined cell by cell.
    """
    dims = extent(g)
    layers = [c for c in g.columns if c not in KEYS]
    in_row = Window.partitionBy("raster_id", "row").orderBy("col")
    marked = attach(g.select(*KEYS), dims).select(
        *KEYS,
        "n_cols",
        F.lag("col", 1, -1).over(in_row).alias("before"),
        F.lead("col").over(in_row).isNull().alias("last"),
    )
    left = F.when(F.col("col") - F.col("before") > 1, F.sequence(F.col("before") + 1, F.col("col") - 1))
    right = F.when(
        F.col("last") & (F.col("col") < F.col("n_cols") - 1),
        F.sequence(F.col("col") + 1, F.col("n_cols") - 1),
    )
    empty = F.array().cast("array<int>")
    gaps = marked.select(
        "raster_id", "row",
        F.explode(F.concat(F.coalesce(left, empty), F.coalesce(right, empty))).alias("col"),
    )
    skeleton = dims.select(
        "raster_id", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")
    )
    missing_rows = (
        skeleton.join(g.select("raster_id", "row").distinct(), ["raster_id", "row"], "left_anti")
        .repartition("raster_id", "row")
        .select("raster_id", "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    )
    types = dict(g.dtypes)
    fill = [
        (F.lit(False) if name == "valid" else F.lit(None).cast(types[name])).alias(name) for name in layers
    ]
    added = gaps.unionByName(missing_rows).select(*KEYS, *fill)
    if "height" in layers:
        added = added.withColumn("height", F.lit(0.0).cast("float"))
    return g.unionByName(added)


def with_neighbors(g: DataFrame, cols: list[str], side: int | None = None) -> DataFrame:
    """Add ``n0``..``n7``: structs of ``cols`` of the eight neighbours, NULL off the grid.

    One shuffle by tile, then two local window passes (along columns, then along
    rows of the packed triples).  The raster must be dense.
    """
    side = side or tile_side(g.sparkSession)
    down = Window.partitionBy(*TILE_KEYS, "col").orderBy("row")
    across = Window.partitionBy(*TILE_KEYS, "row").orderBy("col")
    me = F.struct(*cols)
    cells = (
        with_halo(g, side, 1)
        .repartition(*TILE_KEYS)
        .withColumn("_v", F.struct(F.lag(me).over(down).alias("u"), me.alias("m"), F.lead(me).over(down).alias("d")))
        .withColumn("_e", F.lead("_v").over(across))
        .withColumn("_w", F.lag("_v").over(across))
        .where(own_cells(side))
    )
    picks = ["_v.u", "_e.u", "_e.m", "_e.d", "_v.d", "_w.d", "_w.m", "_w.u"]
    return cells.select(*g.columns, *[F.col(p).alias(f"n{i}") for i, p in enumerate(picks)])


def from_neighbors(g: DataFrame, kernel, own_columns: bool = True, **added: str) -> DataFrame:
    """Columns that ``kernel`` makes of each cell and its eight neighbours (NumPy on one tile and its halo).

    ``kernel(table, near, own)`` gets a tile's Arrow table, the positions of the neighbours
    (``kernels.neighbor_positions``) and which cells are the tile's own; it returns one array for each of
    ``added``, which become columns of the own cells.  Without ``own_columns`` it returns an Arrow table
    of ``added`` beside ``raster_id`` that has rows of its own.  The raster must be dense.
    """
    side = tile_side(g.sparkSession)
    schema = widened(g if own_columns else g.select("raster_id"), **added)
    names = schema.fieldNames()

    def run(table: pa.Table) -> pa.Table:
        rows, cols = (table[k].combine_chunks().to_numpy() for k in ("row", "col"))
        own = (rows // side == table["trow"][0].as_py()) & (cols // side == table["tcol"][0].as_py())
        made = kernel(table, kernels.neighbor_positions(rows, cols), own)
        if not own_columns:
            return made.add_column(0, "raster_id", pa.repeat(table["raster_id"][0], len(made)))
        kept = table.select([n for n in names if n in table.column_names and n not in added])
        for name in names:
            if name in added:
                kept = kept.append_column(name, made[name])
        return kept.select(names).filter(pa.array(own))

    return map_tables(with_halo(g, side, 1), TILE_KEYS, run, schema)


def without_neighbors(g: DataFrame) -> DataFrame:
    return g.drop(*[f"n{i}" for i in range(8)])


def each_neighbor(make) -> list[Column]:
    """``make(struct, direction)`` for the eight neighbour columns."""
    return [make(F.col(f"n{i}"), i) for i in range(8)]


def height_mapping(g: DataFrame, mode: str) -> DataFrame:
    if mode == "bright_is_high":
        return g
    return g.withColumn("height", (F.lit(255.0).cast("float") - F.col("height")).cast("float"))


def is_close(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def valid_mask(g: DataFrame, preserve_nodata: bool = True, nodata_value: float | None = None) -> DataFrame:
    """Mark cells equal to the nodata value as invalid (gaps stay invalid)."""
    base = F.col("valid") if "valid" in g.columns else F.lit(True)
    if preserve_nodata and nodata_value is not None:
        base = base & ~is_close(F.col("height"), F.lit(float(nodata_value)))
    return g.withColumn("valid", base)


def apply_mask(g: DataFrame, mask: DataFrame, check_shape: bool = True) -> DataFrame:
    """AND a mask raster into ``valid``; a mask of another shape is an error."""
    if check_shape:
        ours, theirs = extent(g), extent(mask)
        both = ours.join(
            theirs.select("raster_id", F.col("n_rows").alias("m_rows"), F.col("n_cols").alias("m_cols")),
            "raster_id", "left",
        )
        differs = both.where("NOT (n_rows <=> m_rows AND n_cols <=> m_cols)")
        bad = differs.head()
        if bad is not None:
            raise ValueError(f"mask shape {bad.m_rows}x{bad.m_cols} differs from {bad.n_rows}x{bad.n_cols}")
    keep = mask.select(*KEYS, F.col("mask").alias("_mask")).hint("merge")
    return (
        g.join(keep, KEYS, "left")
        .withColumn("valid", F.col("valid") & F.coalesce("_mask", F.lit(False)))
        .drop("_mask")
    )


def roi(g: DataFrame, cfg: PreprocessConfig | None = None) -> DataFrame:
    """Bounding box of the valid cells plus margin, one row per raster."""
    cfg = cfg or PreprocessConfig()
    reach = cfg.smooth_kernel_size // 2 if cfg.smooth and cfg.smooth_kernel_size > 1 else 0
    margin = max(2, reach + 2)
    ok = F.col("valid")
    box = g.groupBy("raster_id").agg(
        F.max("row").alias("_lr"), F.max("col").alias("_lc"),
        F.min(F.when(ok, F.col("row"))).alias("_r0"), F.max(F.when(ok, F.col("row"))).alias("_r1"),
        F.min(F.when(ok, F.col("col"))).alias("_c0"), F.max(F.when(ok, F.col("col"))).alias("_c1"),
    )
    zero = F.lit(0)
    return box.select(
        "raster_id",
        F.coalesce(F.greatest(zero, F.col("_r0") - margin), zero).alias("row_start"),
        F.coalesce(F.least(F.col("_lr"), F.col("_r1") + margin), F.col("_lr")).alias("row_last"),
        F.coalesce(F.greatest(zero, F.col("_c0") - margin), zero).alias("col_start"),
        F.coalesce(F.least(F.col("_lc"), F.col("_c1") + margin), F.col("_lc")).alias("col_last"),
    )


def split_roi(g: DataFrame, cfg: PreprocessConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The cells inside and outside the region of interest."""
    boxed = attach(g, roi(g, cfg))
    inside = F.col("row").between(F.col("row_start"), F.col("row_last")) & F.col("col").between(
        F.col("col_start"), F.col("col_last")
    )
    return boxed.where(inside).select(*g.columns), boxed.where(~inside).select(*g.columns)


def crop(g: DataFrame, cfg: PreprocessConfig | None = None) -> DataFrame:
    return split_roi(g, cfg)[0]


def block_mean(g: DataFrame, scale: int) -> DataFrame:
    """Valid-aware block means; a coarse cell is valid when any fine cell is."""
    if scale <= 1:
        return g.select(*KEYS, F.col("height").cast("float").alias("height"), "valid")
    ok = F.col("valid")
    n = F.count_if(ok)
    return (
        g.groupBy("raster_id", F.expr(f"row div {scale}").cast("int").alias("row"),
                  F.expr(f"col div {scale}").cast("int").alias("col"))
        .agg(
            F.coalesce(F.sum(F.when(ok, F.col("height").cast("double"))) / n, F.lit(0.0)).cast("float").alias("height"),
            (n > 0).alias("valid"),
        )
    )


def analysis_scale(g: DataFrame) -> DataFrame:
    side = F.greatest("n_rows", "n_cols")
    scale = F.when(side <= ANALYSIS_MAX_SIDE, F.lit(1)).otherwise(
        F.greatest(F.lit(2), F.ceil(side / ANALYSIS_MAX_SIDE).cast("int"))
    )
    return extent(g).withColumn("scale", scale)


def upsample_mask(coarse: DataFrame, g: DataFrame, scale: int, layer: str = "mask") -> DataFrame:
    """Give each fine cell its block's value."""
    if scale <= 1:
        return g.join(coarse.select(*KEYS, layer).hint("merge"), KEYS, "left")
    block = coarse.select("raster_id", F.col("row").alias("_br"), F.col("col").alias("_bc"), layer)
    return (
        g.withColumn("_br", F.expr(f"row div {scale}").cast("int"))
        .withColumn("_bc", F.expr(f"col div {scale}").cast("int"))
        .join(block, ["raster_id", "_br", "_bc"], "left")
        .drop("_br", "_bc")
    )


def scale_area(pixels, scale) -> Column:
    """Area threshold in coarse cells."""
    pixels = pixels if isinstance(pixels, Column) else F.lit(pixels)
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return F.greatest(F.lit(1), F.ceil(pixels / (scale * scale)).cast("int"))


def _code_counts(codes: dict[str, list]) -> list[Column]:
    return [F.count_if(F.col(name) == code).alias(f"_{name}_{i}") for name, listed in codes.items() for i, code in enumerate(listed)]


def pyramid(g: DataFrame, max_side: int, means=("height",), codes: dict[str, list] | None = None, levels: int | None = None) -> DataFrame:
    """Layers at rising scales: ``raster_id, level, scale, row, col``, the layers and ``valid``.

    Level 0 has the smallest block side by which the longest side fits ``max_side``; each level
    doubles it, up to ``levels`` (None: until one cell is left).  ``means`` are averaged over
    valid cells (0 where there are none); ``codes`` lists the values of a layer, of which the
    most frequent wins (ties: the first listed; NULL where none occurs).  Without a ``valid``
    column every cell counts.  Cells are read once; a level is added up from the one before, so all are exact.
    """
    codes = codes or {}
    side = F.greatest("n_rows", "n_cols")
    scale = F.greatest(F.lit(1), F.ceil(side / max_side).cast("int"))
    top = F.greatest(F.lit(0), F.ceil(F.log2(side / scale)).cast("int"))
    sizes = cut(extent(g).select("raster_id", scale.alias("scale"), top.alias("_top")))
    ok = F.col("valid") if "valid" in g.columns else F.lit(True)
    sums = [F.sum(F.when(ok, F.col(m).cast("double"))).alias(f"_{m}") for m in means]
    block = lambda name, step: F.floor(F.col(name) / step).cast("int").alias(name)
    level = attach(g, sizes).withColumn("valid", ok).groupBy(
        "raster_id", "scale", "_top", block("row", F.col("scale")), block("col", F.col("scale"))).agg(F.count_if("valid").alias("_n"), *sums, *_code_counts(codes))
    level = cut(level)
    held = [c for c in level.columns if c not in ("raster_id", "scale", "_top", "row", "col")]
    deepest = sizes.agg(F.max("_top")).first()[0] or 0
    stack = [level.withColumn("level", F.lit(0))]
    for number in range(1, min(deepest + 1, levels if levels is not None else deepest + 1)):
        level = cut(level.where(F.col("_top") >= number).groupBy(
            "raster_id", (F.col("scale") * 2).alias("scale"), "_top", block("row", 2), block("col", 2)).agg(*[F.sum(c).alias(c) for c in held]))
        stack.append(level.withColumn("level", F.lit(number)))
    every = stack[0]
    for one in stack[1:]:
        every = every.unionByName(one)
    n = F.col("_n")
    mean = lambda m: F.coalesce(F.col(f"_{m}") / F.when(n > 0, n), F.lit(0.0)).cast("float").alias(m)

    def winner(name, listed):
        most = F.greatest(*[F.col(f"_{name}_{i}") for i in range(len(listed))])
        pick = F.when(most == 0, None)
        for i, code in enumerate(listed):
            pick = pick.when(F.col(f"_{name}_{i}") == most, F.lit(code))
        return pick.alias(name)

    return every.select("raster_id", "level", "scale", "row", "col", *[mean(m) for m in means],
                        *[winner(name, listed) for name, listed in codes.items()], (n > 0).alias("valid"))


def overview(g: DataFrame, max_side: int, means=("height",), codes: dict[str, list] | None = None) -> DataFrame:
    """Shrink the layers of each raster until its longest side fits ``max_side`` (level 0 of ``pyramid``)."""
    return pyramid(g, max_side, means, codes, levels=1).drop("level", "scale")


def edge_contact(g: DataFrame) -> DataFrame:
    """``edge_contact``: valid cells with a neighbour off the grid or invalid."""
    def contact(table, near, own):
        valid = kernels.layer(table, "valid", False)
        touches = ~(valid[near] & (near >= 0)).all(axis=0)
        return {"edge_contact": pc.and_kleene(table["valid"].combine_chunks(), pa.array(touches))}

    return from_neighbors(g, contact, edge_contact="boolean")


def border_values(g: DataFrame) -> DataFrame:
    """Valid values along the raster border, corners twice; all valid values if there are none."""
    boxed = attach(g.where("valid"), extent(g))
    times = (
        (F.col("row") == 0).cast("int") + (F.col("row") == F.col("n_rows") - 1).cast("int")
        + (F.col("col") == 0).cast("int") + (F.col("col") == F.col("n_cols") - 1).cast("int")
    )
    marked = boxed.withColumn("_times", times)
    has_border = marked.groupBy("raster_id").agg((F.max("_times") > 0).alias("_border"))
    repeated = attach(marked, has_border).withColumn(
        "_times", F.when(F.col("_border"), F.col("_times")).otherwise(1)
    )
    return repeated.where("_times > 0").select(
        "raster_id", "row", "col", "height", F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_one")
    ).drop("_one")

