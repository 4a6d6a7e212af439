"""Square tiles with a halo: the unit of bounded local work.

Any group that leaves this module holds at most (side + 2*halo)^2 cells,
however large a raster, a lake or a river basin is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.schema import TILE_KEYS
from hydrospark.scratch import BROADCAST_ROWS, cut

DEFAULT_SIDE = 256
DEFAULT_FAN = 8


def tile_side(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.hydrospark.tileSide", str(DEFAULT_SIDE)))


def tile_fan(spark: SparkSession) -> int:
    """Tiles per side of one super-tile (second level of the two-level solvers)."""
    return int(spark.conf.get("spark.hydrospark.tileFan", str(DEFAULT_FAN)))


#: Widest square of cells, in cells a side, whose rim labels or gates one task may hold.
WIDEST_SQUARE = 2048


def next_square(spark: SparkSession, side: int) -> int | None:
    """Side of the square that holds ``fan`` squares of ``side`` cells a side; None where joins must go on."""
    wider = side * max(2, tile_fan(spark))
    return wider if wider <= WIDEST_SQUARE else None


def tile_of(position, side: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / side).cast("int")


def with_tile(g: DataFrame, side: int) -> DataFrame:
    return g.withColumn("trow", tile_of("row", side)).withColumn("tcol", tile_of("col", side))


def with_halo(g: DataFrame, side: int, halo: int) -> DataFrame:
    """Send every cell to its own tile and to each tile whose halo covers it."""

    def covered(axis):
        return F.explode(F.sequence(tile_of(F.col(axis) - halo, side), tile_of(F.col(axis) + halo, side)))

    out = g.withColumn("trow", covered("row")).where("trow >= 0")
    return out.withColumn("tcol", covered("col")).where("tcol >= 0")


def own_cells(side: int) -> Column:
    return (tile_of("row", side) == F.col("trow")) & (tile_of("col", side) == F.col("tcol"))


def on_tile_border(side: int, row="row", col="col") -> Column:
    r, c = F.col(row) % side, F.col(col) % side
    return r.isin(0, side - 1) | c.isin(0, side - 1)


def lookup_by_tile(g: DataFrame, stats: DataFrame, key: str, side: int) -> DataFrame:
    """Left-join ``stats`` (unique per raster and ``key``) onto the cells.

    A region can hold a third of all cells.  The cells are first reduced to distinct
    (tile, key) pairs and those to (super-tile, key) pairs; the latter fetch the values,
    the tiles read them per super-tile and the cells per tile.  A join key carries at most
    one tile of cells, one super-tile of tiles, or one row for each super-tile of a region.
    """
    fan = tile_fan(g.sparkSession)
    tiled = with_tile(g, side)
    pairs = tiled.where(F.col(key).isNotNull()).select(*TILE_KEYS, key).distinct()
    pairs = pairs.withColumn("_srow", tile_of("trow", fan)).withColumn("_scol", tile_of("tcol", fan))
    wide = pairs.select("raster_id", "_srow", "_scol", key).distinct().join(stats, ["raster_id", key])
    pairs = pairs.join(wide, ["raster_id", "_srow", "_scol", key]).drop("_srow", "_scol")
    return tiled.join(pairs, [*TILE_KEYS, key], "left").drop("trow", "tcol")


# A table counted below this cannot hold a key too hot for one task.
PLAIN_JOIN_ROWS = 1_000_000


def lookup_salted(
    big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 64, rows: int | None = None
) -> DataFrame:
    """Left-join on keys that may be hot, spreading each key over ``salts`` groups.

    ``rows`` is the counted size of ``big``, if known; few rows need no salt.
    """
    if rows is not None and rows <= PLAIN_JOIN_ROWS:
        return big.join(small, keys, "left")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    pairs = salted.select(*keys, "_salt").distinct().join(small, keys)
    return salted.join(pairs, [*keys, "_salt"], "left").drop("_salt")


def attach(big: DataFrame, small: DataFrame, spread=None) -> DataFrame:
    """Join one row of statistics per raster onto its cells.

    The statistics are written first; they are broadcast only when their counted
    rows stay below ``BROADCAST_ROWS``, otherwise the cells are salted.
    """
    small, seen = cut(small, n=F.count("*"))
    if seen["n"] <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), "raster_id", "left")
    spread = F.struct("row", "col") if spread is None else spread
    return lookup_salted(big, small, ["raster_id"], spread)

