"""The cell table: one row per raster cell, keyed by (raster_id, row, col).

A raster is dense inside its bounding box; cells without data are present with
``valid = false``.  ``cell_id`` packs (row, col) into one BIGINT whose order is
the row-major scan order, which is the tie-break order of every operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ["raster_id", "row", "col"]
TILE_KEYS = ["raster_id", "trow", "tcol"]

# The eight directions, code 0..7, as (row step, column step).
D8_STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
# Length of one step in each direction (single precision).
SQRT2 = 1.4142135
D8_LENGTHS = [1.0, SQRT2, 1.0, SQRT2, 1.0, SQRT2, 1.0, SQRT2]


def cell_id(row="row", col="col") -> Column:
    row = F.col(row) if isinstance(row, str) else row
    col = F.col(col) if isinstance(col, str) else col
    return F.shiftleft(row.cast("bigint"), 32) + col.cast("bigint")


def id_row(cid) -> Column:
    cid = F.col(cid) if isinstance(cid, str) else cid
    return F.shiftright(cid, 32).cast("int")


def id_col(cid) -> Column:
    cid = F.col(cid) if isinstance(cid, str) else cid
    return cid.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).cast("int")


def step_row(direction: Column) -> Column:
    return _by_direction(direction, [s[0] for s in D8_STEPS])


def step_col(direction: Column) -> Column:
    return _by_direction(direction, [s[1] for s in D8_STEPS])


def _by_direction(direction: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (direction + 1).cast("int"))
