"""Reading rasters, masks and cell tables."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.grouped import ship_package
from hydrospark.schema import KEYS

CELLS = "raster_id string, row int, col int, height float, valid boolean"
COLORS = CELLS + ", r int, g int, b int, a int"
STRIP_BYTES = 8 << 20
#: Stores whose byte ranges a task can read by itself; files elsewhere come whole, through Spark (2 GB at most).
RANGED = ("file", "hdfs", "s3", "gs", "abfs")


def raster_name(path: str = "path") -> Column:
    """File name without folder and ending; files of one name get one id (see ``read_rasters``)."""
    return F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]+)?$", 1)


def _named(files: DataFrame, path: str, short_names: bool) -> Column:
    """The raster id of a file: its path, or its name, which then must be its own."""
    if not short_names:
        return F.col(path)
    twice = files.groupBy(raster_name(path).alias("name")).agg(F.count_distinct(path).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several files are named {', '.join(r['name'] for r in twice)}")
    return raster_name(path)


def read_rasters(spark: SparkSession, path: str, format: str = "image", short_names: bool = False, colors: bool = False) -> DataFrame:
    """Cells of gray or colour images: ``image`` (PNG, JPEG, BMP) or ``pgm``.

    Colours become gray by (19595 R + 38470 G + 7471 B + 32768) >> 16; with ``colors`` the columns
    ``r, g, b, a`` keep them (gray images: three equal ones; without alpha: 255).  A raster's id is its
    path; with ``short_names`` its file name, and two files of one name raise.  An image that can't be read
    raises.  An image of the first kind must fit a row (2 GB); a raw PGM of any size is read in strips.
    """
    if format == "pgm":
        cells = _read_pgm(spark, path, short_names)
        return cells.select("*", *[F.col("height").cast("int").alias(c) for c in "rgb"], F.lit(255).alias("a")) if colors else cells
    if format != "image":
        raise ValueError("format must be 'image' or 'pgm'")
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    unreadable = F.raise_error(F.concat(F.lit("not a readable image: "), F.col("origin"))).cast("int")
    images = images.withColumn("width", F.when((F.col("width") > 0) & (F.col("nChannels") > 0), F.col("width")).otherwise(unreadable))
    # Strips of some rows first, so that a large image spreads before its pixels are unpacked.
    rows = F.greatest(F.lit(1), F.floor(F.lit(STRIP_BYTES) / (F.col("width") * F.col("nChannels"))).cast("int"))
    sized = images.select(_named(images, "origin", short_names).alias("raster_id"), "width", "height", "nChannels", "data", rows.alias("rows"))
    strips = sized.select("raster_id", "width", "nChannels", F.explode(F.expr(
        "transform(sequence(0, height - 1, rows), r -> struct(r AS first, substring(data, r * width * nChannels + 1, rows * width * nChannels) AS strip))")).alias("s"))
    strips = strips.select("raster_id", "width", "nChannels", "s.*").repartition("raster_id", "first")
    ship_package(spark)
    cells = strips.mapInPandas(_unpack_image, COLORS)
    return cells if colors else cells.drop("r", "g", "b", "a")


def _cells_of(name: str, first: int, bands: dict[str, np.ndarray]) -> pd.DataFrame:
    shape = next(iter(bands.values())).shape
    r, c = np.indices(shape)
    return pd.DataFrame({"raster_id": name, "row": (r + first).ravel(), "col": c.ravel(), "valid": True} | {k: v.ravel() for k, v in bands.items()})


def _unpack_image(batches):
    for batch in batches:
        for name, width, channels, first, strip in zip(*(batch[c] for c in ("raster_id", "width", "nChannels", "first", "strip"))):
            px = np.frombuffer(strip, np.uint8).reshape(-1, width, channels).astype(np.int32)
            # Colour bytes are stored blue, green, red, and alpha where there is one.
            b, g, r = (px[:, :, i] for i in ((0, 1, 2) if channels >= 3 else (0, 0, 0)))
            gray = (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 if channels >= 3 else r
            alpha = px[:, :, 3] if channels == 4 else np.full(gray.shape, 255, np.int32)
            yield _cells_of(name, first, {"height": gray.astype(np.float32), "r": r, "g": g, "b": b, "a": alpha})[
                ["raster_id", "row", "col", "height", "valid", *"rgba"]]


PGM_HEAD = re.compile(rb"(P[25])(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)\s")


def _head(start: bytes):
    """Kind, width, height, highest value and where the values begin."""
    head = PGM_HEAD.match(start)
    if head is None:
        raise ValueError("not a P2 or P5 gray map")
    return head.group(1).decode(), *(int(head.group(i)) for i in (2, 3, 4)), head.end()


def _gray(kind: str, body: bytes, width: int, rows: int, top: int) -> np.ndarray:
    if kind == "P2":
        values = np.array(re.sub(rb"#[^\n]*", b"", body).split(), dtype=np.int64)
    else:
        values = np.frombuffer(body, dtype=np.uint8 if top < 256 else ">u2", count=width * rows).astype(np.int64)
    values = values.reshape(rows, width)
    return values if top == 255 else values * 255 // top


def _open(path: str):
    store, inside = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return store.open_input_file(inside)


STRIPS = "raster_id string, path string, kind string, width int, top int, first int, rows int, start long, bytes long"


def _plan_strips(batches):
    """The strips of each file, from its head alone; text files are one strip, as their rows lie anywhere."""
    for batch in batches:
        out = []
        for name, path, length in zip(batch["raster_id"], batch["path"], batch["length"]):
            with _open(path) as file:
                kind, width, height, top, start = _head(file.read_at(min(int(length), 1 << 16), 0))
            if kind == "P2":
                out.append((name, path, kind, width, top, 0, height, start, int(length) - start))
                continue
            line = width * (1 if top < 256 else 2)
            rows = max(1, STRIP_BYTES // line)
            out += [(name, path, kind, width, top, first, min(rows, height - first), start + first * line, min(rows, height - first) * line)
                    for first in range(0, height, rows)]
        yield pd.DataFrame(out, columns=["raster_id", "path", "kind", "width", "top", "first", "rows", "start", "bytes"])


def _read_strips(batches):
    for batch in batches:
        for s in batch.itertuples(index=False):
            with _open(s.path) as file:
                body = file.read_at(s.bytes, s.start)
            if len(body) < s.bytes:
                raise ValueError(f"{s.path} ends before its last row")
            gray = _gray(s.kind, body, s.width, s.rows, s.top)
            yield _cells_of(s.raster_id, s.first, {"height": gray.astype(np.float32)})[["raster_id", "row", "col", "height", "valid"]]


def _read_whole(batches):
    for batch in batches:
        for name, content in zip(batch["raster_id"], batch["content"]):
            kind, width, height, top, start = _head(content)
            gray = _gray(kind, content[start:], width, height, top).astype(np.float32)
            rows = max(1, STRIP_BYTES // width)
            for first in range(0, height, rows):
                yield _cells_of(name, first, {"height": gray[first:first + rows]})[["raster_id", "row", "col", "height", "valid"]]


def pgm_strips(spark: SparkSession, path: str, short_names: bool = False) -> DataFrame:
    """One row per strip of some 8 MB, each read by a task of its own."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    named = files.select(_named(files, "path", short_names).alias("raster_id"), "path", "length")
    ship_package(spark)
    return named.mapInPandas(_plan_strips, STRIPS)


def _read_pgm(spark: SparkSession, path: str, short_names: bool) -> DataFrame:
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path)
    ranged = F.regexp_extract("path", "^([a-z0-9]+):", 1).isin(*RANGED)
    if files.select("path").where(~ranged).isEmpty():
        return pgm_strips(spark, path, short_names).repartition("path", "first").mapInPandas(_read_strips, CELLS)
    whole = files.select(_named(files.select("path"), "path", short_names).alias("raster_id"), "content")
    return whole.mapInPandas(_read_whole, CELLS)


def read_masks(spark: SparkSession, path: str, format: str = "image") -> DataFrame:
    """Mask cells: any non-zero gray is inside."""
    return as_mask(read_rasters(spark, path, format))


def as_mask(g: DataFrame, value: str = "height") -> DataFrame:
    return g.select(*KEYS, (F.col(value) > 0).alias("mask"))


def cells_from_table(df: DataFrame, row, col, height, raster_id="raster", valid=True) -> DataFrame:
    """Cell table from any table with row, column and value expressions; NaN and infinite values are invalid."""
    as_col = lambda x: F.expr(x) if isinstance(x, str) else x
    name = raster_id if isinstance(raster_id, Column) else F.lit(raster_id)
    ok = valid if isinstance(valid, Column) else F.lit(valid)
    value = as_col(height).cast("float")
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(True))
    return df.select(
        name.cast("string").alias("raster_id"), as_col(row).cast("int").alias("row"), as_col(col).cast("int").alias("col"),
        F.when(finite, value).otherwise(F.lit(0.0).cast("float")).alias("height"), (ok & finite).alias("valid"),
    )


def raster_catalog(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Input or mask files, newest first; file contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.lit(kind).alias("kind"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("path").alias("stored_path"),
        F.col("length").alias("size_bytes"), "modificationTime",
    ).orderBy(F.desc("modificationTime"), "filename")
