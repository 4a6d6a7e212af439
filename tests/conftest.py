import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiles(spark):
    """Set tile side and fan for one test, so that small grids cross tile borders."""
    def use(side, fan=8):
        spark.conf.set("spark.hydrospark.tileSide", str(side))
        spark.conf.set("spark.hydrospark.tileFan", str(fan))
    use(64)
    yield use
    use(64)


@pytest.fixture
def cells(spark):
    """Cell table from named 2-D arrays: cells(height=[[...]], valid=...)."""
    kinds = {"height": "float", "texture_height": "float", "valid": "boolean", "direction": "int", "accumulation": "long", "mask": "boolean"}

    def make(raster_id="a", **layers):
        layers = {k: np.asarray(v) for k, v in layers.items()}
        shape = next(iter(layers.values())).shape
        layers.setdefault("valid", np.ones(shape, dtype=bool))
        rows = [
            (raster_id, r, c, *[layers[k][r, c].item() if kinds[k] != "float" else float(layers[k][r, c]) for k in layers])
            for r in range(shape[0]) for c in range(shape[1])
        ]
        if "accumulation" in layers or "direction" in layers or "mask" in layers:
            rows = [tuple(bool(x) if k in ("valid", "mask") else x for k, x in zip(["i", "r", "c", *layers], row)) for row in rows]
        schema = "raster_id string, row int, col int, " + ", ".join(f"{k} {kinds[k]}" for k in layers)
        return spark.createDataFrame(rows, schema)

    return make


def grid_of(df, name):
    """Layer of a one-raster cell table as {(row, col): value}."""
    return {(r["row"], r["col"]): r[name] for r in df.select("row", "col", name).collect()}
