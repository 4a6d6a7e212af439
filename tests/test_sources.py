import os
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrospark.config import STAGES, ChannelExtractConfig, FlowDirectionConfig, PipelineConfig, PreprocessConfig
from hydrospark.operators import grid, render
from hydrospark.plans.pipeline import run_pipeline
from hydrospark.scratch import cut, scratch_scope
from hydrospark.sources import rasters, stages

# A valley like the reference sample: plain PGM text with comment lines.
LINES = ["P2", "# valley", "# lower is lower", "8 8", "255"] + [
    " ".join(str(abs(r - 4) * 9 + (7 - c) * 3 + 5) for c in range(8)) for r in range(8)
]


@pytest.fixture
def picture(tmp_path):
    (tmp_path / "valley.pgm").write_text("\n".join(LINES) + "\n")
    (tmp_path / "raw.pgm").write_bytes(b"P5 3 2 255\n" + bytes([0, 1, 2, 3, 4, 250]))
    return tmp_path


def test_pgm_text_and_binary(spark, picture):
    text = rasters.read_rasters(spark, str(picture / "valley.pgm"), "pgm")
    assert text.count() == 64
    assert text.where("row = 4 AND col = 7").first()["height"] == 5.0
    raw = rasters.read_rasters(spark, str(picture / "raw.pgm"), "pgm").orderBy("row", "col")
    assert [r["height"] for r in raw.collect()] == [0, 1, 2, 3, 4, 250]
    mask = rasters.read_masks(spark, str(picture / "raw.pgm"), "pgm")
    assert mask.where("mask").count() == 5


def test_bmp_through_the_image_source(spark, tmp_path):
    # 2x2, 24 bit: bottom row first, blue-green-red, rows padded to 4 bytes.
    body = bytes([255, 0, 0, 0, 255, 0, 0, 0]) + bytes([0, 0, 255, 255, 255, 255, 0, 0])
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "dots.bmp").write_bytes(head + info + body)
    cells = rasters.read_rasters(spark, str(tmp_path / "dots.bmp"))
    got = {(r["row"], r["col"]): r["height"] for r in cells.collect()}
    assert got == {(0, 0): 76.0, (0, 1): 255.0, (1, 0): 29.0, (1, 1): 150.0}


def png(rows, kind):
    """A PNG of 8-bit pixels: kind 0 gray, 2 colour, 6 colour with alpha."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)
    flat = b"".join(b"\0" + bytes(v for px in row for v in (px if isinstance(px, tuple) else (px,))) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(flat)) + chunk(b"IEND", b"")


def test_colours_and_alpha_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rasters, "STRIP_BYTES", 8)
    shown = {"gray": ([[1, 200], [3, 4], [5, 6]], 0), "colour": ([[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (10, 20, 30)]], 2),
             "clear": ([[(255, 0, 0, 7), (0, 0, 255, 255)], [(9, 9, 9, 0), (1, 2, 3, 128)]], 6)}
    for name, (rows, kind) in shown.items():
        (tmp_path / f"{name}.png").write_bytes(png(rows, kind))
    got = {}
    for r in rasters.read_rasters(spark, str(tmp_path / "*.png"), short_names=True, colors=True).collect():
        got[r["raster_id"], r["row"], r["col"]] = (r["height"], r["r"], r["g"], r["b"], r["a"])
    for name, (rows, kind) in shown.items():
        for i, row in enumerate(rows):
            for j, px in enumerate(row):
                r, g, b, a = (px, px, px, 255) if kind == 0 else (*px, 255)[:4]
                gray = px if kind == 0 else (19595 * r + 38470 * g + 7471 * b + 32768) >> 16
                assert got.pop((name, i, j)) == (gray, r, g, b, a)
    assert not got
    both = rasters.read_rasters(spark, str(tmp_path / "colour.png"), short_names=True, colors=True)
    mask = both.select("raster_id", "row", "col", (F.col("row") == 0).alias("mask"))
    seen = {(r["row"], r["col"]): (r["r"], r["g"], r["b"], r["a"]) for r in render.render_input(both, mask).collect()}
    assert seen == {(0, 0): (255, 0, 0, 255), (0, 1): (0, 255, 0, 255), (1, 0): (0, 0, 0, 0), (1, 1): (0, 0, 0, 0)}


def test_a_raw_gray_map_is_read_in_strips(spark, tmp_path, monkeypatch):
    wide = np.arange(40 * 7).reshape(40, 7) * 200
    (tmp_path / "deep.pgm").write_bytes(b"P5 7 40 65535\n" + wide.astype(">u2").tobytes())
    (tmp_path / "cut.pgm").write_bytes(b"P5 7 40 65535\n" + wide.astype(">u2").tobytes()[:-2])
    monkeypatch.setattr(rasters, "STRIP_BYTES", 60)
    plan = [(s["kind"], s["first"], s["rows"], s["start"]) for s in rasters._plan_strips(iter([pd.DataFrame(
        {"raster_id": ["d"], "path": [f"file:{tmp_path}/deep.pgm"], "length": [574]})])).__next__().to_dict("records")]
    assert plan == [("P5", i, 4, 14 + i * 14) for i in range(0, 40, 4)]
    # A file far above 2 GB is planned from its head alone.
    (tmp_path / "huge.pgm").write_bytes(b"P5 100000 100000 255\n")
    monkeypatch.setattr(rasters, "STRIP_BYTES", 8 << 20)
    huge = rasters.pgm_strips(spark, str(tmp_path / "huge.pgm"))
    assert huge.count() > 1000 and huge.agg(F.sum("rows"), F.sum("bytes")).first()[:] == (100_000, 10**10)
    got = {(r["row"], r["col"]): r["height"] for r in rasters.read_rasters(spark, str(tmp_path / "deep.pgm"), "pgm").collect()}
    assert got == {(i, j): float(wide[i, j] * 255 // 65535) for i in range(40) for j in range(7)}
    with pytest.raises(Exception, match="ends before its last row"):
        rasters.read_rasters(spark, str(tmp_path / "cut.pgm"), "pgm").collect()


def test_catalog_lists_files(spark, picture):
    os.utime(picture / "valley.pgm", (1_000_000, 1_000_000))
    found = rasters.raster_catalog(spark, str(picture / "*.pgm"), "input").collect()
    assert [r["filename"] for r in found] == ["raw.pgm", "valley.pgm"]  # newest first
    assert {r["filename"] for r in found} == {"valley.pgm", "raw.pgm"} and all(r["size_bytes"] > 0 for r in found)


def test_reusable_prefix():
    assert stages.reusable_prefix(["io", "preprocess"]) == ["io", "preprocess"]
    assert stages.reusable_prefix(["io", "flow_direction"]) == ["io"]
    assert stages.reusable_prefix(["io", "preprocess"], ["preprocess"]) == []
    assert stages.reusable_prefix(["io", "preprocess"], inherit=False) == []


def test_pause_continue_and_reuse(spark, picture, tmp_path):
    run_dir = str(tmp_path / "run")
    cells = rasters.read_rasters(spark, str(picture / "valley.pgm"), "pgm")
    cfg = PipelineConfig(preprocess=PreprocessConfig(fill_sink_algorithm="priority_flood"))
    first = run_pipeline(cells, run_dir, cfg, end_stage="preprocess")
    assert first.completed == ["io", "preprocess"]
    again = run_pipeline(cells, run_dir, cfg, end_stage="preprocess")
    assert again.ran == [] and "already available" in again.message
    on = run_pipeline(cells, run_dir, cfg, end_stage="flow_direction")
    assert on.ran == ["flow_direction"] and on.completed == ["io", "preprocess", "flow_direction"]
    out = str(tmp_path / "out")
    partial = run_pipeline(cells, run_dir, cfg, inherit_stage_outputs=["io", "preprocess"], output_path=out)
    assert partial.ran == ["flow_direction", "flow_accumulation", "channel_extract"]
    assert spark.read.parquet(out).count() == 64
    tables = {s: stages.read_stage(spark, run_dir, s) for s in partial.completed}
    ready = {r["layer"]: r["status"] for r in stages.layer_catalog(tables).collect()}
    assert ready["channel_mask"] == "ready" and ready["user_mask"] == "pending"
    where = {r["layer"]: (r["path"], r["preview_path"]) for r in stages.layer_catalog(tables, run_dir=run_dir).collect()}
    assert where["flow_direction"] == (f"{run_dir}/flow_direction", f"{run_dir}/previews/flow_direction")
    assert where["user_mask"] == (None, None)
    assert stages.read_preview(spark, run_dir, "channel_mask").count() == 64
    fresh = run_pipeline(cells, run_dir, cfg, end_stage="io", inherit=False)
    assert fresh.ran == ["io"] and fresh.completed == ["io"]


def test_a_changed_setting_or_input_reruns_from_the_first_touched_stage(spark, picture, tmp_path):
    run_dir = str(tmp_path / "run")
    cells = rasters.read_rasters(spark, str(picture / "valley.pgm"), "pgm")
    cfg = lambda t, w=1.0: PipelineConfig(
        preprocess=PreprocessConfig(fill_sink_algorithm="priority_flood"), flow_direction=FlowDirectionConfig(slope_weight=w),
        channel_extract=ChannelExtractConfig(t))
    run = lambda c, config: run_pipeline(c, run_dir, config, previews=False).ran
    assert run(cells, cfg(5)) == STAGES
    assert run(cells.repartition(3), cfg(5)) == []
    assert run(cells, cfg(6)) == ["channel_extract"]
    assert run(cells, cfg(6, 2.0)) == STAGES[2:]
    assert run(cells.withColumn("height", F.col("height") + 1), cfg(6, 2.0)) == STAGES
    # A stage whose manifest was never written is not finished.
    stages.write_text(spark, f"{run_dir}/flow_direction/{stages.MANIFEST}", '{"fingerprint": null}')
    assert run(cells.withColumn("height", F.col("height") + 1), cfg(6, 2.0)) == STAGES[2:]


def test_scratch_tables_end_with_their_own_scope(spark):
    table = spark.range(3)
    with scratch_scope(spark):
        outer = cut(table)
        with scratch_scope(spark):
            inner = cut(table)
            paths = [df.inputFiles()[0] for df in (outer, inner)]
        assert outer.count() == 3
        there = lambda p: spark._jvm.java.io.File(p.removeprefix("file://").removeprefix("file:")).exists()
        assert there(paths[0]) and not there(paths[1])
    assert not there(paths[0]) and cut(table).count() == 3


def test_previews_fit_their_side(spark, cells):
    table = cells(height=np.arange(600 * 3).reshape(3, 600) % 256)
    small = grid.overview(table.select("raster_id", "row", "col", F.col("height").alias("gray")), 512, means=("gray",))
    assert small.agg(F.max("col")).first()[0] == 299 and small.where("row = 0 AND col = 0").first()["gray"] == (0 + 1 + 88 + 89) / 4


def test_raster_ids_do_not_collide(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.pgm").write_bytes(b"P5 2 1 255\n" + bytes([7, 8]))
    both = str(tmp_path / "*" / "x.pgm")
    assert rasters.read_rasters(spark, both, "pgm").select("raster_id").distinct().count() == 2
    with pytest.raises(ValueError, match="x"):
        rasters.read_rasters(spark, both, "pgm", short_names=True)
    one = rasters.read_rasters(spark, str(tmp_path / "a" / "x.pgm"), "pgm", short_names=True)
    assert {r["raster_id"] for r in one.collect()} == {"x"}


def test_unreadable_image_raises(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"not an image")
    with pytest.raises(Exception, match="not a readable image"):
        rasters.read_rasters(spark, str(tmp_path / "broken.png")).collect()


def test_values_that_are_no_numbers_are_invalid(spark):
    table = spark.createDataFrame([(0, 0, float("nan")), (0, 1, 3.0), (0, 2, float("inf")), (0, 3, None)], "y int, x int, z double")
    got = [(r["height"], r["valid"]) for r in rasters.cells_from_table(table, "y", "x", "z").orderBy("col").collect()]
    assert got == [(0.0, False), (3.0, True), (0.0, False), (None, True)]


def test_layer_sizes_are_per_raster(spark):
    cells = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 4, 1, 1.0), ("q", 1, 6, 1.0)], "raster_id string, row int, col int, height float")
    found = {(r["raster_id"], r["layer"]): (r["width"], r["height"]) for r in stages.layer_catalog({"io": cells}).collect()}
    assert found["p", "input_preview"] == (2, 5) and found["q", "input_preview"] == (7, 2)
    assert found["q", "channel_mask"] == (None, None)
