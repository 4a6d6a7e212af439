"""Stage tables of a run, their catalogue, and which of them a run may reuse."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.config import LAYERS, STAGES, PipelineConfig
from hydrospark.tiling import tile_of, tile_side

MANIFEST = "_run.json"  # written last, beside a stage's table

# Layer -> column of its stage table.
LAYER_COLUMNS = {
    "input_preview": "height", "user_mask": "mask", "auto_mask": "auto_mask", "terrain_preprocessed": "height",
    "fill_depth": "fill_depth", "flow_direction": "direction", "flow_accumulation": "accumulation", "channel_mask": "channel",
}


def stage_path(run_dir: str, stage: str) -> str:
    return f"{run_dir.rstrip('/')}/{stage}"


def content_fingerprint(df: DataFrame) -> str:
    """What a table holds, whatever the order of its rows: their number and two folds of their hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    seen = df.select(h.alias("h")).agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(2**31))).alias("s")).first()
    return f"{','.join(sorted(df.columns))}:{seen['n']}:{seen['x']}:{seen['s']}"


def stage_fingerprints(inputs: str, cfg: PipelineConfig) -> dict[str, str]:
    """What each stage's table depends on: the input, and the settings of this stage and those before."""
    parts = {"io": inputs, "preprocess": asdict(cfg.preprocess), "flow_direction": asdict(cfg.flow_direction),
             "flow_accumulation": None, "channel_extract": asdict(cfg.channel_extract)}
    out, before = {}, ""
    for stage in STAGES:
        before = hashlib.sha256(json.dumps([before, stage, parts[stage]], sort_keys=True).encode()).hexdigest()
        out[stage] = before
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _filesystem(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _filesystem(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_stage(df: DataFrame, run_dir: str, stage: str, fingerprint: str | None = None) -> DataFrame:
    """Write one stage table and read it back.

    Split by raster, dealt by tile and sorted by tile and cell, so that a file holds whole tiles and its
    row groups' statistics let a region of interest pass by most of them.  The manifest
    with the fingerprint comes last: without it the stage counts as unfinished.
    """
    spark, path = df.sparkSession, stage_path(run_dir, stage)
    side = tile_side(spark)
    tile = [tile_of("row", side), tile_of("col", side)]
    dealt = df.repartition("raster_id", *tile).sortWithinPartitions("raster_id", *tile, "row", "col")
    dealt.write.mode("overwrite").partitionBy("raster_id").parquet(path)
    write_text(spark, f"{path}/{MANIFEST}", json.dumps({"stage": stage, "fingerprint": fingerprint}))
    return read_stage(spark, run_dir, stage)


def read_stage(spark: SparkSession, run_dir: str, stage: str) -> DataFrame:
    table = spark.read.option("basePath", stage_path(run_dir, stage)).parquet(stage_path(run_dir, stage))
    rest = [c for c in table.columns if c != "raster_id"]
    return table.select(F.col("raster_id").cast("string").alias("raster_id"), *rest)


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def stage_done(spark: SparkSession, run_dir: str, stage: str, fingerprint: str | None = None) -> bool:
    """Whether the stage's manifest is there and, if a fingerprint is given, carries it."""
    text = read_text(spark, f"{stage_path(run_dir, stage)}/{MANIFEST}")
    return text is not None and (fingerprint is None or json.loads(text)["fingerprint"] == fingerprint)


def drop_stage(spark: SparkSession, run_dir: str, stage: str) -> None:
    fs, path = _filesystem(spark, stage_path(run_dir, stage))
    fs.delete(path, True)


def completed_stages(spark: SparkSession, run_dir: str, fingerprints: dict[str, str] | None = None) -> list[str]:
    return [s for s in STAGES if stage_done(spark, run_dir, s, (fingerprints or {}).get(s))]


def preview_path(run_dir: str, layer: str) -> str:
    return f"{run_dir.rstrip('/')}/previews/{layer}"


def write_preview(pixels: DataFrame, run_dir: str, layer: str) -> None:
    pixels.write.mode("overwrite").partitionBy("raster_id").parquet(preview_path(run_dir, layer))


def read_preview(spark: SparkSession, run_dir: str, layer: str) -> DataFrame:
    table = spark.read.parquet(preview_path(run_dir, layer))
    return table.select(F.col("raster_id").cast("string").alias("raster_id"), *[c for c in table.columns if c != "raster_id"])


def reusable_prefix(completed, allowed=None, inherit: bool = True) -> list[str]:
    """Longest run of leading stages that are completed and allowed."""
    if not inherit:
        return []
    keep = set(completed) & set(completed if allowed is None else allowed)
    prefix = []
    for stage in STAGES:
        if stage not in keep:
            break
        prefix.append(stage)
    return prefix


def layer_catalog(tables: dict[str, DataFrame], spark: SparkSession | None = None, run_dir: str | None = None) -> DataFrame:
    """One row per raster and expected layer: stage, status and size, from stage tables by name.

    With ``run_dir`` also where a ready layer's table and its preview lie (``path``, ``preview_path``).
    """
    spark = spark or next(iter(tables.values())).sparkSession
    expected = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(LAYERS)], "position int, layer string, stage string")
    found = None
    for layer, stage in LAYERS:
        table = tables.get(stage)
        if table is None or LAYER_COLUMNS[layer] not in table.columns:
            continue
        size = table.groupBy("raster_id").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height")).withColumn("layer", F.lit(layer))
        found = size if found is None else found.unionByName(size)
    if found is None:
        found = spark.createDataFrame([], "raster_id string, width int, height int, layer string")
    # Every raster with every layer: the list of layers, of fixed length, is exploded beside each raster.
    layers = F.explode(F.array(*[F.lit(k) for k, _ in LAYERS])).alias("layer")
    wanted = found.select("raster_id").distinct().select("raster_id", layers)
    places = []
    if run_dir is not None:
        ready = F.col("width").isNotNull()
        shown = [k for k, _ in LAYERS if _filesystem(spark, f"{preview_path(run_dir, k)}/_SUCCESS")[0].exists(
            spark._jvm.org.apache.hadoop.fs.Path(f"{preview_path(run_dir, k)}/_SUCCESS"))]
        root = F.lit(run_dir.rstrip("/"))
        places = [F.when(ready, F.concat(root, F.lit("/"), F.col("stage"))).alias("path"),
                  F.when(ready & F.col("layer").isin(shown), F.concat(root, F.lit("/previews/"), F.col("layer"))).alias("preview_path")]
    return wanted.join(F.broadcast(expected), "layer").join(found, ["raster_id", "layer"], "left").select(
        "raster_id", "position", "layer", "stage", F.when(F.col("width").isNotNull(), "ready").otherwise("pending").alias("status"), "width", "height", *places
    ).orderBy("raster_id", "position")
