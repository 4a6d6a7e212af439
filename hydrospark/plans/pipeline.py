"""The five stages as one job, with or without stage tables on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.config import STAGES, PipelineConfig
from hydrospark.operators.channels import channel_mask
from hydrospark.operators.conditioning import preprocess
from hydrospark.operators.flowgraph import flow_accumulation
from hydrospark.operators import render
from hydrospark.operators.grid import densify, overview
from hydrospark.operators.routing import flow_direction
from hydrospark.schema import KEYS
from hydrospark.scratch import cut, scratch_scope
from hydrospark.sources import stages as store


def extract_channels(g: DataFrame, cfg: PipelineConfig | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Heights in, channel mask (with the layers it came from) out."""
    cfg = cfg or PipelineConfig()
    terrain = cut(preprocess(densify(g), cfg.preprocess, mask))
    directed = flow_direction(terrain, cfg.flow_direction)
    return channel_mask(cut(flow_accumulation(directed)), cfg.channel_extract)


def _layer_pixels(stage: str, table: DataFrame, cfg: PipelineConfig) -> dict[str, DataFrame]:
    """The layers of a stage table as pixel tables (``gray``, ``r,g,b`` or ``r,g,b,a``)."""
    if stage == "io":
        colors = [c for c in ("r", "g", "b") if c in table.columns]
        plain = table.select(*KEYS, *[F.col(c).cast("int").alias(c) for c in colors] or [F.col("height").cast("int").alias("gray")])
        if "mask" not in table.columns:
            return {"input_preview": plain}
        mask = table.select(*KEYS, F.coalesce("mask", F.lit(False)).alias("mask"))
        return {"input_preview": render.render_input(table.drop("mask"), mask), "user_mask": render.render_mask(mask, "mask")}
    if stage == "preprocess":
        shown = {"terrain_preprocessed": render.render_terrain(table), "fill_depth": render.render_fill_depth(table)}
        return shown | ({"auto_mask": render.render_mask(table, "auto_mask")} if "auto_mask" in table.columns else {})
    if stage == "flow_direction":
        return {"flow_direction": render.render_direction(table)}
    if stage == "flow_accumulation":
        return {"flow_accumulation": render.render_accumulation(table, cfg.flow_accumulation.normalize)}
    return {"channel_mask": render.render_channel(table)}


def write_previews(stage: str, table: DataFrame, run_dir: str, cfg: PipelineConfig) -> None:
    """Bounded views of a stage's layers below ``run_dir``: pixels averaged until the longest side fits ``preview_max_side``."""
    for layer, pixels in _layer_pixels(stage, table, cfg).items():
        bands = [c for c in pixels.columns if c not in KEYS]
        small = overview(pixels, cfg.preview_max_side, means=tuple(bands))
        store.write_preview(small.select(*KEYS, *[F.round(F.col(c).cast("double")).cast("int").alias(c) for c in bands]), run_dir, layer)


@dataclass(frozen=True)
class RunResult:
    completed: list[str]
    ran: list[str]
    message: str


def run_pipeline(
    g: DataFrame, run_dir: str, cfg: PipelineConfig | None = None, mask: DataFrame | None = None,
    start_stage: str | None = None, end_stage: str | None = None, inherit: bool = True,
    inherit_stage_outputs: list[str] | None = None, output_path: str | None = None, previews: bool = True,
) -> RunResult:
    """Run the stages up to ``end_stage``, reusing the finished prefix of an earlier run.

    A stage is reused when its manifest tells the same input and the same settings, of it and of all
    stages before.  Tables at and after the first stage that runs are dropped first.  With ``previews``
    every stage that runs also writes a bounded view of its layers.
    """
    cfg = cfg or PipelineConfig()
    spark = g.sparkSession
    end = end_stage or STAGES[-1]
    last = STAGES.index(end)
    inputs = [store.content_fingerprint(g)] + ([] if mask is None else [store.content_fingerprint(mask)])
    prints = store.stage_fingerprints("|".join(inputs), cfg)
    prefix = store.reusable_prefix(store.completed_stages(spark, run_dir, prints), inherit_stage_outputs, inherit)
    if prefix and STAGES.index(prefix[-1]) >= last:
        return RunResult(prefix, [], f"stage {end} is already available in this run")
    first = len(prefix) if prefix else STAGES.index(start_stage or STAGES[0])
    for stage in STAGES[first:]:
        store.drop_stage(spark, run_dir, stage)

    def table(stage: str) -> DataFrame:
        return store.read_stage(spark, run_dir, stage)

    def build(stage: str) -> DataFrame:
        if stage == "io":
            cells = densify(g)
            return cells if mask is None else cells.join(mask.select(*KEYS, "mask").hint("merge"), KEYS, "left")
        if stage == "preprocess":
            cells = table("io")
            held = cells.select(*KEYS, "mask").where("mask IS NOT NULL") if "mask" in cells.columns else None
            return preprocess(cells.drop("mask"), cfg.preprocess, held)
        terrain = table("preprocess")
        if stage == "flow_direction":
            return flow_direction(terrain, cfg.flow_direction).select(*KEYS, "valid", F.col("direction").cast("tinyint").alias("direction"))
        directed = table("flow_direction").withColumn("direction", F.col("direction").cast("int"))
        if stage == "flow_accumulation":
            return flow_accumulation(directed)
        return channel_mask(table("flow_accumulation"), cfg.channel_extract).select(*KEYS, "valid", "channel")

    ran = []
    for stage in STAGES[first:last + 1]:
        with scratch_scope(spark):
            written = store.write_stage(build(stage), run_dir, stage, prints[stage])
            if previews:
                write_previews(stage, written, run_dir, cfg)
        ran.append(stage)
        if stage == STAGES[-1] and output_path:
            written.write.mode("overwrite").partitionBy("raster_id").parquet(output_path)
    return RunResult(store.completed_stages(spark, run_dir, prints), ran, f"ran {', '.join(ran)}")
