"""From accumulation to a binary channel mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.config import ChannelExtractConfig
from hydrospark.operators.components import filter_components
from hydrospark.operators.flowgraph import flow_edges
from hydrospark.operators.grid import edge_contact
from hydrospark.schema import KEYS
from hydrospark.scratch import cut


def channel_threshold(g: DataFrame, threshold: float) -> DataFrame:
    """``channel``: 1 where accumulation reaches the threshold on a valid cell."""
    wet = (F.col("accumulation") >= F.lit(float(threshold))) & F.col("valid")
    return g.withColumn("channel", F.coalesce(wet, F.lit(False)).cast("int"))


def trim_edges(g: DataFrame) -> DataFrame:
    """Stop channels at their first edge cell (``edge_contact``).

    An edge cell stays only with an interior channel cell upstream, or with no
    channel cell upstream at all.
    """
    g = cut(g)
    wet = g.where("channel = 1").select(*KEYS, "edge_contact")
    arriving = (
        flow_edges(g).join(wet, KEYS)
        .groupBy("raster_id", F.col("dst_row").alias("row"), F.col("dst_col").alias("col"))
        .agg(F.bool_or(~F.col("edge_contact")).alias("_inner"))
    )
    drop = (F.col("channel") == 1) & F.col("edge_contact") & ~F.coalesce("_inner", F.lit(True))
    return g.join(arriving, KEYS, "left").withColumn(
        "channel", F.when(drop, 0).otherwise(F.col("channel"))).drop("_inner")


def filter_short(g: DataFrame, min_cells: int) -> DataFrame:
    """Remove 8-connected channel pieces smaller than ``min_cells``."""
    if min_cells <= 1:
        return g
    flagged = g.withColumn("_wet", F.col("channel") == 1)
    return filter_components(flagged, "_wet", True, min_cells).withColumn("channel", F.col("_wet").cast("int")).drop("_wet")


def channel_mask(g: DataFrame, cfg: ChannelExtractConfig | None = None) -> DataFrame:
    """Threshold, edge trim (when ``direction`` is present) and short-piece filter."""
    cfg = cfg or ChannelExtractConfig()
    out = channel_threshold(g, cfg.accumulation_threshold)
    if "direction" in g.columns:
        out = trim_edges(edge_contact(out)).drop("edge_contact")
    return filter_short(out, cfg.channel_length_threshold)
