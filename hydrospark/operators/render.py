"""Statistics and pixel tables of the raster layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.config import LAYERS
from hydrospark.schema import KEYS
from hydrospark.tiling import attach

# Colour per direction code 0..7, and of cells without a direction.
DIRECTION_COLORS = [
    (54, 116, 181), (102, 170, 255), (70, 172, 124), (145, 206, 108),
    (214, 165, 61), (220, 116, 69), (188, 81, 83), (130, 98, 173),
]
NO_DIRECTION_COLOR = (18, 24, 32)
CHANNEL_COLOR = (121, 210, 255, 255)
LAYER_ORDER = [layer for layer, _ in LAYERS]
# Opacity and blend mode of the layers.
LAYER_OPACITY = {"input_preview": 1.0, "channel_mask": 1.0, "user_mask": 0.9, "auto_mask": 0.88, "fill_depth": 0.62}
OTHER_OPACITY = 0.72
LAYER_BLEND = {"user_mask": "lighten", "auto_mask": "lighten", "fill_depth": "lighten"}


def terrain_stats(g: DataFrame) -> DataFrame:
    """Shape, minimum, maximum and mean of the valid cells (of all cells if none is valid)."""
    ok, h = F.col("valid"), F.col("height").cast("double")
    over = lambda f: F.coalesce(f(F.when(ok, h)), f(h))
    return g.groupBy("raster_id").agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"),
        over(F.min).alias("min_height"), over(F.max).alias("max_height"), over(F.avg).alias("mean_height"),
    )


def _to_byte(value: Column, low: Column, high: Column) -> Column:
    share = (value - low) / (high - low) * 255.0
    return F.when(high - low <= 0, 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), share)).cast("int"))


def render_terrain(g: DataFrame) -> DataFrame:
    ok, h = F.col("valid"), F.col("height").cast("double")
    span = g.groupBy("raster_id").agg(
        F.coalesce(F.min(F.when(ok, h)), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(F.when(ok, h)), F.lit(255.0)).alias("_hi"))
    return attach(g, span).select(*KEYS, F.when(ok, _to_byte(h, F.col("_lo"), F.col("_hi"))).otherwise(0).alias("gray"))


def render_fill_depth(g: DataFrame) -> DataFrame:
    deep = F.col("valid") & (F.col("fill_depth") > 0)
    depth = F.col("fill_depth").cast("double")
    top = g.groupBy("raster_id").agg(F.max(F.when(deep, depth)).alias("_hi"))
    share = F.least(F.lit(1.0), depth / F.col("_hi")) * 255.0
    return attach(g, top).select(*KEYS, F.when(deep, share.cast("int")).otherwise(0).alias("gray"))


def render_direction(g: DataFrame) -> DataFrame:
    palette = [(i, *rgb) for i, rgb in enumerate(DIRECTION_COLORS)]
    colors = g.sparkSession.createDataFrame(palette, "direction int, r int, g int, b int")
    joined = g.select(*KEYS, F.col("direction").cast("int").alias("direction")).join(F.broadcast(colors), "direction", "left")
    return joined.select(*KEYS, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip("rgb", NO_DIRECTION_COLOR)])


def render_accumulation(g: DataFrame, normalize: bool = True) -> DataFrame:
    """Gray levels over the range of all cells, valid or not."""
    value = F.col("accumulation").cast("double")
    value = F.log1p(value) if normalize else value
    span = g.groupBy("raster_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return attach(g, span).select(*KEYS, _to_byte(value, F.col("_lo"), F.col("_hi")).alias("gray"))


def render_mask(g: DataFrame, mask: str = "valid") -> DataFrame:
    return g.select(*KEYS, F.when(F.col(mask), 255).otherwise(0).alias("gray"))


def render_channel(g: DataFrame) -> DataFrame:
    wet = F.col("channel") == 1
    return g.select(*KEYS, *[F.when(wet, v).otherwise(0).alias(c) for c, v in zip("rgba", CHANNEL_COLOR)])


def render_input(g: DataFrame, mask: DataFrame) -> DataFrame:
    """Input colours (``r,g,b``, or gray ``height``); all four channels are 0 outside the mask."""
    rgb = ["r", "g", "b"] if "r" in g.columns else ["height"] * 3
    joined = g.join(mask.select(*KEYS, F.col("mask").alias("_m")).hint("merge"), KEYS, "left")
    inside = lambda value: F.when(F.col("_m"), value).otherwise(0)
    return joined.select(*KEYS, *[inside(F.col(source).cast("int")).alias(c) for c, source in zip("rgb", rgb)], inside(F.lit(255)).alias("a"))


def composite(layers: dict[str, DataFrame], opacity: dict | None = None, blend: dict | None = None) -> DataFrame:
    """Stack pixel tables (``gray``, ``r,g,b`` or ``r,g,b,a``) bottom to top, one pixel per cell."""
    opacity, blend = {**LAYER_OPACITY, **(opacity or {})}, {**LAYER_BLEND, **(blend or {})}
    rank = {name: i for i, name in enumerate(LAYER_ORDER)}
    stacked = None
    for place, (name, layer) in enumerate(layers.items()):
        rgb = ["gray"] * 3 if "gray" in layer.columns else ["r", "g", "b"]
        alpha = F.col("a") if "a" in layer.columns else F.lit(255)
        pixel = F.struct(
            F.lit(rank.get(name, len(rank) + place)).alias("z"),
            *[F.col(s).cast("double").alias(c) for s, c in zip(rgb, "rgb")],
            (alpha / F.lit(255.0) * F.lit(float(opacity.get(name, OTHER_OPACITY)))).cast("double").alias("a"),
            F.lit(blend.get(name, "normal")).alias("mode"),
        )
        rows = layer.select(*KEYS, pixel.alias("px"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    start = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])

    def over(acc, px):
        seen = acc["a"] * (1.0 - px["a"])
        alpha = px["a"] + seen

        def channel(c):
            mixed = F.when(px["mode"] == "lighten", F.greatest(acc[c], px[c])).when(
                px["mode"] == "darken", F.least(acc[c], px[c])).otherwise(px[c])
            painted = (1.0 - acc["a"]) * px[c] + acc["a"] * mixed
            return ((px["a"] * painted + seen * acc[c]) / alpha).alias(c)

        return F.when(px["a"] <= 0, acc).otherwise(F.struct(*[channel(c) for c in "rgb"], alpha.alias("a")))

    pile = stacked.groupBy(*KEYS).agg(F.array_sort(F.collect_list("px")).alias("pile"))
    blended = pile.select(*KEYS, F.aggregate("pile", start, over).alias("p"))
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + 0.5).cast("int")
    return blended.select(*KEYS, *[byte(F.col(f"p.{c}")).alias(c) for c in "rgb"], byte(F.col("p.a") * 255.0).alias("a"))


def direction_counts(g: DataFrame) -> DataFrame:
    return g.groupBy("raster_id", F.col("direction").cast("int").alias("direction")).agg(F.count("*").alias("n"))


