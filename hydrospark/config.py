"""Stage configuration with bounds checked at construction."""

from __future__ import annotations

from dataclasses import dataclass, field

# Layers in display order (bottom to top) with the stage that writes them.
LAYERS = [
    ("input_preview", "io"), ("user_mask", "io"), ("auto_mask", "preprocess"), ("terrain_preprocessed", "preprocess"),
    ("fill_depth", "preprocess"), ("flow_direction", "flow_direction"),
    ("flow_accumulation", "flow_accumulation"), ("channel_mask", "channel_extract"),
]
STAGES = ["io", "preprocess", "flow_direction", "flow_accumulation", "channel_extract"]


def _within(owner, **bounds):
    for name, (low, high) in bounds.items():
        value = getattr(owner, name)
        if value is None:
            continue
        if (low is not None and value < low) or (high is not None and value > high):
            raise ValueError(f"{name}={value} is outside [{low}, {high}]")


def _one_of(owner, **choices):
    for name, allowed in choices.items():
        if getattr(owner, name) not in allowed:
            raise ValueError(f"{name} must be one of {allowed}")


@dataclass(frozen=True)
class PreprocessConfig:
    height_mapping: str = "bright_is_high"
    smooth: bool = True
    smooth_kernel_size: int = 3
    fill_sinks: bool = True
    fill_sink_algorithm: str = "auto"
    max_fill_depth: float | None = None
    max_fill_rounds: int = 32
    deep_basin_mode: str = "mark"
    preserve_nodata: bool = True
    nodata_value: float | None = None
    use_auto_mask: bool = False
    auto_mask_border_sensitivity: float = 1.0
    auto_mask_texture_sensitivity: float = 1.0
    auto_mask_min_region_size: int = 2048
    use_mask: bool = False

    def __post_init__(self):
        _one_of(
            self,
            height_mapping=["bright_is_high", "dark_is_high"],
            fill_sink_algorithm=["auto", "legacy", "priority_flood"],
            deep_basin_mode=["fill", "preserve", "mark"],
        )
        _within(
            self,
            smooth_kernel_size=(1, 15),
            max_fill_depth=(0.0, 255.0),
            max_fill_rounds=(1, None),
            nodata_value=(0.0, 255.0),
            auto_mask_border_sensitivity=(0.1, 5.0),
            auto_mask_texture_sensitivity=(0.1, 5.0),
            auto_mask_min_region_size=(1, 10_000_000),
        )


@dataclass(frozen=True)
class FlowDirectionConfig:
    slope_weight: float = 1.0
    flat_escape_weight: float = 0.6
    outlet_proximity_weight: float = 0.4
    continuity_weight: float = 0.3
    flat_outlet_length_weight: float = 0.35
    flat_outlet_distance_weight: float = 1.5

    def __post_init__(self):
        _within(self, **{name: (0.0, 10.0) for name in self.__dataclass_fields__})


@dataclass(frozen=True)
class FlowAccumulationConfig:
    normalize: bool = True


@dataclass(frozen=True)
class ChannelExtractConfig:
    accumulation_threshold: float = 200.0
    channel_length_threshold: int = 1

    def __post_init__(self):
        if self.accumulation_threshold <= 0:
            raise ValueError("accumulation_threshold must be positive")
        _within(self, channel_length_threshold=(1, None))


@dataclass(frozen=True)
class PipelineConfig:
    preprocess: PreprocessConfig = field(default_factory=PreprocessConfig)
    flow_direction: FlowDirectionConfig = field(default_factory=FlowDirectionConfig)
    flow_accumulation: FlowAccumulationConfig = field(default_factory=FlowAccumulationConfig)
    channel_extract: ChannelExtractConfig = field(default_factory=ChannelExtractConfig)
    preview_max_side: int = 4096

    def __post_init__(self):
        _within(self, preview_max_side=(512, 8192))
