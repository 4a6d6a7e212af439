"""Small hand-made grids with known answers."""

import numpy as np
import pytest
from conftest import grid_of
from pyspark.sql import functions as F

from hydrospark.config import ChannelExtractConfig, FlowDirectionConfig, PreprocessConfig
from hydrospark.operators import channels, components, conditioning, flooding, flowgraph, focal, grid, regions, routing

STRIP = [[12] * 7, [10] * 6 + [5], [12] * 7]
CLOSED = [[12] * 5, [12, 5, 5, 5, 12], [12, 5, 5, 5, 12], [12] * 5]


def test_gradient_matches_naive_scan(cells, tiles):
    h = np.array([[9, 8, 7, 6], [8, 8, 7, 5], [7, 6, 6, 4], [6, 5, 4, 3]], dtype=float)
    v = np.ones((4, 4), dtype=bool)
    v[0, 3] = v[2, 1] = False
    tiles(2)
    steep = np.zeros((4, 4))
    for r in range(4):
        for c in range(4):
            for y in range(max(0, r - 1), min(4, r + 2)):
                for x in range(max(0, c - 1), min(4, c + 2)):
                    if v[r, c] and v[y, x]:
                        steep[r, c] = max(steep[r, c], abs(h[r, c] - h[y, x]))
    expected = 1 - np.clip(steep / np.percentile(steep[v], 95), 0, 1)
    got = grid_of(focal.gradient_score(cells(height=h, valid=v)), "gradient_score")
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in got)


def test_steepest_neighbour_wins(cells, tiles):
    assert grid_of(focal.d8_strict(cells(height=[[30, 30, 30], [30, 10, 1], [30, 30, 3]])), "direction")[1, 1] == 2


def test_flat_strip_drains_east(cells, tiles):
    got = grid_of(routing.flow_direction(cells(height=STRIP)), "direction")
    assert [got[1, c] for c in range(6)] == [2] * 6


def test_zero_weights_still_route(cells, tiles):
    cfg = FlowDirectionConfig(flat_escape_weight=0, outlet_proximity_weight=0, continuity_weight=0)
    got = grid_of(routing.flow_direction(cells(height=STRIP), cfg), "direction")
    assert min(got.values()) >= 0 and got[1, 5] == 2


@pytest.mark.parametrize("continuity, expected", [(0, 1), (1, 2)])
def test_continuity_turns_the_choice(cells, tiles, continuity, expected):
    h = [[12] * 5, [12, 10, 10, 10, 7], [12, 10, 10, 10, 12], [12] * 5]
    cfg = FlowDirectionConfig(flat_escape_weight=1, outlet_proximity_weight=0, continuity_weight=continuity)
    assert grid_of(routing.resolve_flats(focal.d8_strict(cells(height=h)), cfg), "direction")[2, 1] == expected


def test_closed_flat_is_lifted_with_slope(cells, tiles):
    filled, rounds, finished = conditioning.fill_sinks_iterative(cells(height=CLOSED))
    assert finished
    got = grid_of(filled, "height")
    assert rounds >= 1 and got[1, 1] > 5 and got[2, 2] > got[1, 1]
    assert all(got[r, c] >= 12.001 - 1e-6 for r in (1, 2) for c in (1, 2, 3))


def test_preprocess_tells_whether_the_fill_finished(cells, tiles):
    stairs = [[9] * 9, [9, *range(1, 8), 9], [9] * 9]
    for rounds, finished in ((1, False), (32, True)):
        cfg = PreprocessConfig(fill_sink_algorithm="legacy", smooth=False, preserve_nodata=False, max_fill_rounds=rounds)
        seen = {(r["fill_rounds"], r["fill_finished"]) for r in conditioning.preprocess(cells(height=stairs), cfg).collect()}
        assert len(seen) == 1 and (finished,) == next(iter(seen))[1:]


def test_single_sink_rises_to_mean(cells, tiles):
    filled, rounds, _ = conditioning.fill_sinks_iterative(cells(height=[[5, 6, 7], [8, 1, 9], [10, 11, 12]]), max_iterations=1)
    assert rounds == 1 and grid_of(filled, "height")[1, 1] == 8.5


def test_flood_fills_to_the_rim(cells, tiles):
    h = [[9] * 5, [9, 5, 5, 5, 9], [9, 5, 1, 5, 9], [9, 5, 5, 5, 9], [9] * 5]
    tiles(2, 2)
    filled = flooding.fill_depressions(cells(height=h))
    assert grid_of(filled, "height")[2, 2] == 9
    depth = grid_of(filled, "fill_depth")
    assert depth[2, 2] == 8 and depth[0, 0] == 0


def test_short_pieces_go(cells, tiles):
    acc = [[0, 8, 8, 0], [0, 8, 0, 0], [0, 0, 0, 9], [0, 0, 0, 0]]
    got = grid_of(channels.channel_mask(cells(accumulation=acc), ChannelExtractConfig(7, 2)), "channel")
    assert {k for k, v in got.items() if v} == {(0, 1), (0, 2), (1, 1)}


def _edge_case(where):
    acc, direction = np.zeros((5, 5), dtype=int), np.full((5, 5), -1)
    for cell, d in where.items():
        acc[cell], direction[cell] = 10, d
    return acc, direction


def test_channel_stops_at_image_edge(cells, tiles):
    acc, d = _edge_case({(2, 1): 0, (1, 1): 0, (0, 1): 2, (0, 2): 2, (0, 3): -1})
    got = grid_of(channels.channel_mask(cells(accumulation=acc, direction=d), ChannelExtractConfig(5)), "channel")
    assert got[2, 1] == got[1, 1] == got[0, 1] == 1 and got[0, 2] == got[0, 3] == 0


def test_channel_stops_at_mask_edge(cells, tiles):
    acc, d = _edge_case({(2, 2): 6, (2, 1): 4, (3, 1): 4, (4, 1): -1})
    v = np.ones((5, 5), dtype=bool)
    v[:, 0] = False
    got = grid_of(channels.channel_mask(cells(accumulation=acc, direction=d, valid=v), ChannelExtractConfig(5)), "channel")
    assert got[2, 2] == got[2, 1] == 1 and got[3, 1] == got[4, 1] == 0


def test_two_cell_pocket_drains(cells, tiles):
    routed = routing.flow_direction(cells(height=[[5, 4, 5], [4, 1, 2], [5, 4, 5]]))
    d = grid_of(routed, "direction")
    assert min(d.values()) >= 0 and (d[1, 1], d[1, 2]) != (2, 6)
    assert grid_of(flowgraph.flow_accumulation(routed), "accumulation")[1, 1] > 1


def test_cycles_are_an_error(cells, tiles):
    with pytest.raises(ValueError, match="2 cells"):
        flowgraph.flow_accumulation(cells(direction=[[-1, -1, -1], [-1, 2, 6], [-1, -1, -1]]))


def test_component_sizes_and_filter(cells, tiles):
    mask = np.array([[1, 1, 0, 0], [0, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 0]], dtype=bool)
    g = cells(mask=mask)
    sizes = components.component_sizes(components.connected_components(g, "mask")).orderBy("label")
    assert [r["size"] for r in sizes.collect()] == [3, 2, 1]
    kept = grid_of(components.filter_components(g, "mask", True, 3), "mask")
    assert {k for k, v in kept.items() if v} == {(0, 0), (0, 1), (1, 1)}


def test_scaled_area(spark):
    assert spark.range(1).select(grid.scale_area(64, 2).alias("x")).first()["x"] == 16


def test_mask_of_other_shape_is_an_error(cells, tiles):
    with pytest.raises(ValueError, match="mask shape"):
        grid.apply_mask(cells(height=np.ones((3, 3))), cells(mask=np.ones((2, 3), dtype=bool)))


def test_config_bounds():
    with pytest.raises(ValueError):
        PreprocessConfig(smooth_kernel_size=16)
    assert conditioning.fill_policy(PreprocessConfig(deep_basin_mode="preserve")) == ("priority_flood", 0.0)
    assert conditioning.fill_policy(PreprocessConfig()) == ("priority_flood", None)
    assert conditioning.fill_policy(PreprocessConfig(fill_sink_algorithm="legacy"))[0] == "legacy"


def test_closed_flat_repair_keeps_open_flats(cells, tiles):
    got = regions.repair_closed_flats(cells(height=STRIP))
    assert got.where("repaired").count() == 0
    assert got.agg(F.sum("height")).first()[0] == sum(map(sum, STRIP))


def test_masked_input_is_empty_outside_the_mask(cells, tiles):
    from hydrospark.operators import render

    shown = render.render_input(cells(height=[[9, 7]]), cells(mask=[[True, False]]))
    assert [tuple(r[c] for c in "rgba") for r in shown.orderBy("col").collect()] == [(9, 9, 9, 255), (0, 0, 0, 0)]


def test_rasters_of_different_sizes_get_the_answers_they_get_alone(cells, tiles):
    tiles(4, 2)
    rng = np.random.default_rng(8)
    small, large = rng.integers(0, 9, (5, 6)), rng.integers(0, 9, (19, 23))
    cfg = PreprocessConfig()
    parts = [cells("s", height=small), cells("l", height=large)]
    parts = [p.withColumn("valid", F.lit(True)) for p in parts]
    alone = {(r["raster_id"], r["row"], r["col"]): r["height"] for p in parts for r in conditioning.preprocess(p, cfg).collect()}
    mixed = {(r["raster_id"], r["row"], r["col"]): r["height"] for r in conditioning.preprocess(parts[0].unionByName(parts[1]), cfg).collect()}
    assert mixed == alone


def test_deep_basin_drains_after_the_iterative_fill(cells, tiles):
    ring = np.minimum.reduce([*np.indices((7, 7)), *(6 - np.indices((7, 7)))])
    filled, _, _ = conditioning.fill_sinks_iterative(cells(height=np.array([50, 40, 30, 0])[ring]))
    routed = routing.flow_direction(filled)
    assert min(grid_of(routed, "direction").values()) >= 0
    flowgraph.assert_acyclic(routed)


def test_accumulation_counts_every_upstream_cell(cells, tiles):
    d = np.array([[2, 2, 4], [1, 2, 4], [0, 0, -1]])
    steps = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    want = {}
    for start in np.ndindex(3, 3):
        at = start
        while True:
            want[at] = want.get(at, 0) + 1
            if d[at] < 0:
                break
            at = (at[0] + steps[d[at]][0], at[1] + steps[d[at]][1])
    for side in (2, 64):
        tiles(side)
        assert grid_of(flowgraph.flow_accumulation(cells(direction=d)), "accumulation") == want


def test_auto_mask_judged_on_coarse_blocks(spark, cells, tiles):
    h = np.full((8, 8), 100.0)
    h[2:6, 2:6] = 30
    assert spark.range(1).select(grid.scale_area(64, 2)).first()[0] == 16
    masked = conditioning.auto_mask(cells(height=h), PreprocessConfig(auto_mask_min_region_size=64), scale=2)
    got = grid_of(masked, "auto_mask")
    assert len(got) == 64 and set(map(type, got.values())) == {bool}
