"""What keeps large rasters within their limits, on small grids: joins by shuffle, equal results of the faster steps."""

import numpy as np
from pyspark.sql import functions as F

from hydrospark import scratch
from hydrospark.operators import components, exits, flooding, flowgraph, focal, geodesic, grid
from hydrospark.schema import D8_LENGTHS
from hydrospark.scratch import cut


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_raster_tables_join_by_shuffle(spark):
    rows = spark.range(scratch.BROADCAST_ROWS + 1).select(
        F.lit("a").alias("raster_id"), (F.col("id") / 1000).cast("int").alias("row"), (F.col("id") % 1000).cast("int").alias("col"))
    large, small = cut(rows), cut(rows.limit(100))
    keys = ["raster_id", "row", "col"]
    assert "BroadcastHashJoin" not in _plan(large.join(large.select(*keys, F.lit(1).alias("x")).where("row >= 0"), keys, "left"))
    assert "BroadcastHashJoin" in _plan(small.join(small.select(*keys, F.lit(1).alias("x")), keys, "left"))


def test_traces_of_large_rasters_are_not_broadcast(spark, cells, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 100)
    heights = np.add.outer(np.arange(20), np.arange(20))
    traced = flowgraph.flow_terminal(focal.d8_strict(cells(height=heights)))
    assert "BroadcastHashJoin" not in _plan(traced)
    assert {r["terminal"] for r in traced.collect()} == {0}


def test_neighbour_kernels_agree_with_windows(spark, cells, tiles):
    tiles(4)
    rng = np.random.default_rng(3)
    g = cut(cells(height=rng.integers(0, 4, (13, 11)), valid=rng.random((13, 11)) > 0.1))
    labelled = cut(components.flat_regions(g))
    near = grid.with_neighbors(labelled, ["height", "valid", "label"])
    ok = lambda n: F.coalesce(n["valid"], F.lit(False))
    drop = lambda n: F.col("height") - n["height"]
    slopes = F.array(*grid.each_neighbor(lambda n, i: F.when(F.col("valid") & ok(n) & (drop(n) > 0), (drop(n) / F.lit(D8_LENGTHS[i])).cast("float"))))
    falls = F.greatest(*grid.each_neighbor(lambda n, i: F.when(ok(n) & ~n["label"].eqNullSafe(F.col("label")) & (drop(n) > 0), drop(n))))
    open_side = F.greatest(*grid.each_neighbor(lambda n, i: ~ok(n)))
    plain = near.select(
        "row", "col", F.coalesce(F.array_position(slopes, F.array_max(slopes)) - 1, F.lit(-1)).alias("direction"),
        F.coalesce(F.when(F.col("label").isNotNull(), falls), F.lit(0.0)).alias("drop"), (F.col("valid") & open_side).alias("edge_contact"))
    made = focal.d8_strict(grid.edge_contact(focal.outlet_drop(labelled))).select(plain.columns)
    assert "Window" not in _plan(made)  # one pass over each tile's array
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))


def test_ways_leave_a_tile_once_for_each_pair(spark, cells, tiles):
    tiles(16)
    g = cells(height=[[1, 1, 2, 2], [1, 1, 2, 2], [1, 1, 2, 2]], direction=-np.ones((3, 4), dtype=int))
    parted = g.withColumn("catch", F.when(F.col("col") < 2, F.lit(0)).otherwise(F.lit(2)).cast("long")).withColumn("hops", F.lit(0).cast("long"))
    ways = {(w["c"], w["nxt"]): (w["cls"], w["rise"], w["row"], w["col"], w["dir"]) for w in exits.exit_ways(parted).collect()}
    assert ways == {(0, 2): (0, 1.0, 0, 1, 2), (2, 0): (0, -1.0, 0, 2, 5), (0, -1): (1, 0.0, 0, 0, 0), (2, -1): (1, 0.0, 0, 2, 0)}


def test_rim_labels_merge_in_squares_before_joins(spark, cells, tiles, monkeypatch):
    tiles(4, 2)

    def never(_):
        raise AssertionError("joins over a raster that fits one square")
    monkeypatch.setattr(components, "graph_roots", never)
    monkeypatch.setattr(flooding, "merge_by_lowest_pass", never)
    bowl = np.full((20, 20), 5.0)
    bowl[1:19, 1:19] = 1.0
    g = cells(height=bowl)
    assert {r["label"] for r in components.flat_regions(g).where("height = 1").collect()} == {(1 << 32) + 1}
    assert {r["height"] for r in flooding.fill_depressions(g).collect()} == {5.0}


def test_rims_of_large_rasters_are_not_broadcast(spark):
    rim = cut(spark.range(50_000).select(
        F.lit("a").alias("raster_id"), (F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"),
        F.lit(0).alias("trow"), F.lit(0).alias("tcol"), F.lit(0).alias("_val"), F.col("id").alias("_label")))
    assert "BroadcastHashJoin" not in _plan(components._meeting_labels(rim, 0.0))


def test_rounds_of_distances_shuffle_active_tiles_alone(spark, cells, tiles, monkeypatch):
    tiles(4)
    plans, pairs = [], geodesic.map_pairs
    monkeypatch.setattr(geodesic, "map_pairs", lambda left, *rest: (plans.append(_plan(left)), pairs(left, *rest))[1])
    start = F.when((F.col("row") == 0) & (F.col("col") == 0), F.lit(0).cast("long"))
    members = cells(height=np.zeros((3, 20))).select("raster_id", "row", "col", F.lit(1).cast("long").alias("region"), start.alias("cost"), start.alias("source"))
    far = geodesic.region_distances(members).collect()
    assert {(r["row"], r["col"]): r["dist"] for r in far} == {(r, c): max(r, c) for r in range(3) for c in range(20)}
    rounds = plans[1:-1]
    assert len(rounds) > 3
    assert all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in rounds)
