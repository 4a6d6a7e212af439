"""Tiled solvers against plain single-machine answers, with tiles far smaller than the grid."""

import heapq

import numpy as np
import pytest
from conftest import grid_of
from pyspark.sql import functions as F

from hydrospark.functions.quantiles import exact_quantile
from hydrospark.operators import components, exits, flooding, flowgraph, focal, geodesic, regions, routing
from hydrospark.schema import D8_STEPS
from hydrospark.scratch import cut

H, W = 33, 27


def around(r, c):
    for i, (dr, dc) in enumerate(D8_STEPS):
        if 0 <= r + dr < H and 0 <= c + dc < W:
            yield i, (r + dr, c + dc)


def flood_plainly(h, v):
    level = np.where(v, np.inf, h)
    heap = []
    for r in range(H):
        for c in range(W):
            if v[r, c] and sum(v[n] for _, n in around(r, c)) < 8:
                level[r, c] = h[r, c]
                heap.append((h[r, c], r, c))
    heapq.heapify(heap)
    while heap:
        top, r, c = heapq.heappop(heap)
        for _, n in around(r, c):
            rise = max(top, h[n])
            if v[n] and rise < level[n]:
                level[n] = rise
                heapq.heappush(heap, (rise, *n))
    return level


@pytest.mark.parametrize("side, fan", [(8, 8), (4, 2)])
def test_components(cells, tiles, side, fan):
    tiles(side, fan)
    mask = np.random.default_rng(1).random((H, W)) > 0.5
    want, todo = {}, [(r, c) for r in range(H) for c in range(W) if mask[r, c]]
    for start in todo:
        stack = [start] if start not in want else []
        while stack:
            at = stack.pop()
            if at in want:
                continue
            want[at] = (start[0] << 32) + start[1]
            stack += [n for _, n in around(*at) if mask[n]]
    got = grid_of(components.connected_components(cells(mask=mask), "mask").where("label IS NOT NULL"), "label")
    assert got == want


@pytest.mark.parametrize("side, fan", [(8, 8), (4, 2)])
def test_flood(cells, tiles, side, fan):
    tiles(side, fan)
    rng = np.random.default_rng(2)
    h = rng.integers(0, 40, (H, W)).astype(float)
    v = rng.random((H, W)) > 0.02
    want = flood_plainly(h, v)
    got = grid_of(flooding.fill_depressions(cells(height=h, valid=v)), "height")
    assert all(got[k] == want[k] for k in got)


def test_distances_cross_tiles(spark, tiles):
    tiles(4)
    wall = np.zeros((12, 12), dtype=bool)
    wall[3, :10] = wall[7, 2:] = True
    members = [("a", r, c, 5, 0 if (r, c) == (0, 0) else None, 0 if (r, c) == (0, 0) else None)
               for r in range(12) for c in range(12) if not wall[r, c]]
    table = spark.createDataFrame(members, "raster_id string, row int, col int, region long, cost long, source long")
    want, queue = {(0, 0): 0}, [(0, 0)]
    for at in queue:
        for dr, dc in D8_STEPS:
            n = (at[0] + dr, at[1] + dc)
            if 0 <= n[0] < 12 and 0 <= n[1] < 12 and not wall[n] and n not in want:
                want[n] = want[at] + 1
                queue.append(n)
    assert grid_of(geodesic.region_distances(table), "dist") == want


def test_routing_leaves_no_gap_and_no_cycle(cells, tiles):
    tiles(16)
    rng = np.random.default_rng(3)
    v = rng.random((H, W)) > 0.05
    routed = routing.flow_direction(cells(height=rng.integers(0, 12, (H, W)), valid=v))
    d = grid_of(routed, "direction")
    assert all(d[r, c] >= 0 for r in range(H) for c in range(W) if v[r, c])
    acc = flowgraph.flow_accumulation(routed)  # raises on a cycle
    ends = flowgraph.flow_terminal(routed)
    assert ends.where("kind = 'cycle'").count() == 0
    assert acc.agg(F.max("accumulation")).first()[0] <= H * W


def test_accumulation_and_traces(cells, tiles):
    tiles(8)
    rng = np.random.default_rng(4)
    d = rng.choice([1, 2, 3, 4, -1], p=[0.2, 0.3, 0.2, 0.25, 0.05], size=(H, W))
    acc, ends = {}, {}
    for r in range(H):
        for c in range(W):
            at, hops = (r, c), 0
            while True:
                acc[at] = acc.get(at, 0) + 1
                nxt = dict(around(*at)).get(d[at])
                if nxt is None:
                    break
                at, hops = nxt, hops + 1
            ends[r, c] = ((at[0] << 32) + at[1], hops)
    table = cells(direction=d)
    assert grid_of(flowgraph.flow_accumulation(table), "accumulation") == acc
    traced = flowgraph.flow_terminal(table)
    assert {k: (t, n) for (k, t), n in zip(grid_of(traced, "terminal").items(), grid_of(traced, "hops").values())} == ends


def test_cycles_across_tiles(cells, tiles):
    tiles(4)
    d = np.full((H, W), -1)
    d[5, 5:20], d[5:15, 20], d[15, 6:21], d[6:16, 5] = 2, 4, 6, 0
    d[8, 8], d[8, 9] = 2, 6
    got = grid_of(flowgraph.flow_cycles(cells(direction=d)), "cycle")
    ring = {(r, c) for r in range(5, 16) for c in range(5, 21) if r in (5, 15) or c in (5, 20)}
    assert got == {**{k: (5 << 32) + 5 for k in ring}, (8, 8): (8 << 32) + 8, (8, 9): (8 << 32) + 8}


def test_quantile_by_buckets(spark):
    values = np.round(np.random.default_rng(5).random(3000) ** 3 * 100, 3)
    table = spark.createDataFrame([("a", float(x)) for x in values], "raster_id string, x double")
    got = exact_quantile(table, "x", 0.95, "q", accuracy=20).first()["q"]
    assert abs(got - np.percentile(values, 95)) < 1e-9


def test_roots_of_choices(spark):
    # 1 <-> 2 with a descending tail, a loop of four, and a chain that leaves.
    to = {1: 2, 2: 1, 3: 1, 9: 8, 8: 7, 7: 6, 6: 5, 5: 4, 4: 3, 20: 23, 23: 21, 21: 22, 22: 20, 40: 39, 39: 38, 38: 37, 37: 36, 36: -1}
    picks = spark.createDataFrame([("a", k, v) for k, v in to.items()], "raster_id string, g long, ng long")
    roots = {r["id"]: r["root"] for r in exits._roots(picks, len(to)).collect()}
    assert roots == {k: 2 if k < 10 else 23 if k < 30 else -1 for k in to}


def plain_exits(h, v, d):
    """Components without a direction, their catchments, and the way each would choose, by plain search."""
    closed = {(r, c) for r in range(H) for c in range(W) if v[r, c] and d[r, c] < 0}
    comp = pieces(closed, lambda a, b: True)

    def trace(at):
        hops = 0
        while True:
            if at in comp:
                return comp[at], hops
            nxt = dict(around(*at)).get(d[at])
            if nxt is None or not v[nxt]:
                return None, hops
            at, hops = nxt, hops + 1

    ends = {(r, c): trace((r, c)) for r in range(H) for c in range(W) if v[r, c]}
    ways = {}
    for at, (catch, hops) in ends.items():
        if catch is None:
            continue
        near = dict(around(*at))
        for i in range(8):
            n = near.get(i)
            if n is None or not v[n]:
                way = (1 if hops == 0 else 3, 0, 0.0, 0.0, *at, i)
                nxt = None
            elif ends[n][0] != catch:
                way = (0 if hops == 0 else 2, hops, h[n] - h[at], h[n], *at, i)
                nxt = ends[n][0]
            else:
                continue
            ways[catch, nxt] = min(way, ways.get((catch, nxt), (9,)))
    return ends, ways


@pytest.mark.parametrize("side, seed", [(8, 3), (16, 4), (4, 5)])
def test_ways_out_and_the_forest_of_exits(cells, tiles, side, seed):
    tiles(side)
    rng = np.random.default_rng(seed)
    h, v = rng.integers(0, 12, (H, W)).astype(float), rng.random((H, W)) > 0.05
    if seed == 5:  # one bowl in a bowl in a bowl: the inner ones have no neighbour that drains elsewhere
        r, c = np.indices((H, W))
        h = np.maximum(abs(r - 16), abs(c - 13)).astype(float)
        h[(h % 4) == 2] -= 3
        v[:] = True
    table = cut(routing.unresolved_components(focal.d8_strict(cells(height=h, valid=v))))
    d = grid_of(table, "direction")
    ends, ways = plain_exits(h, v, d)
    code = lambda at: -1 if at is None else (at[0] << 32) + at[1]
    found = exits.exit_ways(cut(exits.catchments(table)))
    assert {(r["c"], r["nxt"]): tuple(r[k] for k in exits.WAY) for r in found.collect()} == {(code(c), code(n)): w for (c, n), w in ways.items()}
    best = {}
    for (c, n), way in ways.items():
        best[c] = min(best.get(c, (9,)), (*way, code(n)))
    first = {r["catch"]: (r["row"], r["col"], r["dir"], -1 if r["nxt"] is None else r["nxt"]) for r in exits.first_choices(found).collect()}
    assert first == {code(c): (w[4], w[5], w[6], w[7]) for c, w in best.items()}
    forest = {r["catch"]: r for r in exits.exit_forest(found).collect()}
    assert set(forest) == {code(c) for c, _ in ways}
    for c, r in forest.items():
        assert (c, -1 if r["nxt"] is None else r["nxt"]) in {(code(c), code(n)) for c, n in ways}
        seen = set()
        while c is not None:  # every chain of exits ends outside
            assert c not in seen
            seen.add(c)
            c = forest[c]["nxt"]
    joined = {(r["c"], r["nxt"]) for r in exits._joined_forest(found).collect()}
    assert joined == {(c, -1 if r["nxt"] is None else r["nxt"]) for c, r in forest.items()}
    assert any(r["nxt"] == first[c][3] for c, r in forest.items() if r["nxt"] is not None) or all(r["nxt"] is None for r in forest.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_leaves_no_cycle(cells, tiles, seed):
    tiles(8)
    rng = np.random.default_rng(seed)
    v = rng.random((H, W)) > 0.03
    table = cut(cells(height=rng.integers(0, 9, (H, W)), valid=v, direction=np.where(v, rng.integers(0, 8, (H, W)), -1)))
    loops = flowgraph.flow_cycles(table)
    assert loops.count() > 10
    repaired = cut(routing.repair_cycles(table))
    assert flowgraph.flow_cycles(repaired).count() == 0
    # Water that met no cycle keeps its way.
    kept = {k for k, kind in grid_of(flowgraph.flow_terminal(table), "kind").items() if kind == "exit"}
    before, after = grid_of(table, "direction"), grid_of(repaired, "direction")
    assert kept and all(before[k] == after[k] for k in kept)


def pieces(inside, same):
    """First cell of every 8-connected piece of ``inside`` along ``same``."""
    first = {}
    for start in sorted(inside):
        stack = [] if start in first else [start]
        while stack:
            at = stack.pop()
            if at not in first:
                first[at] = start
                stack += [n for _, n in around(*at) if n in inside and same(at, n)]
    return first


def test_segments_are_assigned_by_distance_and_strength(cells, tiles):
    tiles(8)
    rng = np.random.default_rng(6)
    h = np.kron(rng.integers(0, 4, (H // 3, W // 3)), np.ones((3, 3), dtype=int))
    everything = {(r, c) for r in range(H) for c in range(W)}
    region = pieces(everything, lambda a, b: h[a] == h[b])
    drop = {a: max([h[a] - h[n] for _, n in around(*a)] + [0]) for a in everything}
    seg = pieces({a for a in everything if drop[a] > 0}, lambda a, b: region[a] == region[b])
    strength = {}
    for s in set(seg.values()):
        held = [drop[a] for a in seg if seg[a] == s]
        strength[s] = np.mean(held) + 0.35 * np.log1p(len(held))
    heap = [(round(-1.5 * strength[s], 6), s, 0, a) for a, s in seg.items()]
    heapq.heapify(heap)
    want = {}
    while heap:
        cost, s, dist, a = heapq.heappop(heap)
        if a not in want:
            want[a] = (s, dist)
            for _, n in around(*a):
                if region[n] == region[a]:
                    heapq.heappush(heap, (round(cost + 1, 6), s, dist + 1, n))
    labelled = components.flat_regions(cells(height=h))
    placed = regions.assign_segments(focal.outlet_drop(labelled)).where("seg_of IS NOT NULL")
    got = {(r["row"], r["col"]): ((r["seg_of"] >> 32, r["seg_of"] & 0xFFFFFFFF), r["dist"]) for r in placed.collect()}
    assert got == want


def test_quantiles_of_skewed_and_tied_values_are_exact(spark):
    rng = np.random.default_rng(8)
    sets = {
        "tied": np.repeat([0.0, 0.0, 0.0, 7.5], 500), "skewed": np.exp(rng.normal(0, 40, 3000)),
        "few": np.array([3.0, -1.0]), "one": np.array([2.5]), "mixed": np.append(np.zeros(1900), rng.normal(size=200)),
    }
    rows = [(k, float(v)) for k, values in sets.items() for v in values] + [("nulls", None), ("few", None)]
    table = spark.createDataFrame(rows, "raster_id string, x double").repartition(7)
    for q, accuracy in ((0.0, 20), (0.05, 20), (0.5, 10_000), (0.95, 20), (1.0, 20)):
        got = {r.raster_id: r.q for r in exact_quantile(table, "x", q, "q", accuracy=accuracy).collect()}
        assert got.keys() == sets.keys()
        for k, values in sets.items():
            assert got[k] == pytest.approx(np.quantile(values, q), rel=1e-12), (k, q, accuracy)


def test_a_bracket_that_misses_runs_again(spark, monkeypatch):
    from hydrospark.functions import quantiles

    real, calls = quantiles._picked, []

    def late(values, bracket):
        calls.append(1)
        shift = F.when(F.col("raster_id") == "a", 1000.0).otherwise(0.0) if len(calls) == 1 else F.lit(0.0)
        return real(values, bracket.withColumn("lo", F.col("lo") + shift).withColumn("hi", F.col("hi") + shift))

    monkeypatch.setattr(quantiles, "_picked", late)
    table = spark.createDataFrame([(k, float(i)) for k in "ab" for i in range(101)], "raster_id string, x double")
    got = {r.raster_id: r.q for r in exact_quantile(table, "x", 0.5, "q").collect()}
    assert got == {"a": 50.0, "b": 50.0} and len(calls) == 2
