"""The iterative fill against a plain replay of its rounds, with tiles and halos far smaller than the grid."""

import numpy as np
import pytest
from conftest import grid_of

from hydrospark.operators import iterative_fill
from hydrospark.operators.regions import SLOPE_STEP
from hydrospark.schema import D8_STEPS


def replay(h, v, most):
    """Synchronous rounds, cell by cell: heights and the number of rounds that changed something."""
    h = h.astype(np.float32)
    rows, cols = h.shape
    around = lambda r, c: [(r + dr, c + dc) for dr, dc in D8_STEPS if 0 <= r + dr < rows and 0 <= c + dc < cols]
    for turn in range(most):
        lifted = h.copy()
        changed = 0
        for r in range(1, rows - 1):
            for c in range(1, cols - 1):
                near = [h[n] for n in around(r, c) if v[n]]
                if v[r, c] and near and all(h[r, c] < x for x in near):
                    total = np.float32(0)
                    for x in near:
                        total += x
                    level = any(abs(float(x) - float(h[r, c])) <= 1e-8 + 1e-5 * abs(float(h[r, c])) for x in near)
                    lifted[r, c] = min(near) if level else np.float32(float(total) / len(near))
                    changed += 1
        out, seen = lifted.copy(), set()
        for start in ((r, c) for r in range(rows) for c in range(cols) if v[r, c]):
            if start in seen:
                continue
            flat, stack = set(), [start]
            while stack:
                at = stack.pop()
                if at in flat:
                    continue
                flat.add(at)
                stack += [n for n in around(*at) if v[n] and abs(float(lifted[n]) - float(lifted[at])) <= 1e-6]
            seen |= flat
            rim = [(at, n) for at in flat for n in around(*at) if v[n] and n not in flat]
            if len(flat) < 2 or not rim or any(float(lifted[n]) < float(lifted[at]) - 1e-6 for at, n in rim):
                continue
            spill, anchor = min((lifted[n], at) for at, n in rim)
            dist, queue = {anchor: 0}, [anchor]
            for at in queue:
                for n in around(*at):
                    if n in flat and n not in dist:
                        dist[n] = dist[at] + 1
                        queue.append(n)
            for at in flat:
                out[at] = np.float32(float(spill) + SLOPE_STEP * (dist[at] + 1))
            changed += len(flat)
        if not changed:
            return h, turn
        h = out
    return h, most


def rasters():
    rng = np.random.default_rng(7)
    bowls = np.kron(rng.integers(0, 6, (9, 8)), np.ones((3, 3), int))
    r, c = np.indices((21, 26))
    yield "blocks", bowls, rng.random(bowls.shape) > 0.03
    yield "noise", rng.integers(0, 30, (23, 19)), np.ones((23, 19), bool)
    yield "lake", np.where((abs(r - 10) < 8) & (abs(c - 12) < 10), 20, 25 + (r * 7 + c * 3) % 5), np.ones(r.shape, bool)
    yield "funnel", np.maximum(abs(r - 10), abs(c - 13)), np.ones(r.shape, bool)
    yield "fine", np.round(rng.random((20, 20)) * 3, 1), rng.random((20, 20)) > 0.1


@pytest.mark.parametrize("side, halo", [(8, 5), (64, 8)])
@pytest.mark.parametrize("name, h, v", list(rasters()), ids=lambda x: x if isinstance(x, str) else "")
def test_rounds_equal_the_replay(spark, cells, tiles, side, halo, name, h, v):
    tiles(side)
    spark.conf.set("spark.hydrospark.fillHalo", str(halo))
    try:
        for most in (3, 40) if side == 64 else (5,):
            filled, per = iterative_fill.iterative_fill(cells(height=h, valid=v), most)
            want, turns = replay(np.asarray(h), v, most)
            got = grid_of(filled, "height")
            assert all(got[k] == want[k] for k in got), name
            assert [(r["rounds"], r["finished"]) for r in per.collect()] == [(turns, turns < most)]
    finally:
        spark.conf.unset("spark.hydrospark.fillHalo")


def test_an_unsettled_block_knows_it():
    """A lake wider than the block is unknown, terrain with lower ground in sight is not."""
    h = np.full((12, 30), 30.0)
    h[1:-1, 15:] = 5
    h[:, :10] = np.arange(12)[:, None] + 40 + np.arange(10)
    known = np.zeros((14, 32), bool)
    known[1:-1, 1:-1] = True
    pad = lambda x, fill: np.pad(x, 1, constant_values=fill)
    inner = np.ones((14, 32), bool)
    _, seen, _ = iterative_fill.fill_rounds(pad(h, 0), pad(h > 0, False), known, inner, 2, 10_000)
    assert not seen[6, 22] and seen[6, 4]
