"""NumPy helpers that run inside one bounded group (a tile or a super-tile)."""

from __future__ import annotations

import numpy as np

from hydrospark.schema import D8_LENGTHS, D8_STEPS

HALF_STEPS = D8_STEPS[2:6]  # E, SE, S, SW: every neighbour pair once


def paint(rows, cols, values, r0, c0, shape, fill, dtype):
    """Lay cell values out as a 2-D array."""
    out = np.full(shape, fill, dtype=dtype)
    out[np.asarray(rows) - r0, np.asarray(cols) - c0] = values
    return out


def grid_pairs(shape):
    """Flat indices of all neighbouring cell pairs, each pair once."""
    height, width = shape
    index = np.arange(height * width).reshape(shape)
    pairs = []
    for dr, dc in HALF_STEPS:
        from_ = index[max(0, -dr):height - max(0, dr), max(0, -dc):width - max(0, dc)]
        to = index[max(0, dr):height - max(0, -dr), max(0, dc):width - max(0, -dc)]
        pairs.append((from_.ravel(), to.ravel()))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def layer(table, name, fill):
    """A column of an Arrow table as an array, NULL as ``fill``."""
    return table[name].combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)


def neighbor_positions(rows, cols):
    """Positions of the eight neighbours of every cell, in the order of ``D8_STEPS``; -1 where there is none.

    Neighbours are next in order along a column or a row, so the cells must be dense.
    """
    def beside(across, along):
        order = np.lexsort((along, across))
        same = across[order[1:]] == across[order[:-1]]
        before, after = np.full(len(rows) + 1, -1), np.full(len(rows) + 1, -1)  # the last stands for position -1
        before[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = order[1:][same]
        return before, after

    up, down = beside(cols, rows)
    west, east = beside(rows, cols)
    return np.stack([x[:-1] for x in (up, up[east], east, down[east], down, down[west], west, up[west])])


def steepest(height, valid, near):
    """Strict D8: code of the steepest fall to a valid neighbour, the first on ties, -1 if there is none."""
    drop = (height - height[near]).astype(np.float32)
    lengths = np.array(D8_LENGTHS, dtype=np.float32).astype(np.float64)[:, None]
    with np.errstate(invalid="ignore"):
        falls = valid & valid[near] & (near >= 0) & (drop > 0)
        steep = np.where(falls, (drop / lengths).astype(np.float32), -np.inf)
    return np.where(falls.any(axis=0), steep.argmax(axis=0), -1)


def smallest_member(n, a, b):
    """Smallest node of each node's connected component, edges (a, b)."""
    parent = np.arange(n)
    while True:
        pa, pb = parent[a], parent[b]
        split = pa != pb
        if not split.any():
            return parent
        a, b, pa, pb = a[split], b[split], pa[split], pb[split]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def follow(nxt, hops):
    """End node, number of steps and cycle flag per node of a functional graph.

    ``nxt[v] == v`` marks an end node.
    """
    nxt, hops = nxt.copy(), np.where(nxt == np.arange(len(nxt)), 0, hops)
    ends = nxt == np.arange(len(nxt))
    for _ in range(max(1, len(nxt)).bit_length() + 1):
        hops = hops + hops[nxt]
        nxt = nxt[nxt]
    return nxt, hops, ~ends[nxt]


def upstream_totals(nxt, weight):
    """Sum of ``weight`` over each node and everything that flows into it.

    ``nxt[v] == v`` marks an end node.  Nodes on a cycle get no meaningful sum.
    """
    n = len(nxt)
    total = np.append(weight.astype(np.float64), 0.0)
    jump = np.append(np.where(nxt == np.arange(n), n, nxt), n)
    for _ in range(n.bit_length() + 1):
        if (jump[:n] == n).all():
            break
        total[:n] += np.bincount(jump[:n], weights=total[:n], minlength=n + 1)[:n]
        jump = jump[jump]
    return np.rint(total[:n]).astype(np.int64)


def flood(n, a, b, weight, level, label, seeds):
    """Lowest pass from every node to a seed: (level, label of that seed).

    No edge may weigh less than the level of a seed it touches.  Rounds: every group
    without a seed hooks onto the group behind its lowest pass (ties: the earlier edge) and
    its nodes rise to it, so the open groups at least halve.  Nodes that reach no seed keep
    their label, at level infinity.
    """
    order = np.argsort(weight, kind="stable")
    a, b, weight = a[order], b[order], weight[order]
    closed = np.zeros(n, dtype=bool)
    closed[seeds] = True
    group = np.arange(n)
    passes = np.full(n, -np.inf)
    while True:
        ga, gb = group[a], group[b]
        open_ = (ga != gb) & ~(closed[ga] & closed[gb])
        if not open_.any():
            break
        a, b, weight, ga, gb = a[open_], b[open_], weight[open_], ga[open_], gb[open_]
        # Edges are in rising order; written backwards, the lowest of each group stays.
        lowest = np.full(n, -1)
        edge = np.arange(len(a))[::-1]
        lowest[ga[::-1]] = edge
        at_b = np.full(n, -1)
        at_b[gb[::-1]] = edge
        lowest = np.where((lowest < 0) | ((at_b >= 0) & (at_b < lowest)), at_b, lowest)
        picked = np.flatnonzero((lowest >= 0) & ~closed)
        by = lowest[picked]
        other = np.where(ga[by] == picked, gb[by], ga[by])
        hook = np.arange(n)
        hook[picked] = other
        rise = np.full(n, -np.inf)
        rise[picked] = weight[by]
        passes = np.maximum(passes, rise[group])
        # Two groups that pick the same edge point at each other; the lower one stays.
        mutual = picked[(hook[other] == picked) & (picked < other)]
        hook[mutual] = mutual
        while True:
            up = hook[hook]
            if np.array_equal(up, hook):
                break
            hook = up
        group = hook[group]
    settled = closed[group]
    top = np.where(settled, passes, np.inf)
    top[seeds] = level[seeds]
    return top, np.where(settled, label[group], label).astype(np.int64)


def spread(region, cost, source, dist, unit):
    """Cheapest arrival per cell, moving one step (``unit``) inside its region.

    ``cost`` is an integer; ties go to the lower ``source``.  Works on flat
    arrays of a padded grid whose rim has region -1; updates in place.
    """
    height, width = region.shape
    region, cost, source, dist = (x.reshape(-1) for x in (region, cost, source, dist))
    shifts = [dr * width + dc for dr, dc in D8_STEPS]
    front = np.flatnonzero((source >= 0) & (region >= 0))
    while front.size:
        moved = []
        for shift in shifts:
            to = front + shift
            same = region[to] == region[front]
            at, to = front[same], to[same]
            new = cost[at] + unit
            better = (new < cost[to]) | ((new == cost[to]) & (source[at] < source[to]))
            at, to, new = at[better], to[better], new[better]
            cost[to], source[to], dist[to] = new, source[at], dist[at] + 1
            moved.append(to)
        front = np.unique(np.concatenate(moved))
