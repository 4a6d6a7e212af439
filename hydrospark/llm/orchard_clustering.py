"""Centroid clustering of integer vectors; nearest centroids are found by Orchard's search.

Each centroid keeps the others sorted by their distance from it.  A vector walks down the list
of its best centroid so far; when it meets a closer one it goes over to that one's list, from
the start, passing by what it has visited.  The walk ends at the first entry strictly farther from the
best centroid than twice the vector's distance to it: by the triangle inequality nothing behind
it is nearer, nor as near.  All vectors of a batch walk at once, as arrays.

Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; each becomes
``floor(scale * x)``.  Values of 2^27 or more after scaling would not leave distances in a BIGINT
and count as non-finite.  Equal distances go to the lower centroid; a null id is hashed as empty text;
rows under one id are vectors of their own; fewer vectors than centroids give fewer
centroids, an empty table no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import arrow_map, batch
from hydrospark.scratch import cut

MOST = 1 << 27


def integer_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``key, v``: the kept vectors as integers."""
    x = F.col(vector)
    fits = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) * scale < MOST), F.lit(False))
    kept = df.where(x.isNotNull()).where((F.size(x) == dims) & F.forall(x, fits))
    return kept.select(F.col(key).alias("key"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid: all centroids by rising squared distance (ties: lower number), and those distances."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance per vector, and how many distances were computed."""
    n, k = len(vectors), len(centroids)
    order, apart = neighbour_lists(centroids)
    away = lambda rows, to: ((vectors[rows] - centroids[to]) ** 2).sum(axis=1)
    middle = int(((centroids - centroids.mean(axis=0)) ** 2).sum(axis=1).argmin())
    best = np.full(n, middle)
    distance = away(np.arange(n), best)
    visited = np.zeros((n, k), bool)
    visited[:, middle] = True
    place, walking, computed = np.zeros(n, np.int64), np.arange(n), n
    while walking.size:
        at, home = place[walking], best[walking]
        walking = walking[(at < k) & (apart[home, np.minimum(at, k - 1)] <= 4 * distance[walking])]
        met = order[best[walking], place[walking]]
        place[walking] += 1
        fresh = ~visited[walking, met]
        rows, met = walking[fresh], met[fresh]
        visited[rows, met] = True
        found = away(rows, met)
        computed += len(rows)
        closer = (found < distance[rows]) | ((found == distance[rows]) & (met < best[rows]))
        rows = rows[closer]
        best[rows], distance[rows], place[rows] = met[closer], found[closer], 0
    return best, distance, computed


def _sums(batches, centroids):
    """Component sums and the count of each centroid's vectors in one partition."""
    k, dims = centroids.shape
    total = np.zeros((k, dims + 1), np.int64)
    for rows in batches:
        vectors = _matrix(rows.column(0))
        if not len(vectors):
            continue
        best, _, _ = nearest(vectors, centroids)
        by = np.argsort(best, kind="stable")
        seen, first = np.unique(best[by], return_index=True)
        total[seen, :dims] += np.add.reduceat(vectors[by], first, axis=0)
        total[:, dims] += np.bincount(best, minlength=k)
    held = np.flatnonzero(total[:, dims])
    yield pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int32()), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])


def _assign(batches, centroids):
    kind = None
    for rows in batches:
        kind = kind or pa.schema([("key", rows.schema.field(0).type), ("cluster", pa.int32()), ("distance", pa.int64())])
        vectors = _matrix(rows.column(1))
        best, distance, _ = nearest(vectors, centroids) if len(vectors) else (np.zeros(0), np.zeros(0), 0)
        yield batch(kind, rows.column(0), best.astype(np.int32), distance.astype(np.int64))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest (equal hashes: the smaller vector), in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = vectors.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()  # k rows
    return np.array([row["v"] for row in rows], np.int64)


def moved_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of each centroid's vectors; a centroid without vectors stays."""
    parts = arrow_map(vectors.select("v"), partial(_sums, centroids=centroids), "cluster int, sums array<long>")
    sums = parts.select("cluster", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("s").alias("s"))
    total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for row in sums.collect():  # centroids x (components + 1) rows
        total[row["cluster"], row["d"]] = row["s"]
    held = total[:, -1] > 0
    out = centroids.copy()
    out[held] = total[held, :-1] // total[held, -1:]
    return out


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
    dims: int = 64, scale: int = 256, seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's rounds over all kept vectors; returns ``key, cluster, distance`` per vector and the final centroids.

    Every round reads the integer vectors once and shuffles one row of sums per centroid and partition.
    """
    vectors = cut(integer_vectors(df, key, vector, dims, scale))
    centroids = first_centroids(vectors, k, seed)
    schema = f"key {df.schema[key].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key), centroids
    for _ in range(rounds):
        centroids = moved_centroids(vectors, centroids)
    return cut(arrow_map(vectors, partial(_assign, centroids=centroids), schema)).withColumnRenamed("key", key), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (null where a sum leaves a BIGINT) and ``centroid_sha256``."""
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = assigned.groupBy("cluster").agg(whole.alias("total")).collect()  # at most one row per centroid
    fits = lambda total: total if total < 1 << 63 else None
    totals = {row["cluster"]: int(row["total"]) for row in sums}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(c, fits(t), fits(sum(totals.values())), digest(c)) for c, t in totals.items()]
    figures = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster")
