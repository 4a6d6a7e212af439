"""Sharding by extendible hashing, with DataFrame functions only.

A shard is a prefix of hash bits.  Starting from one shard, every shard above the byte
limit splits on its next bit, so the directory is deep only where the data are dense.
All levels are decided from one table of byte counts per cell of ``depth`` bits; cells
that are still too large get more bits in a further round, over their rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.scratch import cut

#: Bits of the hash that prefixes can use: 15 hexadecimal digits fit a positive long.
HASH_BITS = 60


def hash_bits(column) -> Column:
    """First 60 bits of the MD5 of a value's text; a missing value hashes like an empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(hashed, depth) -> Column:
    return F.shiftright(hashed, 0) if depth == 0 else F.expr(f"shiftright({hashed}, {HASH_BITS} - {depth})")


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell of ``high`` bits: its shard, the shallowest prefix within the limit."""
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("shard", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    best = levels.select("cell", "depth", "shard").join(fits, ["depth", "shard"]).groupBy("cell").agg(
        F.min(F.struct("depth", "shard", "shard_bytes")).alias("leaf"))
    return best.select("cell", "leaf.depth", "leaf.shard", "leaf.shard_bytes")


def extendible_shards(rows: DataFrame, key: str, size: Column, limit: int, step: int = 12) -> DataFrame:
    """Assign every row to a shard of at most ``limit`` bytes.

    ``rows`` needs ``key``; ``size`` is the bytes of a row (null counts 0).  Returns the key
    as ``key`` and ``bytes``, ``shard`` (its bits as a text of 0 and 1; empty for the whole
    table), ``depth``, ``shard_bytes`` and ``page``.  Rows with equal keys, and null keys,
    share all hash bits: where they exceed the limit together, the shard at full depth
    overflows into pages 1, 2, ... in order of size; a single row above the limit has a
    page of its own.  Everywhere else ``page`` is 0.  An empty table gives no rows.
    """
    rows = cut(rows.select(F.col(key).alias("key"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("bytes"))
               .withColumn("hashed", hash_bits("key")))
    done, left, low = None, rows, 0
    while True:
        high = min(low + step, HASH_BITS)
        cells = left.groupBy(_prefix("hashed", high).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        leaves, found = cut(cells.join(_leaves(cells, low, high, limit), "cell", "left").select(
            "cell", "depth", "shard", F.col("shard_bytes")), open=F.count_if(F.col("depth").isNull()))
        placed = left.join(leaves, _prefix("hashed", high) == leaves.cell)
        fitted = placed.where("depth IS NOT NULL").select(
            "key", "bytes", "hashed", F.expr("lpad(conv(shard, 10, 2), depth, '0')").alias("shard"), "depth", "shard_bytes",
            F.lit(0).alias("page"))
        done = fitted if done is None else done.unionByName(fitted)
        if not found["open"]:
            break
        left = cut(placed.where("depth IS NULL").select("key", "bytes", "hashed"))
        if high == HASH_BITS:
            done = done.unionByName(_pages(left, limit))
            break
        low = high + 1
    return done.select("key", "bytes", F.when(F.col("depth") > 0, F.col("shard")).otherwise("").alias("shard"),
                       "depth", "shard_bytes", "page")


def _pages(left: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows that agree in every bit.

    Rows are first dealt to sub-lists by a hash of size and position class, so that no task
    orders a whole overflowing key; pages fill within a sub-list.
    """
    dealt = left.withColumn("list", F.spark_partition_id())
    fill = W.partitionBy("hashed", "list").orderBy("bytes").rowsBetween(W.unboundedPreceding, 0)
    filled = dealt.withColumn("upto", F.sum("bytes").over(fill))
    # A page holds the rows whose running sum ends in one half-limit step, and so at most the
    # limit; a row above half the limit is alone on its page.
    filled = filled.withColumn("big", F.col("bytes") * 2 > limit)
    alone = F.when(F.col("big"), F.row_number().over(W.partitionBy("hashed", "list").orderBy("bytes")))
    paged = filled.withColumn("page", F.xxhash64("list", alone, F.floor(F.col("upto") * 2 / limit)))
    return paged.select(
        "key", "bytes", "hashed", F.expr(f"lpad(conv(hashed, 10, 2), {HASH_BITS}, '0')").alias("shard"),
        F.lit(HASH_BITS).alias("depth"), F.sum("bytes").over(W.partitionBy("hashed", "page")).alias("shard_bytes"), "page")
