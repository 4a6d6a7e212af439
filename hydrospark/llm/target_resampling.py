"""Importance resampling towards a target: draw the documents whose hashed n-grams look like the target's.

Every text is brought to lower-case words joined by one space and scanned once for its running
CRCs; the CRC of any run of words then comes from two of them.  Counts per CRC bucket
over all documents and over the target give each bucket a gain, a document's weight is its mean
gain, and Gumbel noise from a hash of its id makes the highest scores a draw without replacement.

Nulls, empty and wordless texts have no features and weight 0.  A null id is hashed as empty text
and comes last among ties; rows under one id are scored each for itself.  Empty tables give no rows
(an empty target counts as no features).  Other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrospark.llm.common import arrow_map, batch, blocks, text_bytes
from hydrospark.llm.crc_prefix import running, substring_crc
from hydrospark.scratch import cut

BUCKETS = 10_000
#: Score values that share one step of the ranking's first level.
SCORES_A_STEP = 256

SPACE = 0x20
#: Lower-cased byte for letters A-Z, itself for other word bytes, a space for the rest.
WORD_BYTE = np.full(256, SPACE, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTE[_low:_high] = np.arange(_low, _high)
WORD_BYTE[0x41:0x5B] += 32


def word_runs(data: np.ndarray, offsets: np.ndarray):
    """Normalised bytes of a block of texts, word begins and ends in them, and each text's first word."""
    text = WORD_BYTE[data[offsets[0]:offsets[-1]]]
    bounds = offsets - offsets[0]
    inside = text != SPACE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    opens = bounds[:-1][np.diff(bounds) > 0]
    begins[opens] = inside[opens]
    # One separator is kept after each word, so a run of words is one stretch of bytes.
    after = np.zeros(len(text), bool)
    after[1:] = ~inside[1:] & inside[:-1]
    after[opens] = False
    keep = inside | after
    place = np.cumsum(keep) - keep
    starts = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:]
    ends = place[np.flatnonzero(closes)] + 1
    return text[keep], place[starts], ends, np.searchsorted(starts, bounds)


def features(data: np.ndarray, offsets: np.ndarray, shortest: int, longest: int, buckets: int):
    """Buckets of all runs of ``shortest`` to ``longest`` words, the text of each, and words per text."""
    norm, begins, ends, first = word_runs(data, offsets)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    registers = running(norm)
    found, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(shortest, longest + 1):
        at = np.arange(max(0, len(begins) - n + 1))
        at = at[text[at] == text[at + n - 1]]
        found.append(substring_crc(registers, begins[at], ends[at + n - 1]).astype(np.int64) % buckets)
        owner.append(text[at])
    return np.concatenate(found), np.concatenate(owner), counts


def _count(batches, shortest, longest, buckets):
    total = np.zeros(buckets, np.int64)
    for rows in batches:
        data, offsets = text_bytes(rows.column(0))
        for low, high in blocks(offsets):
            found, _, _ = features(data, offsets[low:high + 1], shortest, longest, buckets)
            total += np.bincount(found, minlength=buckets)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str, shortest: int, longest: int, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: one sum per bucket and partition is shuffled."""
    step = partial(_count, shortest=shortest, longest=longest, buckets=buckets)
    sums = arrow_map(texts.select(text), step, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most ``buckets`` rows
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares in the target and the corpus, floored."""
    buckets = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


OUT = "key {kind}, n_words long, n_features long, weight long"


def _weigh(batches, gains, shortest, longest):
    kind = None
    for rows in batches:
        kind = kind or pa.schema([
            ("key", rows.schema.field(0).type), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
        data, offsets = text_bytes(rows.column(1))
        n = rows.num_rows
        words, made, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for low, high in blocks(offsets):
            found, owner, counts = features(data, offsets[low:high + 1], shortest, longest, len(gains))
            words[low:high] = counts
            made[low:high] = np.bincount(owner, minlength=high - low)
            np.add.at(total[low:high], owner, gains[found])
        yield batch(kind, rows.column(0), words, made, total // np.maximum(made, 1))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, drawn: int, order: str) -> DataFrame:
    """Adds ``rank`` to the ``drawn`` rows of highest ``score`` among those ``fit``; ties by ``order``, then the other figures.

    Counts per score value place every score; only rows of one score value are ordered
    against each other, and only those that can be drawn.  ``rows`` is read three times.
    """
    step = F.floor(F.col("score") / SCORES_A_STEP).alias("step")
    counts = rows.where("fit").groupBy("score", step).agg(F.count("*").alias("n"))
    higher = W.rowsBetween(W.unboundedPreceding, -1)
    steps = counts.groupBy("step").agg(F.sum("n").alias("n")).select(
        "step", F.coalesce(F.sum("n").over(higher.orderBy(F.desc("step"))), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("n").over(higher.partitionBy("step").orderBy(F.desc("score"))), F.lit(0))
    places = cut(counts.select("score", "step", inside.alias("inside")).join(steps, "step").select(
        "score", (F.col("above") + F.col("inside")).alias("above")).where(F.col("above") < drawn))
    placed = rows.join(places, "score", "left").withColumn("open", F.col("fit") & F.col("above").isNotNull())
    tie = W.partitionBy("score").orderBy(F.asc_nulls_last(order), "n_features", "weight", "n_words")
    first = placed.where("open").withColumn("rank", F.col("above") + F.row_number().over(tie))
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = placed.where("NOT open").withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).drop("above", "open", "fit")


def importance_resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """One row per document: ``key, n_words, n_features, weight, score, rank`` (rank null unless drawn).

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    corpus = bucket_counts(docs, text, shortest, longest, buckets)
    aim = bucket_counts(target, target_text, shortest, longest, buckets)
    schema = OUT.format(kind=docs.schema[key].dataType.simpleString())
    weighed = arrow_map(
        docs.select(key, text), partial(_weigh, gains=bucket_gains(corpus, aim), shortest=shortest, longest=longest), schema)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)).withColumn("fit", F.col("n_words") >= least_words)
    scored, seen = cut(scored, n=F.count_if("fit"))
    return ranked(scored, percent * seen["n"] // 100, "key").select(
        F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The drawn rows of ``docs``, unchanged.  ``key`` must name one row each."""
    drawn = importance_resample(docs, target, key, **settings).where("rank IS NOT NULL").select(F.col(key).alias("_drawn"))
    return docs.join(drawn, docs[key].eqNullSafe(F.col("_drawn")), "left_semi")
