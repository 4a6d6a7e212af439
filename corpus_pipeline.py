"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

In every stage null and empty texts are documents without words: they hold no toxic term, passage or benchmark
item, are like no other document, and stay.  Rows without an id stay in every filtering stage.  Rows that share an id
are judged by their own text, except in ``keep_one_of_similar``, where they share their fate.  Empty tables
give empty tables.  All but the last stage return the columns they were given, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm import queries
from hydrospark.llm.common import table
from hydrospark.llm.decontaminate import without_leaks
from hydrospark.llm.ngram_join import ngram_jaccard_components
from hydrospark.llm.pieces import encode_pieces
from hydrospark.llm.substring_dedup import without_repeats
from hydrospark.llm.toxicity import without_toxic
from hydrospark.scratch import scratch_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model learned on this stage's own input."""
    return without_toxic(docs, *queries.toxicity_model(spark, docs, sf_dir), queries.TOXIC_FROM)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of every class of near duplicates (five-word shingles, similarity 0.8)."""
    classes = ngram_jaccard_components(docs, shingle=5, threshold=80)
    return docs.join(classes.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 or more words that an earlier document has; ``n_chars`` follows, no row is lost."""
    return without_repeats(docs, window=13)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding gives the text back."""
    return encode_pieces(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", keep_one_of_similar), ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_leaks), ("sentencepiece", encode),
]

#: The toxicity model and the piece vocabulary can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written below the shared scratch folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
