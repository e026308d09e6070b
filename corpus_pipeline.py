"""A training corpus from ``documents``: five stages, each one operator, each written as Parquet and read again.

1. ``quality``: a co-trained classifier drops documents that it finds poor or toxic.
2. ``near_duplicates``: of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest ``doc_id`` stays.
   Different texts under one ``doc_id`` are one document; rows without a ``doc_id`` stay; of equal rows one stays.
3. ``repeats``: strings of 256 bytes, and of 51 words however short, that occur more than once are cut out; ``n_chars`` follows;
   documents of which nothing is left go.
4. ``benchmark``: documents in which a test item occurs, up to one edit in twenty characters, go.
5. ``pieces``: texts become SentencePiece ids; decoding must give the text back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milpa.llm import decontam, neardup, pieces, quality, substrings
from milpa.llm._shared import shared_folder, table
from milpa.llm.queries import tokenizer

REPEAT_BYTES, REPEAT_WORDS, EDIT_RATE = 256, 51, 0.05
#: Rows come to Python in Arrow batches of so many bytes at most. Spark's own limit, 10,000 rows, is some 40 MB of usual texts: in each worker, and once
#: more outside the heap of its executor.
BATCH_BYTES = "4m"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with ``BATCH_BYTES`` set in its session, where it stays, as what a stage returns is computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are in the component of one with a smaller ``doc_id``. Different texts under one ``doc_id`` are one document and stay or go
    together; rows without a ``doc_id`` stay; of rows equal in both the one least in the other columns stays."""
    gone = neardup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    rest = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").unionByName(docs.where("doc_id is null"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return rest.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("r")).select("doc_id", "text", "r.*").select(docs.columns)


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs, REPEAT_BYTES, REPEAT_WORDS).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@in_small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"), EDIT_RATE)


@in_small_batches
def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pieces.Unigram.load(tokenizer("piece_bpe_32k.model"))
    return pieces.coded(docs, model).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [("quality", drop_poor), ("near_duplicates", drop_near_copies), ("repeats", cut_repeats), ("benchmark", drop_leaks), ("pieces", to_pieces)]
#: The classifier and the edit matching have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns lies as Parquet in the session's shared folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
