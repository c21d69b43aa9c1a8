"""A training-data pipeline of five stages over `documents`: each takes what the one before kept, written as Parquet.

1. toxicity: documents that the class-conditional models reject go.
2. line dedup: later repeated runs of lines go from the texts; n_chars follows.
3. n-gram Jaccard join: the first document of each near-duplicate class stays.
4. benchmark decontamination: contaminated documents go.
5. SentencePiece: every document's ids, and whether they decode to its text.

Line dedup stands before the join, so near copies have often lost their shared lines when the join compares them: of planted
near copies the join alone finds most, after line dedup few (README). Later exact copies of texts of two lines and more lose all
their lines and stay as empty texts.

Cases, for every stage: a null text is kept as null (no evidence, no lines, no shingles, no words, null ids), an empty text as
empty; rows that repeat are judged alike, and the join keeps one of them; ties go to the least doc_id, then a hash of the text; empty tables give no rows; all but the last stage keep extra columns, whatever their names.
n_chars follows the text where line dedup changes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsight.llm.common import delete, noted_cuts, scratch_dir, table
from barsight.llm.decontamination import decontaminate
from barsight.llm.jaccard_join import keep_one
from barsight.llm.line_dedup import line_dedup
from barsight.llm.sentencepiece import encode_decode
from barsight.llm.toxicity import drop_toxic


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def giving_back(stage: Stage) -> Stage:
    """The stage, which first deletes what the stage before wrote on its way: by now its result is written and read again."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        delete(spark, _left.pop(app, []))
        with noted_cuts() as paths:
            out = stage(spark, docs, sf_dir)
        _left[app] = paths
        return out

    return run


@giving_back
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@giving_back
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs)
    _, removed, _ = out.columns[len(docs.columns) :]
    return out.select(*[F.when(F.col(removed) > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@giving_back
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@giving_back
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@giving_back
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = encode_decode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", pieces)]
#: The first and the last stage cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result goes once the next one's is written; the last one's when the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        delete(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
