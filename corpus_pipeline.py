"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next stage's documents. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from fixturelab.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from fixturelab.llm.common import fresh, table, written

#: A learned model decides the first stage, and the near-duplicate and decontamination stages verify
#: edit distances and sets that SQL can't express in bounded time: tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; null and empty texts are judged by the bias alone."""
    score = fresh(docs, "_score")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score_documents(docs, model, score=score).where(F.col(score) < 0.5).drop(score)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller id holds too; every document stays, if empty."""
    counted = {"n_lines": fresh(docs, "_n_lines"), "n_dropped": fresh(docs, "_n_dropped")}
    hidden = docs.withColumnsRenamed({c: counted[c.lower()] for c in docs.columns if c.lower() in counted})
    kept = line_dedup.dedup_lines(hidden).drop("n_lines", "n_dropped")
    out = kept.withColumnsRenamed({new: old for old, new in counted.items()})
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, one without an id last."""
    return ngram_join.keep_first_of_group(docs, keep_null_ids=False)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and checksums of every document that is left."""
    encoded = bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return bpe.encoding_digest(encoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
