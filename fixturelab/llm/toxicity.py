"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero, so
the model is a short list of (bucket, weight) pairs that is cheap to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from fixturelab.llm.common import kept, map_arrow, slices
from fixturelab.session import ship_package

#: Words that a worker remembers by their hash; the memory is emptied beyond. It changes speed only.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of the learner; ``sample`` is the most labelled documents it is fitted on."""

    sample: int = 12_000
    buckets: int = 1 << 20
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


class Words(dict):
    """64-bit hash of each word, without marks at its ends and in lower case."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(".,;:!?\"'()[]{}*%&$#|<>-_").lower()
        value = xxhash.xxh64_intdigest(bare.encode()) if bare else 0
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 48:
            self[word] = value
        return value


def features(text: str, buckets: int) -> np.ndarray:
    """Distinct buckets of the words, pairs and pairs with one word between, over the whole text."""
    known = kept("toxicity", "words", Words)
    words = np.fromiter(map(known.__getitem__, text.split()), np.uint64)
    words = words[words != 0]
    left, right = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = [words]
    if len(words) > 1:
        mixed.append((words[:-1] * left) ^ (words[1:] * right))
    if len(words) > 2:
        mixed.append((words[:-2] * right) ^ (words[2:] * left) ^ np.uint64(0x5851F42D4C957F2D))
    hashes = np.concatenate(mixed)
    hashes ^= hashes >> np.uint64(29)
    hashes *= left
    return np.unique((hashes >> np.uint64(32)).astype(np.int64) % buckets)


def fit_ftrl(rows: list[tuple[np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights after FTRL-proximal passes; bucket ``settings.buckets`` is the bias."""
    z, n = np.zeros(settings.buckets + 1), np.zeros(settings.buckets + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        pull = z[at]
        size = np.maximum(np.abs(pull) - np.where(at == settings.buckets, 0.0, settings.l1), 0.0)
        return -np.sign(pull) * size / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for buckets, label in rows:
            at = np.append(buckets, settings.buckets)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - step * w
            n[at] += gradient**2
    every = np.flatnonzero(z)
    w = weights(every)
    return every[w != 0], w[w != 0]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "toxic") -> pd.DataFrame:
    """Weights from the documents that have a label, as a small frame (``bucket``, ``weight``).

    The ``settings.sample`` labelled ids with the smallest hashes are used, whole texts, one for each
    id; nulls in id, text or label are no training rows. Without any row there are no weights.
    """
    ship_package(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("id"))
        .orderBy("order", "id")
        .limit(settings.sample)
    )
    rows = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").join(F.broadcast(chosen), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            for part in slices(batch, at):
                found = [features(x, settings.buckets) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(names.index("id")),
                        part.column(names.index("label")),
                        part.column(names.index("order")),
                        pa.array([x.astype("<i4").tobytes() for x in found], pa.binary()),
                    ],
                    names=["id", "label", "order", "buckets"],
                )

    sample = map_arrow(rows.select("id", "text", "label", "order"), hashed, "id long, label int, order long, buckets binary")
    # one text for each id, whatever repeated rows there are
    sample = sample.groupBy("order", "id").agg(F.max("label").alias("label"), F.min("buckets").alias("buckets"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "id"])
        data = [(np.frombuffer(b, "<i4"), int(y)) for b, y in zip(group["buckets"], group["label"])]
        bucket, weight = fit_ftrl(data, settings)
        return pd.DataFrame({"bucket": bucket, "weight": weight})

    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "bucket long, weight double")
    return fitted.toPandas()  # at most settings.buckets + 1 rows, and few of them with L1


def score_documents(
    docs: DataFrame, model: pd.DataFrame, settings: Settings = Settings(), text: str = "text", score: str = "score"
) -> DataFrame:
    """The documents with a score from 0 to 1 of every whole text; a null text is empty.

    A text without words has the score of the bias alone. All columns and rows pass through; a column
    of the input named like the score is replaced. One narrow pass: no shuffle.
    """
    spark = docs.sparkSession
    pairs = model["bucket"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)
    shared = spark.sparkContext.broadcast(pairs)
    own = [c for c in docs.columns if c != score]
    rows = docs.select(*[F.col(f"`{c}`") for c in own])
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(settings.buckets + 1, np.float32)
        weights[shared.value[0]] = shared.value[1]
        bias = float(weights[settings.buckets])
        for batch in batches:
            for part in slices(batch, at):
                sums = np.array(
                    [bias + float(weights[features(x or "", settings.buckets)].sum()) for x in part.column(at).to_pylist()]
                )
                scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(own))], pa.array(scores, pa.float64())], names=[*own, score]
                )

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return map_arrow(rows, run, f"{fields}, `{score}` double")


def held_out(key: Column) -> Column:
    """Fifth of the documents that no label is learned from; null ids belong to it."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the labels outside the held-out fifth, then score every document."""
    seen = labels.where(~held_out(F.col("doc_id")))
    return score_documents(docs, train(docs, seen, settings), settings)
