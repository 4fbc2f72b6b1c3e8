"""Sharding by jump consistent hashing.

Every row goes to the shard that its stable key and the shard count decide; no ring table is kept,
and adding a shard moves rows into the new shard only (about one row in n + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from fixturelab.llm.common import n_bytes
from fixturelab.session import ship_package

#: Multiplier of the generator of the jump hash (fixed value of the published algorithm).
JUMP_MULTIPLIER = np.uint64(2862933555777941757)

#: Slots of equal rows made at once.
RUN = 1 << 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys at once; about ln(shards) rounds are expected."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    open_rows = np.arange(len(state))
    target = np.zeros(len(state), np.int64)
    while len(open_rows):
        shard[open_rows] = target
        state[open_rows] = state[open_rows] * JUMP_MULTIPLIER + np.uint64(1)
        divisor = ((state[open_rows] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target = ((shard[open_rows] + 1) * (float(1 << 31) / divisor)).astype(np.int64)
        inside = target < shards
        open_rows, target = open_rows[inside], target[inside]
    return shard


def stable_key(*columns: Column) -> Column:
    """64-bit key from the text form of the columns; nulls count as a value of their own."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])


def shard_column(key: Column, shards: int) -> Column:
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_hash(keys.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return F.pandas_udf(assign, "int")(key)


def shard_by_key(df: DataFrame, key: Column, shards: int, shard: str = "shard") -> DataFrame:
    """Add the shard of each row. Null keys share one shard; an empty table stays empty."""
    ship_package(df.sparkSession)
    return df.withColumn(shard, shard_column(stable_key(key), shards))


def number_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot", blocks: int = 4096) -> DataFrame:
    """Gapless numbers from 0 within each shard, for any shard size.

    Rows are dealt into ``blocks`` hash blocks of a shard, numbered inside the block and shifted by
    the rows of the blocks before it. Equal rows are counted before the shuffle and numbered as one
    run, so that repeated rows load no task; ``order`` must hold all columns to be kept.
    """
    columns = [shard, *[c for c in order if c != shard]]
    counted = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    block = F.pmod(F.xxhash64(*order), F.lit(blocks))
    inside = W.partitionBy(shard, "_block").orderBy(*order)
    placed = (
        counted.withColumn("_block", block)
        .withColumn("_first", F.sum("_copies").over(inside) - F.col("_copies"))
    )
    sizes = counted.groupBy(F.col(shard), block.alias("_block")).agg(F.sum("_copies").alias("_rows"))
    before = W.partitionBy(shard).orderBy("_block")
    starts = sizes.select(shard, "_block", (F.sum("_rows").over(before) - F.col("_rows")).alias("_start"))
    # the run of equal rows in chunks, so that no array grows with it
    runs = (
        placed.join(starts, [shard, "_block"])
        .withColumn("_from", F.col("_start") + F.col("_first"))
        .withColumn("_end", F.col("_from") + F.col("_copies") - 1)
        .withColumn("_chunk", F.explode(F.expr(f"sequence(_from, _end, {RUN}L)")))
    )
    return runs.withColumn(slot, F.explode(F.expr(f"sequence(_chunk, least(_chunk + {RUN - 1}, _end))"))).select(*columns, slot)


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """Shard, slot and next shard (with one shard more) of every document.

    Null ids share a key of their own; a null text has size 1 and the checksum of no bytes; repeated
    rows keep one slot each; columns other than the key and ``text`` are not read.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (n_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    ship_package(docs.sparkSession)
    hashed = stable_key(F.col("doc_id"))
    sharded = rows.select(
        "*", shard_column(hashed, shards).alias("shard"), shard_column(hashed, shards + 1).alias("grown_shard")
    )
    return number_slots(sharded, "shard", ["doc_id", "size", "text_crc32", "grown_shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
