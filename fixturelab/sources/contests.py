"""Contests: the typed match table every feature starts from, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import dense_position

TIE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
CORE = ["league", "season", "match_seq", "d", "home", "away", "gh", "ga"]
STATS = ["hst", "ast", "hc", "ac"]
OPENING, CLOSING, TOTALS = ["o1", "ox", "o2"], ["c1", "cx", "c2"], ["oover", "ounder"]


def season_of(date: Column) -> Column:
    """Season label: the year in which a season running from July to June starts."""
    return F.year(date) - F.when(F.month(date) < 7, F.lit(1)).otherwise(F.lit(0))


def paired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as pairings of two teams on a day, with what the other columns of a match hang on."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    teams = sup.agg(F.floor(F.count(F.lit(1)) / F.lit(5)).alias("k"))
    paired = li.crossJoin(F.broadcast(teams)).select(
        (F.col("l_suppkey") % 5).alias("league"),
        (F.col("l_suppkey") % 5 + F.lit(5) * (F.col("l_partkey") % F.col("k"))).alias("away"),
        F.to_date("l_shipdate").alias("d"), "l_discount", "l_tax", *TIE_KEYS)
    return paired.where(F.col("l_suppkey") != F.col("away"))


def as_matches(lines: DataFrame, *keep: str) -> DataFrame:
    """Matches of :func:`paired_lines`, with the columns ``keep``."""
    qty = F.col("l_quantity").cast("int")
    gross = F.lit(1.03) + F.col("l_discount")

    def triple(modulus: int, names: list[str]) -> list[Column]:
        w = [F.lit(2) + qty % modulus, F.lit(3), F.lit(1) + F.col("l_partkey") % 5]
        total = (w[0] + w[1] + w[2]).cast("double")
        return [F.round(F.lit(1.0) / ((x.cast("double") / total) * gross), 2).alias(n) for x, n in zip(w, names)]

    over, under = F.lit(2) + qty % 5, F.lit(2) + F.col("l_linenumber") % 4
    vig = F.lit(1.02) + F.col("l_tax")
    both = (over + under).cast("double")
    base = lines.select(
        *keep, "league", F.col("l_suppkey").alias("home"), "away",
        (qty % 5).alias("gh"),
        (F.col("l_linenumber") % 4).alias("ga"),
        "d", "l_linenumber",
        *triple(7, OPENING),
        *triple(6, ["_c1", "_cx", "_c2"]),
        F.round(F.lit(1.0) / ((over.cast("double") / both) * vig), 2).alias("oover"),
        F.round(F.lit(1.0) / ((under.cast("double") / both) * vig), 2).alias("ounder"),
        # shots on target and corners; shots are missing on some matches
        F.when(F.col("l_linenumber") != 5, qty % 9).alias("hst"),
        F.when(F.col("l_linenumber") != 5, (F.col("l_partkey") % 8).cast("int")).alias("ast"),
        (qty % 11).alias("hc"),
        (F.col("l_orderkey") % 7).cast("int").alias("ac"),
    )
    closed = F.col("l_linenumber") != 7
    for n in CLOSING:
        base = base.withColumn(n, F.when(closed, F.col(f"_{n}")))
    return base.withColumn("season", season_of(F.col("d"))).drop("_c1", "_cx", "_c2", "l_linenumber")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match with its dense position ``match_seq`` in the league.

    The pairings are numbered; prices, goals and statistics are made from them afterwards, so that
    they pass through no shuffle.
    """
    lead = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(
        F.min(TIE_KEYS[0]).alias("_lo"), F.max(TIE_KEYS[0]).alias("_hi"))
    numbered = dense_position(paired_lines(spark, sf_dir), ["league"], "d", TIE_KEYS, "match_seq", low_high=lead)
    return as_matches(numbered, "match_seq").select(*CORE, *OPENING, *CLOSING, *TOTALS, *STATS)
