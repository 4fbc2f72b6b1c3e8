"""Parquet tables: the merged match table, and results computed once and read many times."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

_written: set[str] = set()


def write_matches(df: DataFrame, path: str) -> None:
    """Merged match table, laid out so that league and season filters prune folders.

    Only the folders of leagues and seasons in ``df`` are replaced; the others stay.
    """
    ordered = df.repartition("league", "season")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league", "season").parquet(path)


def read_matches(spark: SparkSession, path: str, first_season: int | None = None, leagues: Sequence[int] | None = None) -> DataFrame:
    """The stored matches from a season on, of some leagues: other folders are not listed."""
    df = spark.read.parquet(path)
    if first_season is not None:
        df = df.where(df["season"] >= first_season)
    return df if leagues is None else df.where(df["league"].isin(list(leagues)))


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Grid-search and comparison results, in parquet or csv."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def config_key(name: str, config: Mapping[str, object]) -> str:
    text = json.dumps(dict(config), sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; built and written first if it is missing or ``force`` is set."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if force or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored(spark: SparkSession, name: str, config: Mapping[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """Result kept in the shared folder for the life of this application.

    The first caller computes and writes it, later ones read it; nothing of another run is reused.
    """
    path = f"{shared_dir(spark)}/fixturelab/{spark.sparkContext.applicationId}/{config_key(name, config)}"
    df = cached_table(spark, path, build, force=path not in _written)
    _written.add(path)
    return df


def stored_files(spark: SparkSession, name: str, config: Mapping[str, object], write: Callable[[str], None]) -> str:
    """Folder in the shared one that ``write`` fills once in the life of this application."""
    path = f"{shared_dir(spark)}/fixturelab/{spark.sparkContext.applicationId}/{config_key(name, config)}"
    if path not in _written:
        write(path)
        _written.add(path)
    return path
