"""Backtest metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.odds import by_class, div, pick_1x2
from ..functions.scores import log_loss, rps

CLASSES = ("1", "X", "2")


def scored(df: DataFrame, rule: str = "strict") -> DataFrame:
    """Add the prediction, whether it hit, and the per-match scores."""
    df = df.withColumn("pred", pick_1x2("p1", "px", "p2", rule))
    p_actual = by_class(F.col("actual"), F.col("p1"), F.col("px"), F.col("p2"))
    return df.select("*", (F.col("pred") == F.col("actual")).alias("hit"),
                     rps("p1", "px", "actual").alias("rps"), log_loss(p_actual).alias("logloss"))


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def metric_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"),
        rate(F.col("hit")).alias("accuracy"), rate(F.col("actual") == "1").alias("home_rate"),
        rate(F.col("pred") == "1").alias("pred_home_share"), F.avg("rps").alias("rps"), F.avg("logloss").alias("logloss"),
    ]


def metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns())


def metrics_rollup(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics by ``by`` and for each total above it; a total has -1 in the columns it sums over."""
    total = [F.when(F.grouping(c) == 1, F.lit(-1)).otherwise(F.col(c)).alias(f"_of_{c}") for c in by]
    names = [c for c in df.rollup(*by).agg(*metric_columns()).columns if c not in by]
    return df.rollup(*by).agg(*metric_columns(), *total).select(*[F.col(f"_of_{c}").alias(c) for c in by], *names)


def macro_mean(df: DataFrame, by: Sequence[str], over: str = "season") -> DataFrame:
    """Mean across seasons of the per-season metrics."""
    per = metrics(df, [*by, over])
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("seasons"), F.avg("accuracy").alias("accuracy"),
                                F.avg("rps").alias("rps"), F.avg("pred_home_share").alias("pred_home_share"))


def class_grid(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("actual"))


def confusion(df: DataFrame) -> DataFrame:
    """Counts actual x predicted over the fixed classes, zero cells kept."""
    counts = df.groupBy("actual").agg(*[F.sum(F.when(F.col("pred") == c, 1).otherwise(0)).alias(f"pred_{c.lower()}") for c in CLASSES])
    return class_grid(df.sparkSession).join(counts, "actual", "left").na.fill(0)


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; zero where undefined."""
    label = F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("label")
    cells = df.groupBy("actual", "pred").agg(F.count(F.lit(1)).alias("_n"))
    mine, said = F.col("actual") == F.col("label"), F.col("pred") == F.col("label")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))

    out = cells.select("*", label).groupBy("label").agg(
        total(mine & said).alias("_tp"), total(said).alias("_said"), total(mine).alias("support"))
    zero = F.lit(0.0)
    out = out.select("label", "support", F.coalesce(div("_tp", "_said"), zero).alias("precision"),
                     F.coalesce(div("_tp", "support"), zero).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return out.select("*", F.coalesce(div(F.lit(2.0) * p * r, p + r), zero).alias("f1"))


def calibration(df: DataFrame, by: Sequence[str], conf: str, hit: Column, min_rows: int = 50) -> DataFrame:
    """Weighted mean gap between declared and observed rates over confidence bins of 0.05."""
    bins = F.floor((F.col(conf) - F.lit(0.5)) / F.lit(0.05) + F.lit(1e-9))
    inside = (F.col(conf) >= 0.5) & (F.col(conf) < 1.0)
    per = df.where(inside).withColumn("_bin", bins).groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(conf).alias("_c"), F.avg(hit.cast("double")).alias("_h"))
    per = per.where(F.col("_n") >= min_rows)
    gap = F.abs(F.col("_c") - F.col("_h"))
    return per.groupBy(*by).agg((F.sum(gap * F.col("_n")) / F.sum("_n")).alias("calibration_gap"),
                                F.count(F.lit(1)).alias("bins"))
