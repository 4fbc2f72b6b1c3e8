"""Exponential time decay with a fixed reference date, as expressions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .odds import col


def decay_weight(days: Column, half_life: float | None) -> Column:
    """``0.5 ** (days / half_life)`` with negative ages counted as zero; one without a half-life."""
    if half_life is None or half_life <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(days.cast("double"), F.lit(0.0)) / F.lit(float(half_life)))


def age_days(ref: str | Column, date: str | Column) -> Column:
    return F.datediff(col(ref), col(date))


def decayed_mean(value: str | Column, weight: str | Column) -> Column:
    v, w = col(value), col(weight)
    return F.sum(v * w) / F.sum(w)


def decayed_group_mean(df: DataFrame, group: list[str], value: str, date: str, ref: Column, half_life: float | None,
                       out: str | None = None) -> DataFrame:
    """Grouped mean with exponential decay towards a reference date (partial sums combine map-side)."""
    w = decay_weight(F.datediff(ref, F.col(date)), half_life)
    return df.withColumn("_w", w).groupBy(*group).agg(decayed_mean(value, "_w").alias(out or value))


def league_means(df: DataFrame, ref: Column, half_life: float | None, by: tuple[str, ...] = ("league",)) -> DataFrame:
    """Decayed home and away goal means; the plain mean when every weight vanishes."""
    w = decay_weight(F.datediff(ref, F.col("d")), half_life)
    total = F.sum("_w")
    return df.withColumn("_w", w).groupBy(*by).agg(
        F.when(total > 0, F.sum(F.col("gh") * F.col("_w")) / total).otherwise(F.avg("gh")).alias("mean_home"),
        F.when(total > 0, F.sum(F.col("ga") * F.col("_w")) / total).otherwise(F.avg("ga")).alias("mean_away"),
    )


def team_strengths(appearances: DataFrame, ref: Column, half_life: float | None,
                   by: tuple[str, ...] = ("league", "team")) -> DataFrame:
    """Decayed attack and defence at home and away, one pass over the appearances.

    A team without home (or away) history gets zero there, not null.
    """
    w = decay_weight(F.datediff(ref, F.col("d")), half_life)
    at_home = F.col("venue") == "H"

    def mean(goal: str, here: Column) -> Column:
        return F.coalesce(
            F.sum(F.when(here, F.col(goal) * F.col("_w"))) / F.sum(F.when(here, F.col("_w"))), F.lit(0.0))

    return appearances.withColumn("_w", w).groupBy(*by).agg(
        mean("gf", at_home).alias("att_home"), mean("ga", at_home).alias("def_home"),
        mean("gf", ~at_home).alias("att_away"), mean("ga", ~at_home).alias("def_away"),
    )
