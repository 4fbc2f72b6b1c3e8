"""Slips: validated fixtures, best market per match, selection, and exact slip probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import odds as O


def validate(df: DataFrame, home: str = "home", away: str = "away", odds: Sequence[str] = ("o1", "ox", "o2"),
             totals: Sequence[str] = ("oover", "ounder")) -> DataFrame:
    """Add ``reason``: why a fixture row cannot be used (null if it can). Wholly empty rows are dropped."""
    h, a = F.col(home), F.col(away)
    empty = h.isNull() & a.isNull()
    for c in (*odds, *totals):
        empty = empty & F.col(c).isNull()
    missing, low = F.lit(False), F.lit(False)
    for c in odds:
        missing = missing | F.col(c).isNull()
        low = low | (F.col(c) <= 1.0)
    reason = (F.when(h.isNull() | a.isNull(), F.lit("both teams needed")).when(h == a, F.lit("same team twice"))
              .when(missing, F.lit("odds missing")).when(low, F.lit("odds must exceed one")))
    return df.where(~empty).withColumn("reason", reason)


def hits_step(dist: Column, p: Column) -> Column:
    """Distribution of the number of hits after one more pick."""
    miss = F.concat(F.transform(dist, lambda x: x * (F.lit(1.0) - p)), F.array(F.lit(0.0)))
    hit = F.concat(F.array(F.lit(0.0)), F.transform(dist, lambda x: x * p))
    return F.zip_with(miss, hit, lambda a, b: a + b)


def hits_distribution(probabilities: Column) -> Column:
    """Exact distribution of the number of hits (element k+1 is the probability of k)."""
    return F.aggregate(probabilities, F.array(F.lit(1.0)), hits_step)


def summarise(df: DataFrame, by: Sequence[str], conf: str = "confidence", price: str = "pick_odds", margin: str = "margin") -> DataFrame:
    """One row per slip. A slip is a short list of picks; its picks are multiplied out exactly."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_matches"), F.product(price).alias("multiplier"), F.product(conf).alias("p_all"),
        F.avg(conf).alias("mean_confidence"), F.avg(margin).alias("mean_margin"),
        F.sort_array(F.collect_list(conf)).alias("_p"))
    out = out.withColumn("distribution", hits_distribution(F.col("_p"))).drop("_p")
    n = F.col("n_matches").cast("int")
    inf = F.lit(float("inf"))
    return out.select(
        "*", F.when(F.col("p_all") > 0, O.div(F.lit(1.0), F.col("p_all"))).otherwise(inf).alias("one_in"),
        (F.element_at("distribution", n + 1) + F.element_at("distribution", n)).alias("p_at_least_n_minus_1"),
        (F.col("multiplier") * F.col("p_all")).alias("expected_return"))


def expected_hits(distribution: str = "distribution") -> Column:
    k = F.transform(distribution, lambda x, i: x * i.cast("double"))
    return F.aggregate(k, F.lit(0.0), lambda acc, x: acc + x)


def top_tail(df: DataFrame, by: Sequence[str], last: int = 4) -> DataFrame:
    """The ``last`` highest numbers of hits of each slip with their probabilities."""
    return df.select(*by, "n_matches", F.posexplode("distribution").alias("hits", "probability")).where(
        F.col("hits") > F.col("n_matches") - last)


def market_candidates(df: DataFrame, p1: str = "p1", px: str = "px", p2: str = "p2", p_over: str | None = "p_over",
                      odds: Sequence[str] = ("o1", "ox", "o2"), totals: Sequence[str] = ("oover", "ounder"),
                      markets: str = "both") -> DataFrame:
    """One pick per match: the more confident of the allowed markets, 1X2 on ties."""
    pick = O.pick_1x2(p1, px, p2)
    c = lambda a, b, d: O.by_class(F.col("_pick"), F.col(a), F.col(b), F.col(d))
    df = df.withColumn("_pick", pick)
    one = F.struct(c(p1, px, p2).alias("confidence"), F.lit("1X2").alias("market"), F.col("_pick").alias("pick"),
                   c(*odds).alias("pick_odds"), O.margin(odds).alias("margin"))
    if p_over is None or markets == "1X2":
        return df.select("*", one.alias("_c")).select("*", "_c.*").drop("_c", "_pick")
    over, under = totals
    is_over = F.col(p_over) >= F.lit(1.0) - F.col(p_over)
    priced = O.all_known(totals, above=1.0)
    two = F.when(priced, F.struct(
        F.greatest(F.col(p_over), F.lit(1.0) - F.col(p_over)).alias("confidence"), F.lit("Over/Under 2.5").alias("market"),
        F.when(is_over, F.lit("Over 2.5")).otherwise(F.lit("Under 2.5")).alias("pick"),
        F.when(is_over, F.col(over)).otherwise(F.col(under)).alias("pick_odds"), O.margin(totals).alias("margin")))
    df = df.select("*", one.alias("_one"), two.alias("_two"))
    if markets == "Over/Under":
        chosen = F.col("_two")
    else:
        chosen = F.when(F.col("_two.confidence") > F.col("_one.confidence"), F.col("_two")).otherwise(F.col("_one"))
    return df.select("*", chosen.alias("_c")).where(F.col("_c").isNotNull()).select("*", "_c.*").drop("_c", "_one", "_two", "_pick")


def select_top(df: DataFrame, by: Sequence[str], size: int, threshold: float | None = None,
               order: Sequence[str] = ("league", "match_seq"), conf: str = "confidence") -> DataFrame:
    """Mark the ``size`` most confident picks of each slip at or above the threshold; the rest is excluded.

    Ranks are needed for the leading picks only; Spark limits them within each task before the shuffle.
    """
    ranked = best_of(df, by, size, threshold, order, conf).select(*by, *order, F.lit(True).alias("selected"))
    return df.join(ranked, [*by, *order], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def best_of(df: DataFrame, by: Sequence[str], size: int, threshold: float | None = None,
            order: Sequence[str] = ("league", "match_seq"), conf: str = "confidence") -> DataFrame:
    """The ``size`` most confident picks of each slip, ties in match order."""
    if threshold is not None:
        df = df.where(F.col(conf) >= threshold)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(conf), *order))
    return df.withColumn("rank", rank).where(F.col("rank") <= size)


def hit_of(df: DataFrame) -> Column:
    """Whether the pick came true."""
    over = F.when(F.col("pick") == "Over 2.5", F.col("over_actual")).otherwise(~F.col("over_actual"))
    return F.when(F.col("market") == "1X2", F.col("pick") == F.col("actual")).otherwise(over)


def slip_backtest(picks: DataFrame, by: Sequence[str], size: int = 13) -> DataFrame:
    """Top ``size`` picks per slip: declared full-slip probability against what happened."""
    top = best_of(picks, by, size)
    per = top.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.product("confidence").alias("declared"),
                               F.min(F.col("hit").cast("int")).alias("full"), F.sum(F.col("hit").cast("int")).alias("hits"))
    return per.where(F.col("n") == size)
