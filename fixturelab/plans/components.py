"""Match components: expected goals from history, form and meetings, plus market probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions.scores import outcome
from ..operators.state import HALF_LIFE, LOOKBACK, bounded_state, unbounded_state
from ..sources.contests import CLOSING, OPENING, TOTALS

CONCEDED_FLOOR = 0.3
PRICES = (*OPENING, *CLOSING, *TOTALS, "coover", "counder", "b365h", "b365d", "b365a")


@dataclass(frozen=True)
class FeatureConfig:
    """What the expensive part of a backtest depends on; weights are not part of it."""

    lookback: int | None = LOOKBACK
    half_life: float | None = HALF_LIFE
    n_form: int = 3
    n_meet: int = 10
    min_history: int = 100
    league_means: str = "weighted"
    odds_source: str = "closing"
    odds_method: str = "shin"
    block_rows: int | None = None
    order: str = "row"

    def key(self) -> dict:
        return asdict(self)


def odds_groups(df: DataFrame, source: str) -> list[list[str]]:
    """Cascade of complete price triples; later groups are used where the earlier ones have a gap."""
    groups = {"closing": [CLOSING, OPENING], "opening": [OPENING]}[source]
    if {"b365h", "b365d", "b365a"} <= set(df.columns):
        groups = [*groups, ["b365h", "b365d", "b365a"]]
    return groups


def with_market(df: DataFrame, source: str = "closing", method: str = "shin") -> DataFrame:
    """Margin-free market probabilities of 1X2 and, if the table has totals odds, of Over 2.5."""
    q = ["_q1", "_qx", "_q2"]
    df = df.select("*", *O.pick_source(odds_groups(df, source), q, above=1.0))
    df = O.market_probabilities(df, q, ["q1", "qx", "q2"], method)
    df = df.withColumn("has_odds", F.col("q1").isNotNull()).drop(*q)
    if set(TOTALS) <= set(df.columns):
        groups = [TOTALS]
        if source == "closing" and {"coover", "counder"} <= set(df.columns):
            groups = [["coover", "counder"], TOTALS]
        df = df.select("*", *O.pick_source(groups, ["_qo", "_qu"], above=1.0))
        df = O.shin(df, ["_qo", "_qu"], ["q_over", "_pu"])
        df = df.withColumn("has_ou", F.col("q_over").isNotNull()).drop("_qo", "_qu", "_pu")
    return df


def expected_goals(mean_home: Column, mean_away: Column) -> list[Column]:
    """The three pairs of expected goals from the state columns of :mod:`operators.state`.

    The home mean cancels out of ``attack / mean_home * defence / mean_away * mean_home``.
    """
    general = (mean_home + mean_away) / F.lit(2.0)
    hist_h = O.div(F.col("h_gf_venue") * F.col("a_ga_venue"), mean_away)
    hist_a = O.div(F.col("a_gf_venue") * F.col("h_ga_venue"), mean_home)
    floor = F.lit(CONCEDED_FLOOR)
    form_h = F.when(F.col("h_form_venue_gf") > 0, O.div(F.col("h_form_venue_gf") * F.greatest(F.col("a_form_ga"), floor), mean_away))
    form_a = F.when(F.col("a_form_venue_gf") > 0, O.div(F.col("a_form_venue_gf") * F.greatest(F.col("h_form_ga"), floor), mean_home))
    met = F.col("met") > 0
    return [hist_h.alias("xh_hist"), hist_a.alias("xa_hist"),
            F.coalesce(form_h, hist_h).alias("xh_form"), F.coalesce(form_a, hist_a).alias("xa_form"),
            F.when(met, O.div("met_gf", general) * mean_home).otherwise(hist_h).alias("xh_meet"),
            F.when(met, O.div("met_ga", general) * mean_away).otherwise(hist_a).alias("xa_meet"),
            met.alias("meet_valid")]


def plain_means(matches: DataFrame) -> DataFrame:
    """Unweighted goal means of all seasons before each season, one row per league and season."""
    per_season = matches.groupBy("league", "season").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("gh").alias("_h"), F.sum("ga").alias("_a"))
    before = W.partitionBy("league").orderBy("season").rowsBetween(W.unboundedPreceding, -1)
    return per_season.select(
        "league", "season", O.div(F.sum("_h").over(before), F.sum("_n").over(before)).alias("plain_home"),
        O.div(F.sum("_a").over(before), F.sum("_n").over(before)).alias("plain_away"))


def component_state(matches: DataFrame, config: FeatureConfig = FeatureConfig(), seasons: Sequence[int] | None = None,
                    extra: Sequence[str] = (), market: bool = True) -> DataFrame:
    """The state of each match with enough history, with its prices: what configurations share that differ
    in prices, margin method or league means alone.

    Arguments as in :func:`components`.
    """
    prices = [c for c in PRICES if c in matches.columns] if market else []
    carry = [*prices, *extra]
    if seasons is not None and config.lookback is not None:
        starts = matches.where(F.col("season").isin(list(seasons))).groupBy("league").agg(
            (F.min("match_seq") - F.lit(config.lookback)).alias("_from"))
        matches = matches.join(starts, "league").where(F.col("match_seq") >= F.col("_from")).drop("_from")
    if config.lookback is not None:
        if config.order != "row":
            raise ValueError("a frame of rows needs order='row'")
        state = bounded_state(matches, config.lookback, config.half_life, config.n_form, config.n_meet,
                              config.block_rows, carry)
    else:
        state = unbounded_state(matches, config.half_life, config.n_form, config.n_meet, carry=carry, order=config.order,
                                first_season=min(seasons) if seasons else None,
                                **({"block_rows": config.block_rows} if config.block_rows else {}))
    state = state.where((F.col("n_league") >= config.min_history) & (F.col("h_n_prior") > 0) & (F.col("a_n_prior") > 0))
    return state if seasons is None else state.where(F.col("season").isin(list(seasons)))


def components_of(state: DataFrame, matches: DataFrame, config: FeatureConfig = FeatureConfig(), extra: Sequence[str] = (),
                  market: bool = True) -> DataFrame:
    """Components from the rows of :func:`component_state`; no shuffle, but for plain means one row a league and season."""
    prices = [c for c in PRICES if c in state.columns] if market else []
    mean_home, mean_away = F.col("mean_home"), F.col("mean_away")
    if config.league_means == "plain":
        state = state.join(plain_means(matches), ["league", "season"])
        mean_home, mean_away = F.col("plain_home"), F.col("plain_away")
    elif config.league_means == "running":
        mean_home, mean_away = F.col("run_home"), F.col("run_away")
    elif config.league_means != "weighted":
        raise ValueError(f"unknown league mean mode {config.league_means!r}")
    state = state.select(
        "league", "season", "match_seq", "d", "home", "away", "gh", "ga", *prices, *extra, *expected_goals(mean_home, mean_away),
        outcome("gh", "ga").alias("actual"), ((F.col("gh") + F.col("ga")) > 2.5).alias("over_actual"))
    return with_market(state, config.odds_source, config.odds_method).drop(*prices) if market else state


def components(matches: DataFrame, config: FeatureConfig = FeatureConfig(), seasons: Sequence[int] | None = None,
               extra: Sequence[str] = (), market: bool = True) -> DataFrame:
    """One row per match with enough history: expected goals, market probabilities, outcome.

    Matches with fewer than ``min_history`` earlier rows, or with a team never seen before, are left
    out. ``seasons`` limits the output; with a bounded frame the input is first cut to what the
    frames of those seasons can reach. Without ``market`` no prices are carried and no probabilities made.
    """
    return components_of(component_state(matches, config, seasons, extra, market), matches, config, extra, market)
