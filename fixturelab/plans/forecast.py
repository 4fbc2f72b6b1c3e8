"""Forecast of any pair of teams from the state at the end of the history, and the slip built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decay as D
from ..functions import odds as O
from ..functions.blend import RHO, blend_1x2
from ..functions.scores import score_outcomes, top_scores
from ..operators.features import prices_from_meetings
from ..operators.state import HALF_LIFE, _meetings, appearances
from . import slips as P
from .components import CONCEDED_FLOOR


def latest(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key; Spark limits the ranks within each task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("match_seq")))
    return df.withColumn("_k", rank).where(F.col("_k") <= n)


def team_form(rows: DataFrame, n: int = 3) -> DataFrame:
    """Goals in the last ``n`` matches overall, and scored in the last ``n`` at each venue (zero if none)."""
    last = latest(rows, ["league", "team"], n).groupBy("league", "team").agg(
        F.avg("gf").alias("form_gf"), F.avg("ga").alias("form_ga"))
    venue = latest(rows, ["league", "team", "venue"], n).groupBy("league", "team").agg(
        F.coalesce(F.avg(F.when(F.col("venue") == "H", F.col("gf"))), F.lit(0.0)).alias("form_home"),
        F.coalesce(F.avg(F.when(F.col("venue") == "A", F.col("gf"))), F.lit(0.0)).alias("form_away"))
    return last.join(venue, ["league", "team"])


def tallies(meetings: Column, home: Column) -> list[Column]:
    """Wins, draws and losses of the home team over past meetings."""
    def count(cond) -> Column:
        return F.size(F.filter(meetings, cond))

    lead = lambda x: F.when(x["home"] == home, x["gh"] - x["ga"]).otherwise(x["ga"] - x["gh"])
    return [count(lambda x: lead(x) > 0).alias("met_won"), count(lambda x: lead(x) == 0).alias("met_drawn"),
            count(lambda x: lead(x) < 0).alias("met_lost")]


NO_HISTORY = "no history for a team"


def with_history(history: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Set ``reason`` of the fixtures that have none yet and a team without matches in the league's history."""
    teams = history.select("league", F.explode(F.array("home", "away")).alias("_team")).distinct()
    side = lambda name: teams.select("league", F.col("_team").alias(name), F.lit(True).alias(f"_known_{name}"))
    f = fixtures.join(side("home"), ["league", "home"], "left").join(side("away"), ["league", "away"], "left")
    missing = F.col("_known_home").isNull() | F.col("_known_away").isNull()
    own = F.col("reason") if "reason" in fixtures.columns else F.lit(None).cast("string")
    return f.select(*[c for c in fixtures.columns if c != "reason"], F.coalesce(own, F.when(missing, F.lit(NO_HISTORY))).alias("reason"))


def forecast(history: DataFrame, fixtures: DataFrame, form: float = 0.0, meet: float = 0.0, odds: float = 1.0, rho: float = RHO,
             half_life: float | None = HALF_LIFE, n_form: int = 3, n_meet: int = 10) -> DataFrame:
    """Forecast every fixture (league, home, away, optional o1, ox, o2) from the whole history.

    A fixture's own prices are used when all exceed one; otherwise prices of past meetings stand in.
    Fixtures with a team that has no history come back without numbers and with a ``reason``.
    """
    judged = with_history(history, fixtures.drop("reason"))
    rejected = judged.where(F.col("reason").isNotNull())
    fixtures = judged.where(F.col("reason").isNull()).drop("reason")
    ref = history.groupBy("league").agg(F.max("d").alias("_ref"))
    dated = history.join(ref, "league")
    means = D.league_means(dated, F.col("_ref"), half_life)
    rows = appearances(dated, ["_ref"])
    team = D.team_strengths(rows, F.col("_ref"), half_life).join(team_form(rows, n_form), ["league", "team"])
    side = lambda name, p: team.select("league", F.col("team").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in team.columns if c not in ("league", "team")])
    pair = [F.least("home", "away").alias("_lo"), F.greatest("home", "away").alias("_hi")]
    meetings = history.select("league", *pair, "match_seq", "home", "gh", "ga", *O.first_known(["c1", "cx", "c2"], ["o1", "ox", "o2"], ["_h", "_d", "_a"]))
    meetings = latest(meetings, ["league", "_lo", "_hi"], n_meet).groupBy("league", "_lo", "_hi").agg(
        F.sort_array(F.collect_list(F.struct("match_seq", "home", "gh", "ga", "_h", "_d", "_a"))).alias("_met"))
    f = fixtures.select("*", *pair).join(side("home", "h"), ["league", "home"]).join(side("away", "a"), ["league", "away"])
    f = f.join(means, "league").join(meetings, ["league", "_lo", "_hi"], "left")
    f = f.withColumn("_met", F.coalesce("_met", F.filter(F.array(F.struct(
        F.lit(0).cast("long").alias("match_seq"), F.col("home"), F.lit(0).alias("gh"), F.lit(0).alias("ga"),
        *[F.lit(0.0).alias(c) for c in ("_h", "_d", "_a")])), lambda x: F.lit(False))))
    f = f.select("*", *_meetings(F.col("_met")), *tallies(F.col("_met"), F.col("home")))
    f = prices_from_meetings(f.drop("q1", "qx", "q2"), [c for c in f.columns if c != "met"])
    f = f.withColumnsRenamed({"q1": "_m1", "qx": "_mx", "q2": "_m2"})
    have = {"o1", "ox", "o2"} <= set(fixtures.columns)
    if have:
        own = O.all_known(["o1", "ox", "o2"], above=1.0)
        f = f.select("*", *[F.when(own, F.col(c)).alias(f"_q_{c}") for c in ("o1", "ox", "o2")])
        f = O.shin(f, ["_q_o1", "_q_ox", "_q_o2"], ["_f1", "_fx", "_f2"])
    else:
        # no steps over constant nulls: the optimizer would unfold them all
        f = f.select("*", *[F.lit(None).cast("double").alias(f"_f{k}") for k in "1x2"])
    f = f.select("*", *[F.coalesce(f"_f{k}", f"_m{k}").alias(f"q{k}") for k in "1x2"]).withColumn("has_odds", F.col("q1").isNotNull())
    mh, ma = F.col("mean_home"), F.col("mean_away")
    general, floor = (mh + ma) / F.lit(2.0), F.lit(CONCEDED_FLOOR)
    hist_h, hist_a = O.div(F.col("h_att_home") * F.col("a_def_away"), ma), O.div(F.col("a_att_away") * F.col("h_def_home"), mh)
    met = F.col("met") > 0
    f = f.select(
        "*", hist_h.alias("xh_hist"), hist_a.alias("xa_hist"),
        F.when(F.col("h_form_home") > 0, O.div(F.col("h_form_home") * F.greatest(F.col("a_form_ga"), floor), ma)).otherwise(hist_h).alias("xh_form"),
        F.when(F.col("a_form_away") > 0, O.div(F.col("a_form_away") * F.greatest(F.col("h_form_ga"), floor), mh)).otherwise(hist_a).alias("xa_form"),
        F.when(met, O.div("met_gf", general) * mh).otherwise(hist_h).alias("xh_meet"),
        F.when(met, O.div("met_ga", general) * ma).otherwise(hist_a).alias("xa_meet"), met.alias("meet_valid"))
    f = blend_1x2(f, form, meet, odds, rho, floor=None, keep_base=True)
    f = score_outcomes(f, "xh", "xa", rho, {k: k for k in ("over15", "over25", "under25")})
    f = f.withColumn("goals", F.col("xh") + F.col("xa"))
    f = top_scores(f, "xh", "xa", rho)
    f = f.select(*fixtures.columns, "xh", "xa", "p1", "px", "p2", "p1_base", "px_base", "p2_base", "has_odds", "q1", "qx", "q2",
                    "over15", "over25", "under25", "goals", "met", "met_gf", "met_ga", "met_won", "met_drawn", "met_lost", "top_scores")
    return f.unionByName(rejected, allowMissingColumns=True)


def build_slips(history: DataFrame, fixtures: DataFrame, by: Sequence[str], order: Sequence[str], size: int = 13, threshold: float = 0.55,
                markets: str = "both", weights: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Picks of all fixtures (selected, excluded, or rejected with a ``reason``) and the summary of each slip."""
    checked = with_history(history, P.validate(fixtures))
    f = forecast(history, checked.where(F.col("reason").isNull()).drop("reason"), *weights)
    w = F.lit(float(weights[2]))
    totals = O.analyse_over_under(f, "oover", "ounder", "over25", w).withColumnRenamed("prob_over", "p_over")
    picks = P.market_candidates(totals, markets=markets)
    picks = P.select_top(picks, by, size, threshold, order)
    rejected = checked.where(F.col("reason").isNotNull()).withColumn("selected", F.lit(False))
    return picks.unionByName(rejected, allowMissingColumns=True), P.summarise(picks.where("selected"), by)
