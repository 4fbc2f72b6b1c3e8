"""Blend of history, form, meetings, ratings and market into final probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .odds import div, settled
from .scores import score_outcomes

RHO = -0.10
XG_FLOOR = 0.05
SNAP = 1e-12


def _value(x: float | str | Column) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def blended_goals(df: DataFrame, form: float | str | Column, meet: float | str | Column, odds: float | str | Column,
                  elo: float | str | Column | None = None, rule: str = "odds_counted", floor: float | None = XG_FLOOR,
                  names: tuple[str, str, str] = ("xh", "xa", "w_odds")) -> DataFrame:
    """Add the blended expected goals and the weight left to the market.

    ``odds_counted``: all weights share one; above one they are scaled down and history gets
    nothing, below it history takes the rest; without odds their weight goes to history.
    ``odds_aside``: history takes what form and meetings leave, the market weight is separate.
    With ``elo`` the table must hold ``elo_valid`` and the ratings' expected goals ``xh_elo, xa_elo``.
    """
    keep = df.columns
    zero, one = F.lit(0.0), F.lit(1.0)
    df = df.select("*", _value(form).alias("_pf"),
                   F.when(F.col("meet_valid"), _value(meet)).otherwise(zero).alias("_ps"),
                   (F.when(F.col("elo_valid"), _value(elo)).otherwise(zero) if elo is not None else zero).alias("_pe"),
                   _value(odds).alias("_pq"))
    if rule == "odds_counted":
        df = df.withColumn("_t", F.col("_pf") + F.col("_ps") + F.col("_pe") + F.col("_pq"))
        over = F.col("_t") > 1
        scaled = lambda c: F.when(over, F.col(c) / F.col("_t")).otherwise(F.col(c))
        df = df.select(*keep, "_t", *[scaled(c).alias(c) for c in ("_pf", "_ps", "_pe", "_pq")])
        rest = one - F.col("_pf") - F.col("_ps") - F.col("_pe") - F.col("_pq")
        df = df.withColumn("_ph", F.when(F.col("_t") > 1, zero).when(F.abs(rest) < SNAP, zero).otherwise(rest))
        no_odds = ~F.col("has_odds")
        df = df.withColumn("_ph", F.col("_ph") + F.when(no_odds, F.col("_pq")).otherwise(zero))
        df = df.withColumn("_pq", F.when(no_odds, zero).otherwise(F.col("_pq")))
    elif rule == "odds_aside":
        rest = one - F.col("_pf") - F.col("_ps") - F.col("_pe")
        df = df.withColumn("_ph", F.when(rest < SNAP, zero).otherwise(rest))
    else:
        raise ValueError(f"unknown weight rule {rule!r}")
    df = df.withColumn("_sx", F.col("_ph") + F.col("_pf") + F.col("_ps") + F.col("_pe"))

    def mix(side: str) -> Column:
        total = (F.col("_ph") * F.col(f"x{side}_hist") + F.col("_pf") * F.col(f"x{side}_form")
                 + F.col("_ps") * F.col(f"x{side}_meet"))
        if elo is not None:
            total = total + F.when(F.col("_pe") > 0, F.col("_pe") * F.col(f"x{side}_elo")).otherwise(zero)
        x = F.when(F.col("_sx") > 0, div(total, "_sx")).otherwise(F.col(f"x{side}_hist"))
        return x if floor is None else F.greatest(F.lit(floor), x)

    return df.select(*keep, settled(mix("h")).alias(names[0]), settled(mix("a")).alias(names[1]), F.col("_pq").alias(names[2]))


def blend_1x2(df: DataFrame, form: float | str | Column = 0.0, meet: float | str | Column = 0.0,
              odds: float | str | Column = 1.0, rho: float | str | Column = RHO, elo: float | str | Column | None = None,
              rule: str = "odds_counted", floor: float | None = XG_FLOOR, over: bool = False,
              keep_base: bool = False) -> DataFrame:
    """Add ``p1, px, p2`` (and ``p_over`` with ``over``): the score model mixed with the market."""
    df = blended_goals(df, form, meet, odds, elo, rule, floor, ("xh", "xa", "_wq"))
    names = {"p1": "_b1", "px": "_bx", "p2": "_b2"}
    if over:
        names["over25"] = "_bo"
    df = score_outcomes(df, "xh", "xa", rho, names)
    w = F.when(F.col("has_odds"), F.col("_wq")).otherwise(F.lit(0.0))
    mixed = [((F.lit(1.0) - w) * F.col(b) + w * F.coalesce(F.col(q), F.lit(0.0))).alias(p)
             for p, b, q in (("p1", "_b1", "q1"), ("px", "_bx", "qx"), ("p2", "_b2", "q2"))]
    if over:
        wo = F.when(F.col("has_ou"), F.col("_wq")).otherwise(F.lit(0.0))
        mixed.append(((F.lit(1.0) - wo) * F.col("_bo") + wo * F.coalesce(F.col("q_over"), F.lit(0.0))).alias("p_over"))
    if keep_base:
        mixed += [F.col("_b1").alias("p1_base"), F.col("_bx").alias("px_base"), F.col("_b2").alias("p2_base")]
    inner = {"_wq", *names.values()}
    return df.select(*[c for c in df.columns if c not in inner], *mixed)


def blend_over(df: DataFrame, form: float | str | Column = 0.10, meet: float | str | Column = 0.0,
               odds: float | str | Column = 0.0, rho: float | str | Column = RHO, out: str = "p_over") -> DataFrame:
    """Over 2.5 from the score model, mixed with the totals market; history takes what form and meetings leave."""
    keep = df.columns
    df = blended_goals(df, form, meet, odds, rule="odds_aside", names=("_xh", "_xa", "_wq"))
    df = score_outcomes(df, "_xh", "_xa", rho, {"over25": "_bo"})
    w = F.when(F.col("has_ou"), F.col("_wq")).otherwise(F.lit(0.0))
    return df.select(*keep, ((F.lit(1.0) - w) * F.col("_bo") + w * F.coalesce(F.col("q_over"), F.lit(0.0))).alias(out))


def elo_goals(diff: Column, intercept: Column, slope: Column) -> Column:
    """Expected goals from a rating difference; a missing rating counts as no difference."""
    return F.exp(intercept + slope * F.coalesce(diff, F.lit(0.0)))
