"""Bookmaker odds as column expressions: margin removal, cascades, match analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Halley steps after the closed first step: two reach double precision at the margins of real prices,
# six at a margin of 100 % (three prices of 1.01, 1.02 and 900).
SHIN_STEPS = 6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: str | Column) -> Column:
    """Quotient that is null where the divisor is zero."""
    return F.try_divide(col(a), col(b))


def settled(c: Column) -> Column:
    """The same value, fenced off from predicate push-down.

    A filter on the end of a long chain of projections is rewritten into the first one, copying
    every shared sub-expression at each level until the plan no longer fits in memory. The guard is
    always true; it only marks the expression as one the optimizer must not move.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def add(cols: Sequence[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def implied(odds: Sequence[str | Column]) -> list[Column]:
    return [F.lit(1.0) / col(o) for o in odds]


def margin(odds: Sequence[str | Column]) -> Column:
    """Overround: how far the implied probabilities exceed one."""
    return add(implied(odds)) - F.lit(1.0)


def proportional(odds: Sequence[str | Column]) -> list[Column]:
    """Margin removed evenly across the outcomes."""
    pi = implied(odds)
    total = add(pi)
    return [p / total for p in pi]


def _inv(x: Column) -> Column:
    """Reciprocal as a power: unlike a division it is never null, which keeps the generated code small."""
    return F.pow(x, F.lit(-1.0))


def shin(df: DataFrame, odds: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Add the margin-free probabilities of Shin's model for ``n >= 2`` outcomes.

    With ``a_i = 4 pi_i^2 / S`` and ``r_i = sqrt(z^2 + (1 - z) a_i)`` the condition that the
    probabilities sum to one is ``sum(r_i) = 2 + (n - 2) z``. For two outcomes it has the closed form
    ``p_i = pi_i - (S - 1) / 2``; beyond that the first Newton step from z = 0 is closed too and
    Halley steps finish. Every step is a projection over the whole table: no shuffle on distinct
    prices and no loop per row. A missing price gives null probabilities.
    """
    n = len(odds)
    keep = df.columns
    known = all_known(odds)
    total = F.col("_shin_s")
    pi = [F.col(f"_shin_pi{i}") for i in range(n)]
    df = df.select("*", *[F.coalesce(_inv(F.col(o)), F.lit(0.0)).alias(f"_shin_pi{i}") for i, o in enumerate(odds)])
    df = df.select("*", add(pi).alias("_shin_s"))
    if n == 2:
        half = (total - F.lit(1.0)) * F.lit(0.5)
        raw = [F.when(total <= 1.0, p * _inv(total)).otherwise(p - half) for p in pi]
        return df.select(*keep, *[settled(F.when(known, r)).alias(o) for r, o in zip(raw, out)])
    free = F.lit(n - 2.0)
    z = F.col("_shin_z")
    a = [F.col(f"_shin_a{i}") for i in range(n)]
    r = [F.col(f"_shin_r{i}") for i in range(n)]
    root = F.sqrt(total)
    df = df.select(
        "*", *[(F.lit(4.0) * p * p * _inv(total)).alias(f"_shin_a{i}") for i, p in enumerate(pi)],
        (F.lit(2.0) * (root - F.lit(1.0)) * _inv(root + free)).alias("_shin_z"))
    base = [*keep, "_shin_s", *[f"_shin_pi{i}" for i in range(n)], *[f"_shin_a{i}" for i in range(n)]]
    roots = [F.sqrt(z * z + (F.lit(1.0) - z) * a_i).alias(f"_shin_r{i}") for i, a_i in enumerate(a)]
    inverse = [_inv(r_i).alias(f"_shin_v{i}") for i, r_i in enumerate(r)]
    v = [F.col(f"_shin_v{i}") for i in range(n)]
    slopes = [((z - F.lit(0.5) * a_i) * v_i).alias(f"_shin_q{i}") for i, (a_i, v_i) in enumerate(zip(a, v))]
    q = [F.col(f"_shin_q{i}") for i in range(n)]
    names = [f"_shin_v{i}" for i in range(n)]
    for _ in range(SHIN_STEPS):
        df = df.select(*base, "_shin_z", *roots)
        df = df.select(*base, "_shin_z", (add(r) - free * z - F.lit(2.0)).alias("_shin_g"), *inverse)
        df = df.select(*base, "_shin_z", "_shin_g", *names, *slopes)
        df = df.select(*base, "_shin_z", "_shin_g", (add(q) - free).alias("_shin_g1"),
                       add([(F.lit(1.0) - q_i * q_i) * v_i for q_i, v_i in zip(q, v)]).alias("_shin_g2"))
        g, g1, g2 = F.col("_shin_g"), F.col("_shin_g1"), F.col("_shin_g2")
        step = F.lit(2.0) * g * g1 * _inv(F.lit(2.0) * g1 * g1 - g * g2)
        df = df.select(*base, (z - step).alias("_shin_z"))
    df = df.select(*keep, "_shin_s", *[f"_shin_pi{i}" for i in range(n)], "_shin_z", *roots)
    # the common factor 1 / (2 (1 - z)) drops out of the final normalisation
    weight = [F.when(total <= 1.0, pi[i]).otherwise(r[i] - z).alias(f"_shin_w{i}") for i in range(n)]
    df = df.select(*keep, *weight)
    w = [F.col(f"_shin_w{i}") for i in range(n)]
    return df.select(*keep, _inv(add(w)).alias("_shin_n"), *[f"_shin_w{i}" for i in range(n)]).select(
        *keep, *[settled(F.when(known, w_i * F.col("_shin_n"))).alias(o) for w_i, o in zip(w, out)])


def all_known(cols: Sequence[str | Column], above: float | None = None) -> Column:
    """True when every price is present (and above a floor if one is given)."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & col(c).isNotNull()
        if above is not None:
            ok = ok & (col(c) > above)
    return F.coalesce(ok, F.lit(False))


def pick_source(sources: Sequence[Sequence[str | Column]], out: Sequence[str], above: float | None = None,
                source_name: str | None = None, labels: Sequence[str] = ()) -> list[Column]:
    """Per-row cascade over whole groups of prices: the first complete group wins."""
    result = []
    for i, name in enumerate(out):
        chain = None
        for group in sources:
            cond = all_known(group, above)
            chain = F.when(cond, col(group[i])) if chain is None else chain.when(cond, col(group[i]))
        result.append(chain.alias(name))
    if source_name:
        chain = None
        for group, label in zip(sources, labels):
            cond = all_known(group, above)
            chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
        result.append(chain.alias(source_name))
    return result


def first_known(closing: Sequence[str], opening: Sequence[str], out: Sequence[str]) -> list[Column]:
    """Column-wise fallback: each price on its own."""
    return [F.coalesce(F.col(c), F.col(o)).alias(n) for c, o, n in zip(closing, opening, out)]


def market_probabilities(df: DataFrame, odds: Sequence[str], out: Sequence[str], method: str = "shin") -> DataFrame:
    if method == "shin":
        return shin(df, odds, out)
    if method == "proportional":
        return df.select("*", *[p.alias(o) for p, o in zip(proportional(odds), out)])
    raise ValueError(f"unknown margin method {method!r}")


def pick_1x2(p1: str | Column, px: str | Column, p2: str | Column, rule: str = "first") -> Column:
    """Most likely of home / draw / away.

    ``first``: ties go to the earlier class. ``strict``: home only when strictly ahead of both,
    otherwise draw only when strictly ahead of away.
    """
    a, b, c = col(p1), col(px), col(p2)
    if rule == "first":
        return F.when((a >= b) & (a >= c), F.lit("1")).when(b >= c, F.lit("X")).otherwise(F.lit("2"))
    if rule == "strict":
        return F.when((a > b) & (a > c), F.lit("1")).when(b > c, F.lit("X")).otherwise(F.lit("2"))
    raise ValueError(f"unknown tie rule {rule!r}")


def by_class(label: Column, one: Column, x: Column, two: Column) -> Column:
    return F.when(label == "1", one).when(label == "X", x).when(label == "2", two)


def analyse_1x2(df: DataFrame, odds: Sequence[str]) -> DataFrame:
    """Probabilities, pick, confidence, picked odds and margin of each match; invalid prices are flagged."""
    o1, ox, o2 = odds
    valid = all_known(odds, above=1.0)
    df = df.withColumn("valid", valid)
    for o in odds:
        df = df.withColumn(f"_q_{o}", F.when(F.col("valid"), F.col(o)))
    q = [f"_q_{o}" for o in odds]
    df = shin(df, q, ["prob_1", "prob_x", "prob_2"])
    df = df.withColumn("pick", F.when(F.col("valid"), pick_1x2("prob_1", "prob_x", "prob_2")))
    return df.select(
        "*",
        by_class(F.col("pick"), F.col("prob_1"), F.col("prob_x"), F.col("prob_2")).alias("confidence"),
        by_class(F.col("pick"), F.col(o1), F.col(ox), F.col(o2)).alias("pick_odds"),
        margin(q).alias("margin"),
    ).drop(*q)


def analyse_over_under(df: DataFrame, over: str, under: str, model_over: str | None = None,
                       market_weight: float | Column = 1.0) -> DataFrame:
    """Over/Under pick, optionally blended with a model probability; a tie goes to Over."""
    w = F.lit(market_weight) if not isinstance(market_weight, Column) else market_weight
    df = df.withColumn("ou_valid", all_known([over, under], above=1.0))
    df = df.withColumn("_qo", F.when(F.col("ou_valid"), F.col(over)))
    df = df.withColumn("_qu", F.when(F.col("ou_valid"), F.col(under)))
    df = shin(df, ["_qo", "_qu"], ["prob_over_market", "_pu"])
    market = F.col("prob_over_market")
    blended = market if model_over is None else (F.lit(1.0) - w) * F.col(model_over) + w * market
    df = df.withColumn("prob_over", blended).withColumn("prob_under", F.lit(1.0) - F.col("prob_over"))
    is_over = F.col("prob_over") >= F.col("prob_under")
    return df.select(
        "*",
        F.when(is_over, F.lit("Over 2.5")).when(~is_over, F.lit("Under 2.5")).alias("ou_pick"),
        F.greatest("prob_over", "prob_under").alias("ou_confidence"),
        F.when(is_over, F.col("_qo")).when(~is_over, F.col("_qu")).alias("ou_pick_odds"),
        margin(["_qo", "_qu"]).alias("ou_margin"),
    ).drop("_qo", "_qu", "_pu")
