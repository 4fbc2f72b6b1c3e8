"""Score model: low-score-corrected Poisson outcomes and proper scoring rules as expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .odds import col, settled

MAX_GOALS = 10


def bounded_rho(lam: Column, mu: Column, rho: Column) -> Column:
    """rho moved into the range where no corrected cell turns negative."""
    positive = (lam > 0) & (mu > 0)
    low = F.when(positive, F.greatest(F.lit(-1.0) / lam, F.lit(-1.0) / mu)).otherwise(F.lit(-1.0))
    high = F.when(positive, F.least(F.lit(1.0) / (lam * mu), F.lit(1.0))).otherwise(F.lit(1.0))
    return F.least(F.greatest(rho, low), high)


def low_score_factor(i: int, j: int, lam: Column, mu: Column, rho: Column) -> Column:
    """Correction factor of the four low scores; every other score keeps factor one."""
    table = {
        (0, 0): F.lit(1.0) - lam * mu * rho,
        (0, 1): F.lit(1.0) + lam * rho,
        (1, 0): F.lit(1.0) + mu * rho,
        (1, 1): F.lit(1.0) - rho,
    }
    return table.get((i, j), F.lit(1.0))


def _tail(x: Column, terms: list[Column]) -> Column:
    """terms[0] + x/1 (terms[1] + x/2 (terms[2] + ...))."""
    acc = terms[-1]
    for k in range(len(terms) - 1, 0, -1):
        acc = terms[k - 1] + (x / F.lit(float(k))) * acc
    return acc


def score_sums(df: DataFrame, lam: str, mu: str, max_goals: int = MAX_GOALS, prefix: str = "_") -> DataFrame:
    """Unnormalised sums of the score grid that do not depend on rho.

    The factor exp(-lam-mu) cancels when the truncated grid is renormalised, so the grid is built
    from ``lam^i/i! * mu^j/j!``. Adds ``home`` (cells i>j), ``draw`` (i=j) and ``total``, each a
    nested polynomial: three sums per row instead of 121 cells.
    """
    keep = df.columns
    m, l = F.col(mu), F.col(lam)
    powers: list[Column] = []
    term = F.lit(1.0)
    for k in range(1, max_goals + 1):
        term = term * m / F.lit(float(k))
        powers.append(term.alias(f"{prefix}u{k}"))
    df = df.select(*keep, *powers)
    u = [F.lit(1.0)] + [F.col(f"{prefix}u{k}") for k in range(1, max_goals + 1)]
    partial, partials = u[0], [u[0]]
    for k in range(1, max_goals + 1):
        partial = partial + u[k]
        partials.append(partial)
    ones = [F.lit(1.0)] * (max_goals + 1)
    home_terms = [F.lit(0.0)] + partials[:-1]
    return df.select(
        *keep,
        _tail(l, home_terms).alias(f"{prefix}home"),
        _tail(l, u).alias(f"{prefix}draw"),
        (_tail(l, ones) * partials[-1]).alias(f"{prefix}total"),
    )


def outcome_columns(lam: Column, mu: Column, rho: Column, prefix: str = "_", max_goals: int = MAX_GOALS) -> dict[str, Column]:
    """Outcome probabilities from the sums of :func:`score_sums`.

    With ``c = lam*mu*rho`` the corrections are -c at 0-0 and 1-1 and +c at 0-1 and 1-0: they cancel
    in the grid total and in the under-2.5 sum, so only 1X2 and over 1.5 feel rho.
    """
    if max_goals < 2:
        raise ValueError("the grid must hold at least two goals")
    home, draw, total = (F.col(f"{prefix}{n}") for n in ("home", "draw", "total"))
    c = lam * mu * bounded_rho(lam, mu, rho)
    s = lam + mu
    over25 = F.lit(1.0) - (F.lit(1.0) + s + s * s / F.lit(2.0)) / total
    return {
        "p1": (home + c) / total,
        "px": (draw - F.lit(2.0) * c) / total,
        "p2": (total - home - draw + c) / total,
        "over15": F.lit(1.0) - (F.lit(1.0) + s + c) / total,
        "over25": over25,
        "under25": F.lit(1.0) - over25,
    }


def score_outcomes(df: DataFrame, lam: str, mu: str, rho: float | str | Column, names: dict[str, str] | None = None,
                   max_goals: int = MAX_GOALS) -> DataFrame:
    """Add 1/X/2 and over/under probabilities for two expected-goal columns.

    ``names`` maps output keys (p1, px, p2, over15, over25, under25) to column names; keys left out
    are not computed.
    """
    names = names or {k: k for k in ("p1", "px", "p2", "over15", "over25", "under25")}
    keep = df.columns
    r = F.lit(rho) if isinstance(rho, (int, float)) else col(rho)
    df = score_sums(df, lam, mu, max_goals, prefix="_g_")
    cols = outcome_columns(F.col(lam), F.col(mu), r, "_g_", max_goals)
    return df.select(*keep, *[settled(cols[k]).alias(v) for k, v in names.items()])


def score_grid(df: DataFrame, lam: str, mu: str, rho: float | str | Column, out: str = "grid",
               max_goals: int = MAX_GOALS) -> DataFrame:
    """The whole normalised grid as ``array<struct<i, j, p>>`` (row-major)."""
    keep = df.columns
    r = F.lit(rho) if isinstance(rho, (int, float)) else col(rho)
    l, m = F.col(lam), F.col(mu)
    steps = F.array(*[F.lit(float(k)) for k in range(1, max_goals + 1)])

    def terms(x: Column) -> Column:
        """x^k / k! for k = 0..max_goals."""
        return F.aggregate(steps, F.array(F.lit(1.0)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * x / k)))

    df = score_sums(df, lam, mu, max_goals, prefix="_g_")
    df = df.select("*", bounded_rho(l, m, r).alias("_rho"), terms(l).alias("_tl"), terms(m).alias("_tm"))
    rb = F.col("_rho")

    def cell(i: Column, j: Column, p: Column) -> Column:
        low = F.when((i == 0) & (j == 0), low_score_factor(0, 0, l, m, rb)).when((i == 0) & (j == 1), low_score_factor(0, 1, l, m, rb))
        low = low.when((i == 1) & (j == 0), low_score_factor(1, 0, l, m, rb)).when((i == 1) & (j == 1), low_score_factor(1, 1, l, m, rb))
        return F.struct(i.alias("i"), j.alias("j"), (p * low.otherwise(F.lit(1.0)) / F.col("_g_total")).alias("p"))

    grid = F.flatten(F.transform("_tl", lambda a, i: F.transform("_tm", lambda b, j: cell(i, j, a * b))))
    return df.select(*keep, settled(grid).alias(out))


def _best_scores(lam: pa.Array, mu: pa.Array, rho: pa.Array, total: pa.Array, n: int, max_goals: int) -> pa.Array:
    """The ``n`` likeliest cells of the grids of some rows, all grids at once."""
    l, m, r, g = (x.to_numpy(zero_copy_only=False).astype(float) for x in (lam, mu, rho, total))
    size = max_goals + 1
    with np.errstate(all="ignore"):
        terms = lambda x: np.cumprod(np.column_stack([np.ones(len(x)), *[x / k for k in range(1, size)]]), axis=1)
        grid = terms(l)[:, :, None] * terms(m)[:, None, :]
        grid[:, 0, 0] *= 1.0 - l * m * r
        grid[:, 0, 1] *= 1.0 + l * r
        grid[:, 1, 0] *= 1.0 + m * r
        grid[:, 1, 1] *= 1.0 - r
        grid = grid.reshape(len(l), size * size) / g[:, None]
    # equal chances keep the order of the cells
    place = np.argsort(-np.floor(np.nan_to_num(grid) * 1e12 + 0.5), axis=1, kind="stable")[:, :n]
    p = pa.array(np.take_along_axis(grid, place, axis=1).ravel(), mask=np.repeat(total.is_null().to_numpy(zero_copy_only=False), place.shape[1]))
    names = pa.array([f"{i}-{j}" for i in range(size) for j in range(size)]).take(pa.array(place.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(l) + 1) * place.shape[1], pa.int32()), pa.StructArray.from_arrays([names, p], ["score", "p"]))


def top_scores(df: DataFrame, lam: str, mu: str, rho: float | str | Column, n: int = 5, out: str = "top_scores",
               max_goals: int = MAX_GOALS) -> DataFrame:
    """The ``n`` likeliest exact scores as ``array<struct<score, p>>``; ties to twelve digits in (i, j) order.

    Without rates all chances are null and the first scores come back.
    """
    ship_package(df.sparkSession)
    keep = df.columns
    r = F.lit(rho) if isinstance(rho, (int, float)) else col(rho)
    bounds = bounded_rho(F.col(lam), F.col(mu), r)

    @F.arrow_udf("array<struct<score:string,p:double>>")
    def best(l: pa.Array, m: pa.Array, r: pa.Array, g: pa.Array) -> pa.Array:
        return _best_scores(l, m, r, g, n, max_goals)

    df = score_sums(df, lam, mu, max_goals, prefix="_g_")
    return df.select(*keep, best(F.col(lam).cast("double"), F.col(mu).cast("double"), bounds.cast("double"), F.col("_g_total").cast("double")).alias(out))


def outcome(gh: str | Column, ga: str | Column) -> Column:
    a, b = col(gh), col(ga)
    return F.when(a > b, F.lit("1")).when(a == b, F.lit("X")).when(a < b, F.lit("2"))


def rps(p1: str | Column, px: str | Column, actual: str | Column) -> Column:
    """Ranked probability score over the ordered classes 1, X, 2."""
    a, b, y = col(p1), col(px), col(actual)
    y1 = F.when(y == "1", F.lit(1.0)).otherwise(F.lit(0.0))
    y2 = F.when(y == "2", F.lit(0.0)).otherwise(F.lit(1.0))
    d1, d2 = a - y1, a + b - y2
    return (d1 * d1 + d2 * d2) / F.lit(2.0)


def brier(p: str | Column, hit: str | Column) -> Column:
    d = col(p) - F.when(col(hit), F.lit(1.0)).otherwise(F.lit(0.0))
    return d * d


# Clip of sklearn-style log loss: the spacing of doubles at one.
LOG_EPS = 2.220446049250313e-16


def log_loss(p_actual: str | Column) -> Column:
    p = F.least(F.greatest(col(p_actual), F.lit(LOG_EPS)), F.lit(1.0 - LOG_EPS))
    return -F.log(p)
