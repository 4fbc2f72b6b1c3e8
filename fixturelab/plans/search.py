"""Grid searches: blend weights, and the full model x market x threshold search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blend import blended_goals
from ..functions.odds import div
from ..functions.scores import bounded_rho, score_sums

# Fixed grids of the search.
FORM_GRID = (0.0, 0.05, 0.10, 0.15, 0.20, 0.30)
MEET_GRID = (0.0, 0.10, 0.20)
ODDS_GRID = (0.60, 0.70, 0.80, 0.90, 0.95, 1.00)
RHO_GRID = (-0.20, -0.10, 0.0)
MARKETS = ("1X2", "Over/Under", "both")
THRESHOLDS = (0.55, 0.60, 0.65, 0.70, 0.75)
BLEND_FORM_GRID = (0.0, 0.05, 0.10, 0.15, 0.20, 0.30)
BLEND_ODDS_GRID = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00)
SLIP_SIZE = 13
MIN_SELECTED = 3 * SLIP_SIZE
BIN_MIN = 50
PARAMETERS = ("odds", "form", "meet", "rho", "market", "threshold")


def config_table(spark, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A small literal table of configurations."""
    kinds = ["string" if isinstance(v, str) else "double" for v in rows[0]]
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))


def model_configs(forms=FORM_GRID, meets=MEET_GRID, odds=ODDS_GRID, rhos=RHO_GRID) -> list[tuple]:
    return [(f, m, o, r) for f in forms for m in meets for o in odds for r in rhos if f + m + o <= 1.0001]


def blend_configs(forms=BLEND_FORM_GRID, odds=BLEND_ODDS_GRID) -> list[tuple]:
    return [(f, o) for f in forms for o in odds if f + o <= 1.0]


def candidates(comps: DataFrame, configs: Sequence[tuple] | None = None) -> DataFrame:
    """Confidence and hit of the 1X2 and of the totals pick, for every match and model configuration.

    The score sums depend on the form and meeting weights alone, so they are computed once per pair
    of those; rho and the market weight are then cheap arithmetic on an array of settings.
    """
    configs = configs or model_configs()
    pairs: dict[tuple, list[tuple]] = {}
    for f, m, o, r in configs:
        pairs.setdefault((f, m), []).append((o, r))
    setting = lambda o, r: F.struct(F.lit(o).alias("odds"), F.lit(r).alias("rho"))
    pair_rows = F.array(*[
        F.struct(F.lit(f).alias("form"), F.lit(m).alias("meet"), F.array(*[setting(o, r) for o, r in settings]).alias("settings"))
        for (f, m), settings in pairs.items()])
    base = comps.where(F.col("has_odds") & F.col("has_ou")).select(
        "xh_hist", "xa_hist", "xh_form", "xa_form", "xh_meet", "xa_meet", "meet_valid", "has_odds",
        "q1", "qx", "q2", "q_over", "actual", "over_actual")
    base = base.select("*", F.explode(pair_rows).alias("_p")).select(
        *base.columns, F.col("_p.form").alias("form"), F.col("_p.meet").alias("meet"), F.col("_p.settings").alias("settings"))
    base = blended_goals(base, "form", "meet", 0.0, rule="odds_aside", names=("_l", "_m", "_w"))
    base = score_sums(base, "_l", "_m", prefix="_g_")
    l, m = F.col("_l"), F.col("_m")
    s = l + m
    base = base.select("form", "meet", "settings", "q1", "qx", "q2", "q_over", "actual", "over_actual", "_l", "_m",
                       (F.col("_g_home") / F.col("_g_total")).alias("_h"), (F.col("_g_draw") / F.col("_g_total")).alias("_d"),
                       (l * m / F.col("_g_total")).alias("_c"),
                       (F.lit(1.0) - (F.lit(1.0) + s + s * s / F.lit(2.0)) / F.col("_g_total")).alias("_o"))
    rows = base.select("*", F.explode("settings").alias("_s")).select(
        "*", F.col("_s.odds").alias("odds"), F.col("_s.rho").alias("rho")).drop("_s", "settings")
    rows = rows.withColumn("_k", F.col("_c") * bounded_rho(l, m, F.col("rho")))
    w = F.col("odds")
    v = F.lit(1.0) - w
    rows = rows.select(
        "form", "meet", "odds", "rho", "actual", "over_actual",
        (v * (F.col("_h") + F.col("_k")) + w * F.col("q1")).alias("p1"),
        (v * (F.col("_d") - F.lit(2.0) * F.col("_k")) + w * F.col("qx")).alias("px"),
        (v * (F.lit(1.0) - F.col("_h") - F.col("_d") + F.col("_k")) + w * F.col("q2")).alias("p2"),
        (v * F.col("_o") + w * F.col("q_over")).alias("po"))
    p1, px, p2, po = (F.col(c) for c in ("p1", "px", "p2", "po"))
    pick = F.when((p1 >= px) & (p1 >= p2), F.lit("1")).when(px >= p2, F.lit("X")).otherwise(F.lit("2"))
    return rows.select("form", "meet", "odds", "rho", F.greatest(p1, px, p2).alias("conf_r"), (pick == F.col("actual")).alias("ok_r"),
                       F.greatest(po, F.lit(1.0) - po).alias("conf_t"), ((po >= 0.5) == F.col("over_actual")).alias("ok_t"))


def search(comps: DataFrame, configs: Sequence[tuple] | None = None, thresholds: Sequence[float] = THRESHOLDS,
           min_selected: int = MIN_SELECTED, bin_min: int = BIN_MIN) -> DataFrame:
    """Selection metrics of every model configuration, market mode and confidence threshold.

    Matches are reduced map-side to sums per configuration, market, threshold band and calibration
    bin; thresholds and bins are then assembled from that small table.
    """
    rows = candidates(comps, configs)
    by_model = ["form", "meet", "odds", "rho"]
    totals_first = F.col("conf_t") > F.col("conf_r")
    choice = lambda name, conf, ok: F.struct(F.lit(name).alias("market"), conf.alias("conf"), ok.alias("ok"))
    picks = F.array(
        choice("1X2", F.col("conf_r"), F.col("ok_r")), choice("Over/Under", F.col("conf_t"), F.col("ok_t")),
        choice("both", F.greatest("conf_r", "conf_t"), F.when(totals_first, F.col("ok_t")).otherwise(F.col("ok_r"))))
    long = rows.select(*by_model, F.explode(picks).alias("_x")).select(*by_model, "_x.*")
    conf, ok = F.col("conf"), F.col("ok").cast("double")
    # number of thresholds the confidence reaches, and its calibration bin
    band = F.lit(0)
    for t in thresholds:
        band = band + F.when(conf >= F.lit(t), 1).otherwise(0)
    width = F.floor((conf - F.lit(0.5)) / F.lit(0.05) + F.lit(1e-9))
    bins = F.when((conf >= 0.5) & (conf < 1.0), width).otherwise(F.lit(-1))
    cells = long.groupBy(*by_model, "market", band.alias("_band"), bins.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(ok).alias("_ok"), F.sum("conf").alias("_conf"),
        F.sum((conf - ok) * (conf - ok)).alias("_sq"))
    total = cells.groupBy(*by_model, "market").agg(F.sum("_n").alias("_all"))
    levels = F.array(*[F.struct(F.lit(i + 1).alias("need"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(sorted(thresholds))])
    reached = cells.select("*", F.explode(levels).alias("_l")).where(F.col("_band") >= F.col("_l.need"))
    reached = reached.withColumn("threshold", F.col("_l.threshold")).drop("_l")
    key = [*by_model, "market", "threshold"]
    per_bin = reached.groupBy(*key, "_bin").agg(*[F.sum(c).alias(c) for c in ("_n", "_ok", "_conf", "_sq")])
    gap = F.abs(F.col("_conf") / F.col("_n") - F.col("_ok") / F.col("_n")) * F.col("_n")
    counted = (F.col("_bin") >= 0) & (F.col("_n") >= bin_min)
    out = per_bin.groupBy(*key).agg(
        F.sum("_n").alias("n_selected"), F.sum("_ok").alias("_ok"), F.sum("_conf").alias("_conf"), F.sum("_sq").alias("_sq"),
        F.sum(F.when(counted, gap)).alias("_gap"), F.sum(F.when(counted, F.col("_n"))).alias("_gap_n"))
    out = out.where(F.col("n_selected") >= min_selected).join(total, [*by_model, "market"])
    hit, declared = F.col("_ok") / F.col("n_selected"), F.col("_conf") / F.col("n_selected")
    return out.select(
        *key, "n_selected", (F.col("n_selected") / F.col("_all")).alias("share_selected"), hit.alias("hit_rate"),
        declared.alias("declared"), div("_gap", "_gap_n").alias("calibration_gap"), (declared - hit).alias("bias"),
        F.pow(hit, F.lit(float(SLIP_SIZE))).alias("p_slip_13"), (F.col("_sq") / F.col("n_selected")).alias("brier"))


def marginal_effects(results: DataFrame) -> DataFrame:
    """Mean hit rate and calibration gap for each value of each parameter."""
    # the six single-parameter groupings of one pass over the result table
    values = F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in PARAMETERS])).alias("_v")
    return results.select("*", values).groupBy(F.col("_v.parameter").alias("parameter"), F.col("_v.value").alias("value")).agg(
        F.count(F.lit(1)).alias("configs"), F.avg("hit_rate").alias("hit_rate"), F.avg("calibration_gap").alias("calibration_gap"))


def best(results: DataFrame, by: str, ascending: bool = False, n: int = 10, min_share: float | None = None) -> DataFrame:
    """Top configurations, optionally among those selecting a minimum share; ties by parameters."""
    if min_share is not None:
        results = results.where(F.col("share_selected") >= min_share)
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    keys = [c for c in ("form", "meet", "odds", "rho", "market", "threshold") if c in results.columns]
    return results.orderBy(order, *keys).limit(n)


def with_configs(comps: DataFrame, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Every match under every configuration of a short literal list."""
    kinds = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, columns)]) for r in rows])
    return comps.select("*", F.explode(kinds).alias("_cfg")).select(*comps.columns, "_cfg.*")
