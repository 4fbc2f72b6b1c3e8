"""Components of the last seasons: the same as those of all seasons, from one state for all configurations."""

from __future__ import annotations

import random
from dataclasses import replace

import pyspark.sql.functions as F
import pytest

from fixturelab.checks import queries as Q
from fixturelab.operators import features, state
from fixturelab.plans import components as P

from test_state import SCHEMA, by_match, same, schedule


def priced(spark, n=120):
    rng = random.Random(3)
    rows = [(*r, *[round(rng.uniform(1.2, 5), 2) for _ in range(8)]) for r in schedule(n)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} double" for c in (*P.OPENING, *P.CLOSING, *P.TOTALS)))


@pytest.mark.parametrize("kw", [{"block_rows": 64}, {"order": "day", "block_days": 60}])
def test_late_seasons_see_all_history(spark, kw):
    m = spark.createDataFrame(schedule(240), SCHEMA)
    season = m.agg(F.max("season")).first()[0] - 1
    got = by_match(state.unbounded_state(m, first_season=season, **kw))
    want = by_match(state.unbounded_state(m, **kw).where(F.col("season") >= season))
    assert got and len(got) < 480
    same(want, got)


def test_configurations_are_made_from_one_state(spark, monkeypatch):
    m = priced(spark).persist()
    monkeypatch.setattr(Q, "matches", lambda spark, sf: m)
    for change in ({"league_means": "plain"}, {"odds_source": "opening", "odds_method": "proportional"}):
        cfg = replace(Q.FULL, **change)
        whole = P.components(m, cfg).where(F.col("season").isin(Q.recent_seasons(spark, "")))
        same(by_match(whole), by_match(Q.recent_comps(spark, "recent", cfg)))


def test_queries_that_compare_configurations_build_the_state_once(spark, monkeypatch):
    m = priced(spark).persist()
    monkeypatch.setattr(Q, "matches", lambda spark, sf: m)
    built = []
    real = P.unbounded_state
    monkeypatch.setattr(P, "unbounded_state", lambda *a, **k: built.append(k) or real(*a, **k))
    assert Q.closing_vs_opening(spark, "one-state").count() == 2
    Q.configuration_differences(spark, "one-state")
    assert len(built) == 1


@pytest.mark.parametrize("build", [lambda m: features.recent_form(m, block_rows=64), lambda m: features.recent_mean(m, {"shots": ("hst", "ast")}, block_rows=64)])
def test_what_blocks_leave_comes_from_the_shuffle_of_the_rows(spark, tmp_path, build):
    m = spark.createDataFrame(schedule(240), SCHEMA)
    m.select("*", F.col("gh").alias("hst"), F.col("ga").alias("ast")).write.parquet(str(tmp_path / "m"))
    found = build(spark.read.parquet(str(tmp_path / "m")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # of the appearances with all their columns one shuffle, and one of the distinct cells where lists begin empty
    assert "ReusedExchange" in plan
