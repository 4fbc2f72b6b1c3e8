"""Walk-forward state: no look into the future, the same result for every block size, lean plans."""

from __future__ import annotations

import datetime as dt
import random
import re

import pyspark.sql.functions as F
import pytest

from fixturelab.operators import blocks, state

SCHEMA = "league int, season int, match_seq long, d date, home int, away int, gh int, ga int"


def schedule(n: int = 240, leagues: int = 2, teams: int = 6, seed: int = 1):
    """Rows of SCHEMA: several matches a day, gaps between days."""
    rng, rows = random.Random(seed), []
    for league in range(leagues):
        day = dt.date(1999, 8, 1)
        for k in range(n):
            if k % 3 == 0:
                day += dt.timedelta(days=rng.choice([1, 2, 7, 40]))
            home, away = rng.sample(range(teams), 2)
            rows.append((league, day.year - (day.month < 7), k, day, home, away, rng.randrange(5), rng.randrange(4)))
    return rows


def by_match(df):
    return {(r.league, r.match_seq): r.asDict() for r in df.collect()}


def same(a: dict, b: dict) -> None:
    assert a.keys() == b.keys()
    for key, row in a.items():
        for name, value in row.items():
            other = b[key][name]
            if isinstance(value, float) and other is not None:
                assert value == pytest.approx(other, rel=1e-9, abs=1e-12), (key, name)
            else:
                assert value == other, (key, name)


def brute_force(rows, order: str, half_life: float = 730.0, n_form: int = 3, n_meet: int = 10) -> dict:
    """Every field by its definition, from a list of the earlier matches."""
    out = {}
    for league, season, seq, d, home, away, gh, ga in rows:
        past = [r for r in rows if r[0] == league and (r[2] < seq if order == "row" else r[3] < d)]
        mean = lambda rs, value: sum(map(value, rs)) / len(rs) if rs else None

        def heavy(rs, k):
            weight = lambda r: 0.5 ** ((rs[-1][3] - r[3]).days / half_life)
            return sum(weight(r) * r[k] for r in rs) / sum(map(weight, rs)) if rs else None

        x = {"mean_home": heavy(past, 6), "mean_away": heavy(past, 7), "n_league": seq,
             "run_home": mean(past, lambda r: r[6]), "run_away": mean(past, lambda r: r[7])}
        met = [r for r in past if {r[4], r[5]} == {home, away}][-n_meet:]
        x["met"] = len(met)
        x["met_gf"] = mean(met, lambda r: r[6] if r[4] == home else r[7])
        x["met_ga"] = mean(met, lambda r: r[7] if r[4] == home else r[6])
        for prefix, team, venue in (("h", home, 4), ("a", away, 5)):
            at = {4: [r for r in past if r[4] == team], 5: [r for r in past if r[5] == team]}
            goals = {4: (6, 7), 5: (7, 6)}
            x[f"{prefix}_n_prior"] = len(at[4]) + len(at[5])
            x[f"{prefix}_gf_venue"] = heavy(at[venue], goals[venue][0]) or 0.0
            x[f"{prefix}_ga_venue"] = heavy(at[venue], goals[venue][1]) or 0.0
            last = [(r, v) for v in (4, 5) for r in at[v][-n_form:]]
            x[f"{prefix}_form_n"] = len(last)
            x[f"{prefix}_form_gf"] = mean(last, lambda rv: rv[0][goals[rv[1]][0]]) or 0.0
            x[f"{prefix}_form_ga"] = mean(last, lambda rv: rv[0][goals[rv[1]][1]]) or 0.0
            own = at[venue][-n_form:]
            x[f"{prefix}_form_venue_n"] = len(own)
            x[f"{prefix}_form_venue_gf"] = mean(own, lambda r: r[goals[venue][0]]) or 0.0
        out[league, seq] = x
    return out


@pytest.mark.parametrize("order,blocks", [("row", {"block_rows": 16}), ("row", {}), ("day", {"block_days": 30})])
def test_all_history_equals_its_definition(spark, order, blocks):
    rows = schedule(150)
    got = by_match(state.unbounded_state(spark.createDataFrame(rows, SCHEMA), order=order, **blocks))
    want = brute_force(rows, order)
    same(want, {k: {c: v[c] for c in want[k]} for k, v in got.items()})


def test_blocks_do_not_change_a_bounded_state(spark):
    m = spark.createDataFrame(schedule(), SCHEMA)
    same(by_match(state.bounded_state(m, lookback=40)), by_match(state.bounded_state(m, lookback=40, block_rows=50)))


@pytest.mark.parametrize("build", [
    lambda m: state.bounded_state(m, lookback=40, block_rows=50),
    lambda m: state.unbounded_state(m, block_rows=32),
    lambda m: state.unbounded_state(m, order="day", block_days=60),
])
def test_the_future_has_no_effect(spark, build):
    rows, cut = schedule(180, leagues=1), 120
    # a day is cut as a whole, so that both orders have the same past
    cut = next(r[2] for r in rows if r[2] >= cut and r[3] > rows[r[2] - 1][3])
    changed = [r if r[2] < cut else (*r[:6], r[6] + 7, r[7] + 5) for r in rows]
    a, b = (by_match(build(spark.createDataFrame(x, SCHEMA)).where(F.col("match_seq") <= cut).drop("gh", "ga")) for x in (rows, changed))
    same(a, b)


def test_no_matches(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert state.unbounded_state(empty).count() == 0
    assert state.bounded_state(empty).count() == 0


@pytest.mark.parametrize("order", ["row", "day"])
def test_a_half_life_of_a_day_leaves_the_latest_match(spark, order):
    day = [dt.date(2000, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2060, 1, 1)]
    rows = [(0, d.year, k, d, 1, 2, 5 * (k == 1), 0) for k, d in enumerate(day)]
    got = by_match(state.unbounded_state(spark.createDataFrame(rows, SCHEMA), half_life=1.0, order=order))
    assert got[0, 1]["h_gf_venue"] == 0.0
    assert got[0, 2]["h_gf_venue"] == pytest.approx(5.0, abs=0.01) == got[0, 2]["mean_home"]
    # 36 years later the weights of both last matches are tiny, their ratio is not
    assert got[0, 3]["h_gf_venue"] == pytest.approx(5.0 / 3.0) == got[0, 3]["mean_home"]


@pytest.mark.parametrize("order,blocks", [("row", {"block_rows": 16}), ("row", {}), ("day", {"block_days": 30})])
@pytest.mark.parametrize("half_life", [0.5, 2.0])
def test_short_half_lives_equal_their_definition(spark, order, blocks, half_life):
    rows = schedule(150)
    got = by_match(state.unbounded_state(spark.createDataFrame(rows, SCHEMA), half_life, order=order, **blocks))
    want = brute_force(rows, order, half_life)
    same(want, {k: {c: v[c] for c in want[k]} for k, v in got.items()})


def test_all_history_plan_is_lean(spark, tmp_path):
    path = str(tmp_path / "matches")
    spark.createDataFrame(schedule(30), SCHEMA).write.parquet(path)
    plan = state.unbounded_state(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert len(re.findall(r"FileScan parquet", plan)) <= 4
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 9
    assert "Join" not in plan


def test_a_task_takes_a_bounded_number_of_matches(spark, monkeypatch):
    m = spark.createDataFrame(schedule(), SCHEMA)
    monkeypatch.setattr(blocks, "TASK_ROWS", 100)
    # 480 matches, each block of 50 with 40 more of the block before
    assert state.bounded_state(m, lookback=40, block_rows=50).rdd.getNumPartitions() == 9
    assert state.unbounded_state(m, block_rows=32).rdd.getNumPartitions() == 5
    assert blocks.tasks_for(0) == 1 and blocks.tasks_for(1000, 500) == 2


def test_blocks_grow_with_the_teams(spark):
    rows = [(lg, 2000, k, dt.date(2000, 8, 1), k, k + 1, 1, 0) for lg, n in ((0, 200), (1, 20)) for k in range(n)]
    m = spark.createDataFrame(rows, SCHEMA)
    assert 64 * 180 < blocks.team_blocks(m, 64) < 64 * 220
    assert blocks.team_blocks(m, 4) == 4096 and blocks.team_blocks(m.limit(0), 64) == 4096


def test_pairs_that_never_met_leave_nothing(spark):
    day = dt.date(2000, 8, 1)
    rows = [(0, 2000, k, day, 2 * k, 2 * k + 1, 1, 0) for k in range(40)] + [(0, 2000, 40, day, 1, 0, 2, 2)]
    base = spark.createDataFrame(rows, SCHEMA).select("*", *state.pair_columns(), blocks.block_of("match_seq", 8).alias("_b"))
    assert [(r._lo, r._hi, r._b, len(r._cmet)) for r in state._pair_carry(base, 10).collect()] == [(0, 1, 5, 1)]
