"""Small fixtures with known results: form, meetings, prices, decay, scores, slips, power."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fixturelab.functions import decay, odds, scores
from fixturelab.operators import features, state
from fixturelab.operators.asof import asof_backward
from fixturelab.plans import compare, forecast, slips

MATCH = "league int, season int, match_seq long, d date, home string, away string, gh int, ga int"
PRICED = MATCH + ", o1 double, ox double, o2 double, c1 double, cx double, c2 double"


def value(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.fixture
def table(spark, tmp_path):
    """Rows read back from a file, as queries read theirs."""

    def make(rows, schema):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    return make


def played(*rows, prices=()):
    day = dt.date(2024, 1, 1)
    return [(0, 2023, k, day + dt.timedelta(days=7 * k), *r, *(prices[k] * 2 if prices else ())) for k, r in enumerate(rows)]


def test_letters_of_mixed_venues(spark):
    rows = played(("A", "B", 2, 0), ("B", "A", 1, 1), ("A", "B", 0, 1), ("B", "A", 2, 0), ("A", "B", 3, 1), ("B", "A", 1, 2),
                  ("A", "B", 1, 1), ("A", "B", 0, 0))
    got = features.recent_form(spark.createDataFrame(rows, MATCH), 5, 3).where("team = 'A' and match_seq = 7").first()
    assert got.letters == "PPVVN" and got.rest_days == 7 and got.last_was_away == 0.0


def test_tallies_and_prices_of_past_meetings(table):
    prices = [(1.30, 5.0, 9.0), (6.0, 4.5, 1.55), (1.35, 5.0, 8.0)]
    history = table(played(("A", "B", 2, 1), ("B", "A", 0, 0), ("A", "B", 1, 3), prices=prices), PRICED)
    fixtures = table([(0, "A", "B"), (0, "B", "A")], "league int, home string, away string")
    got, back = forecast.forecast(history, fixtures).orderBy("home").collect()
    assert (got.met, got.met_won, got.met_drawn, got.met_lost) == (3, 1, 1, 1)
    assert got.met_gf == pytest.approx(1.0) and got.met_ga == pytest.approx(4 / 3)
    # prices of both venues speak for A
    assert got.q1 > 0.65 and got.q1 + got.qx + got.q2 == pytest.approx(1.0)
    assert (back.met_won, back.met_lost) == (1, 1) and back.q2 > 0.5


def test_old_matches_fade(spark):
    rows = [(0, 1999, 0, dt.date(2000, 1, 1), "A", "B", 0, 0), (0, 2023, 1, dt.date(2024, 1, 1), "A", "B", 5, 0)]
    app = state.appearances(spark.createDataFrame(rows, MATCH))
    got = {r.team: r for r in decay.team_strengths(app, F.lit(dt.date(2024, 1, 2)), 1.0).collect()}
    assert got["A"].att_home == pytest.approx(5.0) and got["A"].att_away == 0.0
    weights = value(spark, **{f"w{k}": decay.decay_weight(F.lit(k), 365.0) for k in (0, 365, 730, -5)}, none=decay.decay_weight(F.lit(730), None))
    assert [weights.w0, weights.w365, weights.w730, weights["w-5"], weights.none] == pytest.approx([1, 0.5, 0.25, 1, 1])


def test_rating_at_the_edges_of_its_period(spark):
    day = lambda x: dt.date(2024, 1, x)
    periods = [("A", 1500.0, day(1), day(10)), ("A", 1550.0, day(11), day(20)), ("B", 1400.0, day(1), day(20))]
    ratings = spark.createDataFrame(periods, "team string, elo double, since date, until date")
    wanted = [("A", day(10), 1500.0), ("A", day(11), 1550.0), ("A", day(20), 1550.0), ("A", day(21), None),
              ("A", dt.date(2023, 12, 31), None), ("B", day(5), 1400.0), ("C", day(5), None)]
    left = spark.createDataFrame([x[:2] for x in wanted], "team string, d date")
    got = {(r.team, r.d): r.elo for r in asof_backward(left, ratings, ["team"], "d", "since", ["elo"], "until").collect()}
    assert got == {(t, d): elo for t, d, elo in wanted}


@pytest.mark.parametrize("home, away, rho, want", [(1.5, 1.1, -0.10, -0.10), (4.0, 0.7, -0.30, -0.25)])
def test_rho_is_clamped(spark, home, away, rho, want):
    assert value(spark, x=scores.bounded_rho(F.lit(home), F.lit(away), F.lit(rho))).x == pytest.approx(want)


def test_grids_of_extreme_rates_are_distributions(table):
    rates = table([(3.5, 0.8), (4.0, 0.7), (5.3, 1.4), (0.9, 3.8)], "l double, m double")
    for r in scores.score_grid(rates, "l", "m", -0.30).collect():
        assert min(x.p for x in r.grid) >= -1e-15 and math.fsum(x.p for x in r.grid) == pytest.approx(1.0, abs=1e-9)


def test_shin_against_proportional(table):
    df = table([(2.0, 4.0, 4.0), (1.8, 3.6, 4.5), (1.8, None, 4.5)], "a double, b double, c double")
    df = odds.shin(df, ["a", "b", "c"], ["s1", "s2", "s3"])
    fair, over, gap = df.select("*", *[p.alias(f"p{i}") for i, p in enumerate(odds.proportional(["a", "b", "c"]))]).collect()
    assert [fair.s1, fair.s2, fair.s3] == pytest.approx([fair.p0, fair.p1, fair.p2])
    assert over.s1 + over.s2 + over.s3 == pytest.approx(1.0) and over.s1 > over.s2 > over.s3 and over.s1 > over.p0 + 1e-4
    assert gap.s1 is None and gap.s2 is None and gap.s3 is None


def test_price_cascade(spark):
    rows = [(2.0, 3.0, 4.0, 2.1, 3.1, 4.1), (None, 3.0, 4.0, 2.1, 3.1, 4.1), (None, None, None, 2.1, None, 4.1)]
    df = spark.createDataFrame(rows, "c1 double, cx double, c2 double, o1 double, ox double, o2 double")
    groups = [["c1", "cx", "c2"], ["o1", "ox", "o2"]]
    got = df.select(*odds.pick_source(groups, ["q1", "qx", "q2"], 1.0, "source", ["closing", "opening"])).collect()
    assert [(r.source, r.q1) for r in got] == [("closing", 2.0), ("opening", 2.1), (None, None)]
    # column by column each price falls back alone
    alone = df.select(*odds.first_known(groups[0], groups[1], ["q1", "qx", "q2"])).collect()
    assert [(r.q1, r.qx, r.q2) for r in alone] == [(2.0, 3.0, 4.0), (2.1, 3.0, 4.0), (2.1, None, 4.1)]


@pytest.mark.parametrize("picks, want", [
    ([], [1.0]), ([0.7], [0.3, 0.7]), ([0.6, 0.5], [0.2, 0.5, 0.3]),
    ([0.7] * 13, [math.comb(13, k) * 0.7**k * 0.3 ** (13 - k) for k in range(14)])])
def test_distribution_of_hits(spark, picks, want):
    given = F.array(*[F.lit(p) for p in picks]).cast("array<double>")
    assert value(spark, x=slips.hits_distribution(given)).x == pytest.approx(want)


def test_a_slip_of_two_and_of_mixed_markets(table):
    rows = [(0, 1, 1.50, 4.0, 7.0, None, None, 0.5), (0, 2, 1.80, 3.60, 4.50, None, None, 0.5)]
    schema = "league int, match_seq int, o1 double, ox double, o2 double, oover double, ounder double, p_over double"

    def slip(rows, markets="both"):
        df = odds.shin(table(rows, schema), ["o1", "ox", "o2"], ["p1", "px", "p2"])
        return slips.market_candidates(df, markets=markets)

    picks = slip(rows)
    one = slips.summarise(picks, ["league"]).first()
    confidence = [r.confidence for r in picks.collect()]
    assert one.multiplier == pytest.approx(2.70) and one.p_all == pytest.approx(math.prod(confidence))
    assert one.one_in == pytest.approx(1 / one.p_all) and one.expected_return == pytest.approx(2.70 * one.p_all)
    mixed = slip([*rows, (0, 3, 2.9, 3.0, 2.9, 1.70, 2.15, 0.6)])
    assert {r.match_seq: (r.market, r.pick, r.pick_odds) for r in mixed.collect()} == {
        1: ("1X2", "1", 1.50), 2: ("1X2", "1", 1.80), 3: ("Over/Under 2.5", "Over 2.5", 1.70)}
    assert slips.summarise(mixed, ["league"]).first().n_matches == 3
    assert slip(rows, "Over/Under").count() == 0


def test_unusable_fixtures_have_a_reason(spark):
    rows = [("A", "B", 2.0, 3.0, 4.0), ("A", None, 2.0, 3.0, 4.0), ("A", "A", 2.0, 3.0, 4.0), ("A", "B", None, 3.0, 4.0),
            ("A", "B", 1.0, 3.0, 4.0), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "home string, away string, o1 double, ox double, o2 double, oover double, ounder double")
    assert [r.reason for r in slips.validate(df).collect()] == [
        None, "both teams needed", "same team twice", "odds missing", "odds must exceed one"]


@pytest.mark.parametrize("weight, pick", [(1.0, "Over 2.5"), (0.5, "Under 2.5")])
def test_model_and_market_over(table, weight, pick):
    df = table([(1.90, 1.95, 0.20)], "oo double, uu double, m double")
    got = odds.analyse_over_under(df, "oo", "uu", "m", weight).first()
    assert got.ou_pick == pick and got.prob_over + got.prob_under == pytest.approx(1.0)


def test_brier(spark):
    true = F.lit(True)
    got = value(spark, a=scores.brier(F.lit(1.0), true), b=scores.brier(F.lit(0.0), true), c=scores.brier(F.lit(0.5), true))
    assert (got.a, got.b, got.c) == (0.0, 1.0, 0.25)


def plain_p(a, b):
    n, m, term, total = a + b, min(a, b), 1, 1
    for k in range(m):
        term = term * (n - k) // (k + 1)
        total += term
    return 1.0 if a == b else min(1.0, 2 * total / 2**n)


def test_matches_needed(table):
    rows = [(1, 52, 48, 1000), (2, 58, 42, 1000), (3, 90, 10, 1000), (4, 50, 50, 1000), (5, 0, 0, 1000), (6, 3, 1, 10)]
    df = table(rows, "k int, only_a long, only_b long, n long")
    got = {r.k: r.needed_accuracy for r in compare.needed_for_accuracy(df, ["k"]).collect()}
    assert got[1] > got[2] > 0 and got[3] is None and got[4] is None and got[5] is None
    for k, a, b, n in rows:
        if got[k] is not None:
            # the first number of differing matches with the same share that the exact test rejects
            first = next(x for x in range(a + b + 1, 20_000) if plain_p(round(x * a / (a + b)), x - round(x * a / (a + b))) < 0.05)
            assert got[k] == round(first / ((a + b) / n))


def test_interval_needed(spark):
    need = lambda low, high, diff: value(spark, x=compare.needed_for_score(*[F.lit(v) for v in (low, high, diff, 400)])).x
    assert need(-0.02, 0.01, -0.005) == 400 * 9 and need(-0.02, -0.01, -0.015) is None and need(-0.01, 0.01, 0.0) is None


def test_top_scores_are_those_of_the_sorted_grid_and_come_from_batches(spark):
    rows = [(k, 0.05 + (k * 37 % 400) / 100, 0.05 + (k * 53 % 300) / 100) for k in range(300)]
    rows += [(300, 1.5, 1.5), (301, None, 1.0), (302, 0.05, None)]
    rates = spark.createDataFrame(rows, "k int, l double, m double")
    for rho in (-0.30, 0.0):
        got = scores.top_scores(rates, "l", "m", rho, n=6)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "array_sort" not in plan
        got = {r.k: [tuple(x) for x in r.top_scores] for r in got.collect()}
        for r in scores.score_grid(rates, "l", "m", rho).collect():
            cells = sorted(r.grid, key=lambda x: (0 if x.p is None else -int(x.p * 1e12 + 0.5), x.i, x.j))[:6]
            assert [s for s, _ in got[r.k]] == [f"{x.i}-{x.j}" for x in cells]
            for (_, p), x in zip(got[r.k], cells):
                assert p is None if x.p is None else p == pytest.approx(x.p, abs=1e-12)
    assert scores.top_scores(rates.where("k < 0"), "l", "m", 0.0).count() == 0
