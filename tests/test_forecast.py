"""Forecasts of fixtures whose teams have no history."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixturelab.checks import queries as Q
from fixturelab.plans import forecast as Y

SF = "/root/testdata/sf0.001"


def test_every_fixture_comes_back(spark):
    m = Q.matches(spark, SF)
    history = m.where(F.col("season") < Q.last_season(spark, SF))
    fixtures = Q.fixtures_of(spark, SF).limit(20)
    new = fixtures.limit(1).withColumn("home", F.lit(-1).cast(dict(fixtures.dtypes)["home"])).withColumns(
        {c: F.lit(2.5) for c in ("o1", "ox", "o2")})
    both = fixtures.unionByName(new)
    rows = Y.forecast(history, both).collect()
    assert len(rows) == both.count()
    assert all((r.p1 is None) == (r.reason == Y.NO_HISTORY) for r in rows)
    assert [r.reason for r in rows if r.home == -1] == [Y.NO_HISTORY]
    picks, _ = Y.build_slips(history, both, ["league"], ["match_seq"])
    found = [r for r in picks.collect() if r.home == -1]
    assert [(r.selected, r.reason) for r in found] == [(False, Y.NO_HISTORY)]
