"""Hand-computed fixtures and error paths of the match operators."""

from __future__ import annotations

import math

import pyspark.sql.functions as F
import pytest

from fixturelab.functions import scores
from fixturelab.plans import compare
from fixturelab.session import shared_dir

def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_rank_probability_score(spark):
    a = F.lit("1")
    assert one(spark, x=scores.rps(F.lit(1.0), F.lit(0.0), a)).x == pytest.approx(0.0)
    assert one(spark, x=scores.rps(F.lit(1.0), F.lit(0.0), F.lit("2"))).x == pytest.approx(1.0)


def test_sign_test_is_the_binomial(spark):
    for a, b in ((0, 0), (1, 0), (5, 5), (3, 12), (40, 60), (520, 430)):
        n, m = a + b, min(a, b)
        exact = 1.0 if a == b else min(1.0, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n)
        got = one(spark, p=compare.sign_test_p(F.lit(a).cast("long"), F.lit(b).cast("long"))).p
        assert got == pytest.approx(exact, rel=1e-9), (a, b)


def test_pairs_must_cover_the_same_matches(spark):
    a = spark.createDataFrame([(1, "1", 0.5), (2, "2", 0.5)], "m int, actual string, p double")
    with pytest.raises(Exception, match="cover the same matches"):
        compare.paired(a, a.where("m = 1"), ["m"]).collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
