"""Quality rules: one plan at every size, and the pieces it is made of."""

from __future__ import annotations

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from fixturelab.llm import quality

SETTINGS = quality.Settings(buckets=1 << 12, id_bits=1 << 15)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=80))) for i in range(400)] + [(7, "hot copy " * 40)] * 300
    rows += [(None, " ".join(draw.choices(words, k=60)))] * 50 + [(None, None), (9999, ""), (9999, None)]
    labels = [(i, i % 3 != 0) for i in range(0, 500, 2)] + [(7, True), (7, True), (None, True), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(i, None if q is None else int(q), 0) for i, q in labels], "doc_id long, quality int, fit int")


def rows_of(df):
    return sorted(map(repr, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())))


def test_same_rows_with_and_without_broadcast(spark, tables):
    first = rows_of(quality.judge_quality(*tables, SETTINGS))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(quality.judge_quality(*tables, SETTINGS)) == first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_labels_meet_by_one_shuffle_at_every_size(tables):
    docs, labels = tables
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    plan = quality.with_labels(rows, quality.trusted_ids(labels, SETTINGS), SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_counts_equal_a_plain_join(spark, tables):
    docs, labels = tables
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    ids = quality.trusted_ids(labels, SETTINGS)
    for settings in (SETTINGS, quality.Settings(buckets=1 << 12, id_bits=1 << 26), quality.Settings(buckets=1 << 12, id_bits=1 << 15, salts=1)):
        out = quality.probably_trusted(rows, ids, settings)
        known = {r.id: r.fit for r in ids.collect()}
        met = out.where("_maybe").select("doc_id").distinct().collect()
        assert set(known) & {r.doc_id for r in docs.collect()} <= {r.doc_id for r in met}
        if settings.id_bits > 1 << 20:
            assert len(met) <= len(known)
        joined = quality.with_labels(out.where("_maybe").drop("_maybe"), ids, settings)
        assert joined.count() == out.where("_maybe").count()
        counts = joined.groupBy("fit").count().collect()
        wanted = {True: 0, False: 0}
        for r in rows.collect():
            if r.doc_id in known:
                wanted[known[r.doc_id]] += 1
        assert {r["fit"]: r["count"] for r in counts if r["fit"] is not None} == {k: v for k, v in wanted.items() if v}


@pytest.mark.parametrize("share", [0.0, 0.005, 0.3, 1.0])
def test_low_value_is_exact(spark, share):
    draw = np.random.default_rng(4)
    for values in ([2.5], [1.0] * 500, draw.normal(size=700).tolist(), [*draw.normal(size=300), *[0.25] * 400, 1e300, -1e300], []):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        wanted = sorted(values)[int(share * (len(values) - 1))] if values else None
        assert quality.low_value(df, "v", share, bins=16) == wanted
