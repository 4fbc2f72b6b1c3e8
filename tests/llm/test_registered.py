"""Every registered operator query on tables of awkward rows, through queries()."""

from __future__ import annotations

import pytest
from test_operators import awkward_rows

import __spark_entry__ as entry


def tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as n", "'x' as word")
    ids = [i for i, _ in rows if i is not None][:20]
    labels = [(i, k % 2, int(k % 3 == 0)) for k, i in enumerate(ids)] + ([(None, 1, 1), (5, None, None)] if rows else [])
    pages = [(i, None if t is None else "http://a.com/" + t[:200], "") for i, t in rows]
    parts = {
        "documents": docs,
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "benchmark": spark.createDataFrame([(1, "some words of an item that nobody has"), (None, None), (2, "")] if rows else [], "item_id long, text string"),
    }
    for name, df in parts.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def awkward_tables(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("awkward")), [r[:2] for r in awkward_rows()])


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("empty")), [])


NAMES = sorted((n for n in entry.queries() if n.startswith("op") and n[2].isdigit()), key=lambda n: int(n[2:].split("_")[0]))


def test_all_operators_are_registered():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query_on_awkward_and_empty_tables(spark, awkward_tables, empty_tables, name):
    rows = entry.queries()[name](spark, awkward_tables).collect()
    if name not in ("op3_decontaminate", "op10_packing", "op11_spelling_groups"):
        assert len(rows) == len(awkward_rows())
    assert entry.queries()[name](spark, empty_tables).collect() == []
