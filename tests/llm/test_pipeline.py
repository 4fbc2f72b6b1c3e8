"""The pipeline's stages against plain versions of their rules, and awkward documents."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
import tiktoken
from test_operators import awkward_rows, plain_distance, plain_join, words

import corpus_pipeline
from fixturelab.llm import bpe, decontaminate, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("sf"))
    bench = [(k, words(rng, 30)) for k in range(8)]
    rows, labels = [], []
    passage = words(rng, 60)
    for i in range(300):
        own = words(rng, rng.randrange(40, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["vile", "nasty"]))
        if i % 6 == 1 and i % 5 == 0:
            own[10:10] = bench[i % 8][1].split()
        text = " ".join(own)
        if i % 4 == 3:
            text += "\n" + passage
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    rows += [(400 + k, rows[2][1]) for k in range(3)] + [(410, rows[8][1] + " more")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, bench


def test_stages(spark, tables):
    folder, rows, labels, bench = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_copies", "decontamination", "encoding"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != "encoding":
            assert result.columns == docs.columns and result.dtypes == docs.dtypes
        docs = spark.createDataFrame(result.collect(), result.schema)
        out[name] = docs.collect()
    toxic = {i for i, _, t in labels if t}
    left = {r.doc_id for r in out["toxicity"]}
    assert len(left & toxic) <= 0.05 * len(toxic)
    clean = {i for i, _ in rows} - toxic
    assert len(left & clean) >= 0.98 * len(clean)

    lines = {r.doc_id: r for r in out["line_dedup"]}
    assert set(lines) == left
    seen = set()
    for i, text in sorted((i, t) for i, t in rows if i in left):
        kept = [x for x in text.split("\n") if x not in seen]
        seen |= set(text.split("\n"))
        assert lines[i].text == "\n".join(kept) and lines[i].n_chars == len(lines[i].text)

    judged = plain_join([(i, r.text) for i, r in lines.items()])
    near = {r.doc_id: r for r in out["near_copies"]}
    assert set(near) == {i for i, x in judged.items() if x[0] == i}

    wanted = set(near)
    for i, row in near.items():
        text = decontaminate.item_words(row.text)
        for _, item in bench:
            own = decontaminate.item_words(item)
            if text and min(plain_distance(own, text)) <= 0.2 * len(own):
                wanted.discard(i)
    assert {r.doc_id for r in out["decontamination"]} == wanted != set(near)

    data = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    for r in out["encoding"]:
        ids = library.encode_ordinary(near[r.doc_id].text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(near[r.doc_id].text.encode()).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == wanted


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_documents(spark, tables, empty):
    folder = tables[0]
    docs = spark.createDataFrame([] if empty else awkward_rows(), SCHEMA)
    for name in ("n_lines", "N_Dropped", "score", "_score", "_gone", "cls", "id"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != "encoding":
            assert result.columns == docs.columns
        docs = spark.createDataFrame(result.collect(), result.schema)
    assert (docs.count() == 0) == empty


def test_copies_without_an_id_fall_to_one_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(None, text)] * 5 + [(4, other), (None, other), (None, other + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    out = ngram_join.keep_first_of_group(docs, keep_null_ids=False)
    assert out.columns == docs.columns
    left = sorted((r["doc_id"] is None, r["text"] or "") for r in out.collect())
    assert left == sorted([(True, text), (False, other), (True, ""), (True, "")])
    assert ngram_join.keep_first_of_group(docs).where("doc_id is null").count() == 9
