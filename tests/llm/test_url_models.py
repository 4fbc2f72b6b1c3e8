"""URL models: against plain Markov models, and with very long URLs."""

from __future__ import annotations

import collections
import math
import random
import tracemalloc

import numpy as np
import pytest

from fixturelab.llm import urls

SETTINGS = urls.Settings(buckets=1 << 20, chunk=64)


def some_urls(seed, count):
    draw = random.Random(seed)
    return [f"http://{draw.choice(['a', 'bé', 'shop'])}.com/{''.join(draw.choice('abc/é?=1') for _ in range(draw.randrange(30)))}" for _ in range(count)]


def plain_model(texts, order):
    """Counts of each context of each length, and of what follows."""
    seen = collections.defaultdict(collections.Counter)
    for text in texts:
        raw = [256] * order + list(text.encode() + b"\x00")
        for at in range(order, len(raw)):
            for k in range(order + 1):
                seen[k, tuple(raw[at - k : at])][raw[at]] += 1
    return seen


def plain_log_likelihood(model, text, order, discount):
    raw = [256] * order + list(text.encode() + b"\x00")
    total = 0.0
    for at in range(order, len(raw)):
        share = 1 / 257
        for k in range(order + 1):
            own = model.get((k, tuple(raw[at - k : at])))
            if own:
                n = sum(own.values())
                first, freed = max(own[raw[at]] - discount, 0.0), discount * len(own)
                share = (first + max(freed, 1e-3) * share) / max(n, 1, first + freed)
        total += math.log(max(share, 1e-12))
    return total / (len(raw) - order)


def test_scores_equal_a_plain_markov_model(spark):
    accepted, blocked = some_urls(1, 20), some_urls(2, 20)
    rows = [(x, True) for x in accepted] + [(x, False) for x in blocked]
    models = urls.train(spark.createDataFrame(rows, "url string, accepted boolean"), SETTINGS)
    tried = some_urls(3, 40) + accepted[:5] + ["", "é"]
    scored = urls.score_urls(spark.createDataFrame([(x,) for x in tried], "url string"), models, SETTINGS).collect()
    yes, no = plain_model(accepted, SETTINGS.order), plain_model(blocked, SETTINGS.order)
    off = []
    for row in scored:
        wanted = [plain_log_likelihood(m, row["url"], SETTINGS.order, SETTINGS.discount) for m in (yes, no)]
        off.append(abs(row["log_ratio"] - (wanted[0] - wanted[1])))
    # a hashed context may meet another one, which the plain model does not know
    assert sum(x < 1e-4 for x in off) >= 0.9 * len(off) and max(off) < 0.2


@pytest.mark.parametrize("size", [1, 3, 64, 1 << 20])
def test_chunks_change_nothing(size):
    texts = some_urls(4, 30) + ["", "x" * 5_000, "é" * 300]
    whole = urls.Settings(chunk=1 << 30)
    owner, before, joint = urls.contexts(texts, whole)
    cut = urls.Settings(chunk=size)
    parts = list(urls.chunks(texts, cut))
    assert all(sum(x.sizes) - sum(x.leads) <= size for x in parts)
    found = [urls.chunk_contexts(x, cut) for x in parts]
    assert np.array_equal(np.concatenate([x[0] for x in found]), owner)
    assert np.array_equal(np.concatenate([x[1] for x in found], axis=1), before)
    assert np.array_equal(np.concatenate([x[2] for x in found], axis=1), joint)
    assert list(urls.chunks([], cut)) == []


def test_memory_does_not_grow_with_a_url():
    settings = urls.Settings()
    text = "http://a.com/" + "abcdefgh" * 6_250_000  # 50 MB
    tracemalloc.start()
    total = 0
    for number, chunk in enumerate(urls.chunks([text], settings)):
        if number % 50 == 0:  # memory is that of one chunk, whichever
            total += len(urls.chunk_contexts(chunk, settings)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total and peak < len(text) * 2 + 100_000_000


def test_long_urls_are_judged_whole(spark):
    long = "http://shop.com/" + "a/" * 1_500_000
    rows = [(i, x) for i, x in enumerate(some_urls(5, 200))] + [(900, long), (901, long + "x" * 5), (None, None), (902, "")]
    rules = [("allow", "shop.com", "/"), ("block", "a.com", "/")]
    out = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert len(out) == len(rows)
    assert all(math.isfinite(r["log_ratio"]) for r in out)
    assert {r["verdict"] for r in out if r["page_id"] in (900, 901)} == {"allow"}
