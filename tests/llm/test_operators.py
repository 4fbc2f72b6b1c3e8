"""The text operators against brute force, libraries and awkward inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from fixturelab.llm import (
    bpe,
    decontaminate,
    line_dedup,
    ngram_join,
    packing,
    quality,
    sharding,
    token_counts,
    toxicity,
    urls,
)
from fixturelab.llm.queries import URL_RULES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like columns that operators add.
CLASHES = ["n_lines", "score", "shard", "ids", "kept", "_id", "_row", "_gone", "_text", "cls", "id"]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows():
    """Nulls, empty and very long texts, ties, repeated rows and odd white space."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    copy = words(rng, 60)
    rows = [
        (1, None), (2, ""), (3, "   "), (4, "\n\n"), (5, long), (6, copy), (7, copy), (8, copy + " tail"),
        (None, copy), (None, None), (9, "one"), (9, "one"), (10, "a\tb\r\nc \n d"), (11, "é" * 3000),
        (12, "<|endoftext|> x <|endoftext|>"), (13, "SHARED line of text\nown line number one"),
        (14, "shared LINE of text  \nown line number two"), (15, "x" * 5000),
    ]
    return [(i, t, "en", "src0", len(t) if t else 0) for i, t in rows]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2) for i in range(1, 16)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- sharding ---------------------------------------------------------------------------------


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_slots_of_many_equal_rows(spark, monkeypatch):
    """A run of equal rows is numbered in chunks; chunk bounds leave no gap."""
    monkeypatch.setattr(sharding, "RUN", 7)
    for copies in (1, 6, 7, 8, 14, 50):
        df = spark.range(copies + 3).select(F.lit(0).alias("shard"), F.when(F.col("id") < copies, -1).otherwise(F.col("id")).alias("x"))
        rows = sharding.number_slots(df, "shard", ["x"], blocks=2).collect()
        assert sorted(r.slot for r in rows) == list(range(copies + 3))
        own = sorted(r.slot for r in rows if r.x == -1)
        assert own == list(range(own[0], own[0] + copies))


def test_sharding(spark, awkward, nothing):
    rows = sharding.shard_documents(awkward).collect()
    source = awkward_rows()
    assert len(rows) == len(source)
    key = {i: xxhash.xxh64_intdigest(("\0" if i is None else str(i)).encode(), seed=42) for i, *_ in source}
    wanted = Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_jump(key[i], 16), plain_jump(key[i], 17))
        for i, t, *_ in source
    )
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == wanted
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_slots_do_not_depend_on_blocks(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("shard"), (F.col("id") / 2).cast("long").alias("x"))
    for blocks in (1, 7):
        rows = sharding.number_slots(df, "shard", ["x"], blocks=blocks).collect()
        for s in range(3):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(1000))


# --- tokens -----------------------------------------------------------------------------------


def fuzz_texts(n=1500):
    rng = random.Random(2)
    odd = [chr(x) for x in (*range(33), 0x7F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x661, 0xB2, 0x301, 0x4E2D, 0x1F600)]
    letters = odd + list("aabstred19 .,'  \n") + ["'s", " the", "<|endoftext|>"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, "a" * 5000, "ab" * 3000, " " * 4000, "é" * 3000, "x" + " " * 99 + "y", "the " * 500]


def test_counts_equal_the_library():
    own = token_counts.counter(open(JSON, encoding="utf-8").read(), PATTERN)
    library = Tokenizer.from_file(JSON)
    for text in fuzz_texts():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_whole_tokens_are_proven():
    own = token_counts.counter(open(JSON, encoding="utf-8").read(), PATTERN)
    library = Tokenizer.from_file(JSON)
    for text in sorted(own.whole)[::97]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_bpe_equals_the_library_and_round_trips():
    data = bpe.load_ranks(RANKS)
    own = bpe.Encoder(data, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    for text in fuzz_texts():
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_remembered_pieces_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    data = bpe.load_ranks(RANKS)
    own = bpe.Encoder(data, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    for text in fuzz_texts(200):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_token_queries_on_awkward_rows(spark, awkward, nothing):
    library = Tokenizer.from_file(JSON)
    counts = token_counts.count_tokens(awkward, JSON, PATTERN)
    wanted = Counter(
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in awkward_rows()
    )
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counts.collect()) == wanted
    encoded = bpe.encode_documents(awkward, RANKS, PATTERN)
    texts = Counter((i, (t or "").encode()) for i, t, *_ in awkward_rows())
    assert Counter((r.doc_id, bytes(r.decoded)) for r in encoded.collect()) == texts
    again = bpe.decode_ids(spark, encoded.select("doc_id", "ids"), RANKS, PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in again.collect()) == texts
    digest = bpe.encoding_digest(encoded).where("doc_id = 6").first()
    ids = encoded.where("doc_id = 6").first().ids
    assert digest.ids_sha256 == hashlib.sha256(ids).hexdigest() and digest.n_tokens == len(ids) // 4
    assert token_counts.count_tokens(nothing, JSON, PATTERN).count() == 0
    assert bpe.encode_documents(nothing, RANKS, PATTERN).count() == 0


# --- packing ----------------------------------------------------------------------------------


def test_best_fit_decreasing_against_a_plain_scan():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(0, 65) for _ in range(rng.randrange(0, 80))]
        left, plain = [], []
        for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [(c, b) for b, c in enumerate(left) if c >= sizes[item]]
            if fits:
                capacity = min(fits)[0]
                plain.append(capacity)
                left[next(b for b, c in enumerate(left) if c == capacity)] -= sizes[item]
            else:
                left.append(64 - sizes[item])
        bins = packing.best_fit_decreasing(sizes, 64)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 64 for b in bins)
        assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == sorted(left)


def test_packing_restores_every_document(spark, awkward, nothing):
    length = 64
    packed = packing.pack_documents(awkward, length, RANKS, PATTERN, pad=-1).collect()
    data = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    wanted = Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t, *_ in awkward_rows())
    pieces = Counter()
    for row in packed:
        assert len(row.ids) == length and len(row.position_ids) == length
        assert row.cu_seqlens[0] == 0 and row.cu_seqlens[-1] == row.n_used <= length
        assert all(x == -1 for x in row.ids[row.n_used :])
        for doc, start, low, high in zip(row.doc_ids, row.starts, row.cu_seqlens, row.cu_seqlens[1:]):
            pieces[doc, start, tuple(row.ids[low:high])] += 1
            assert row.position_ids[low:high] == list(range(high - low))
    expected = Counter()
    for (doc, ids), n in wanted.items():
        for start in range(0, max(1, len(ids)), length):
            expected[doc, start, ids[start : start + length]] += n
    assert pieces == expected
    assert len({r.pack_id for r in packed}) == len(packed)
    assert packing.pack_documents(nothing, length, RANKS, PATTERN).count() == 0


def test_unpack(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i * 7)) for i in range(30)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, 16, RANKS, PATTERN)
    again = packing.unpack(packing.pack(pieces, 16, 2))
    wanted = Counter((r.doc_id, r.start, tuple(np.frombuffer(r.ids, "<i4").tolist())) for r in pieces.collect())
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in again.collect()) == wanted


# --- quality ----------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def quality_texts():
    rng = random.Random(8)
    out = [t for _, t, *_ in awkward_rows()]
    for _ in range(40):
        base = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120))]
        out.append(rng.choice([" ", "  ", "\n", "\t"]).join(base) + rng.choice(["", "\n", " #*", "\r\n a b"]))
    out.append("\n".join(["same line here"] * 5 + ["", " ", "other"]))
    out.append(" ".join(f"w{i % 50}" for i in range(3000)))
    return out


def test_quality_counts(spark, labels):
    texts = quality_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.judge_quality(docs, labels).collect():
        wanted = plain_counts(texts[row.doc_id])
        got = row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words
        assert got == wanted, repr(texts[row.doc_id][:80] if texts[row.doc_id] else None)
        assert row.base_failed == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
        assert row.kept == (not row.base_failed and row.log_ratio >= row.threshold)


def test_quality_scores(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["river", "stone", "light", "house", "tree"]) + str(rng.randrange(9)) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice(["spam", "win", "click", "cash"]) + str(rng.randrange(9)) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    settings = quality.Settings(buckets=1 << 12)
    rows = quality.judge_quality(docs, labels, settings).collect()
    assert sum(r.kept for r in rows if r.doc_id < 60) >= 54
    assert not any(r.kept for r in rows if r.doc_id >= 60)
    # the ratio itself, from plain counts
    buckets = lambda t: [x % settings.buckets for x in grams(t)]
    trusted = [r.id for r in quality.trusted_ids(labels, settings).where("fit").collect()]
    corpus, target = np.zeros(settings.buckets), np.zeros(settings.buckets)
    for i, text in enumerate(good + bad):
        np.add.at(corpus, buckets(text), 1)
        if i in trusted:
            np.add.at(target, buckets(text), 1)
    ratios = quality.log_ratios(target, corpus, settings.smoothing)
    for r in rows[:20]:
        assert r.log_ratio == pytest.approx(np.mean(ratios[buckets((good + bad)[r.doc_id])]), abs=1e-6)


def test_all_trusted_documents_count(spark):
    settings = quality.Settings()
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    fit = quality.trusted_ids(ids, settings)
    assert fit.count() == 30_000 and 22_000 < fit.where("fit").count() < 23_000
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("_text"))
    counts = quality.gram_counts(rows.join(fit.where("fit"), F.col("doc_id") == F.col("id"), "left"), settings).collect()
    assert [(r.n, r.target) for r in counts] == [(30_000, fit.where("fit").count())]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def grams(text):
    found = text.split()
    single = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in found]
    pairs = [signed(xxhash.xxh64_intdigest(b.encode(), seed=a % (1 << 64))) for a, b in zip(single, found[1:])]
    return single + pairs


def test_quality_without_labels_or_rows(spark, awkward, nothing, labels):
    none = labels.limit(0)
    rows = quality.judge_quality(awkward, none).collect()
    assert len(rows) == len(awkward_rows()) and all(r.kept == (not r.base_failed) for r in rows)
    assert quality.judge_quality(nothing, labels).count() == 0


# --- n-gram join ------------------------------------------------------------------------------


def plain_join(rows, threshold=0.8):
    sets = {}
    for i, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        size = min(5, len(found))
        sets[i] = frozenset(tuple(found[k : k + size]) for k in range(len(found) - size + 1)) if found else frozenset()
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    copies = Counter(s for s in sets.values() if s)
    parent, degree = {i: i for i in first.values()}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {
        i: (find(first[s]), first[s], copies[s], degree[first[s]]) if s else (i, i, 1, 0) for i, s in sets.items()
    }


def near_rows():
    rng = random.Random(11)
    rows, at = [], 0
    for group in range(12):
        base = words(rng, rng.randrange(40, 200)).split()
        for _ in range(rng.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((at, " ".join(copy)))
            at += 1
    return rows + [(at, "too short"), (at + 1, "too  short"), (at + 2, None), (at + 3, ""), (at + 4, "x y z")]


@pytest.mark.parametrize("block_grams", [200_000, 700])
def test_join_against_all_pairs(spark, block_grams):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.jaccard_join(docs, recall=0.99999, block_grams=block_grams).collect()
    assert {r.doc_id: (r.class_id, r.rep_id, r.n_copies, r.n_links) for r in got} == plain_join(rows)


def test_bands_reach_the_recall():
    bands = ngram_join.bands_for(0.8, 0.995, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.995 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_minima_do_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 5, 40_000, 16_384, 3)]
    together = ngram_join.band_hashes(sets, 4, 3)
    for one, own in zip(sets, together):
        assert (ngram_join.band_hashes([one], 4, 3)[0] == own).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 201)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_join_on_awkward_rows(spark, awkward, nothing):
    rows = ngram_join.jaccard_join(awkward).collect()
    assert len(rows) == len(awkward_rows())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].class_id == by[7].class_id == by[8].class_id == 6 and by[6].n_copies == 3 and by[6].n_links == 1
    assert by[1].n_links == by[2].n_links == 0 and by[9].n_copies == 2
    kept = ngram_join.keep_first_of_group(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 7 not in ids and 8 not in ids and ids.count(None) == 2
    assert ngram_join.jaccard_join(nothing).count() == 0


def test_first_of_group_by_row(spark):
    rng = random.Random(31)
    copied, alone, shared = (words(rng, 60) for _ in range(3))
    near = copied + " more"
    rows = [(5, copied)] * 4 + [(8, near), (9, alone), (9, near), (9, near)]
    rows += [(None, shared), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_first_of_group(docs).collect())
    assert kept == Counter([(5, copied), (9, alone), (None, shared), (3, None), (3, "")])
    # of two texts of the smallest id one stays
    both = spark.createDataFrame([(1, near), (1, copied), (2, copied)], "doc_id long, text string")
    assert [r.doc_id for r in ngram_join.keep_first_of_group(both).collect()] == [1]


# --- decontamination --------------------------------------------------------------------------


def plain_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return before[1:]


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        pattern = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        assert decontaminate.edit_distance(pattern, text) == plain_distance(pattern, text)


def test_leaks_and_recall(spark):
    rng = random.Random(7)
    items = [(i, words(rng, rng.randrange(8, 70))) for i in range(60)]
    docs, truth = [], {}
    for i, text in items:
        for share in (0.0, 0.1, 0.2):
            own = text.split()
            k = int(share * len(own) + 1e-9)
            for _ in range(k):
                kind, at = rng.random(), rng.randrange(len(own))
                if kind < 1 / 3:
                    own[at] = "other"
                elif kind < 2 / 3:
                    own.insert(at, "more")
                elif len(own) > 1:
                    del own[at]
            doc = len(docs)
            docs.append((doc, f"{words(rng, 50)} {' '.join(own).upper()}, {words(rng, 50)}"))
            truth[doc] = i, share
    docs += [(len(docs) + k, words(rng, 300)) for k in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame, bench).collect()}
    for share, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.9)):
        wanted = [(d, i) for d, (i, s) in truth.items() if s == share]
        assert sum(x in found for x in wanted) >= least * len(wanted)
    for (doc, item), row in found.items():
        pattern = decontaminate.item_words(dict(items)[item])
        text = decontaminate.item_words(dict(docs)[doc])
        assert row.edits == min(plain_distance(pattern, text)) <= 0.2 * len(pattern)
        own = text[row.first_word : row.end_word]
        assert plain_distance(pattern, own)[-1] <= row.edits
    blocks = decontaminate.Settings(block_bytes=2000)
    again = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench, blocks).collect()}
    exact = {(d, i) for d, (i, s) in truth.items() if s == 0.0}
    assert exact <= again
    kept = {r.doc_id for r in decontaminate.drop_leaks(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


@pytest.mark.parametrize("length", [16, 32, 64, 65, 128])
def test_recall_by_length_and_kind_of_edit(length):
    rng = random.Random(length)
    settings = decontaminate.Settings()
    items = [(f"{k:03d}", " ".join(f"w{rng.randrange(100_000)}" for _ in range(length))) for k in range(150)]
    index = decontaminate.Index(items, settings)
    for kind in decontaminate.KINDS:
        texts = []
        for _, item in items:
            own = item.split()
            for _ in range(int(settings.edits * length)):
                how, at = kind if kind != "mixed" else rng.choice(["replace", "insert", "delete"]), rng.randrange(len(own))
                if how == "insert":
                    own.insert(at, "more")
                else:
                    own[at : at + 1] = ["other"] if how == "replace" else []
            texts.append(" ".join(["around"] * 20 + own + ["around"] * 20))
        found = {(text, item) for text, item, *_ in index.matches(texts)}
        assert sum((k, k) in found for k in range(len(items))) >= (settings.recall - 0.02) * len(items), kind


def test_repetitions_follow_the_recall():
    few, many = (decontaminate.repetitions(16, 3, decontaminate.Settings(recall=r)) for r in (0.8, 0.99))
    assert few[0] >= many[0] and few[1] < many[1]


def test_items_left_out_are_listed(spark):
    rows = [(1, "one two three four"), (2, "one two three four five"), (3, None), (4, ""), (None, "a - b"), (6, "x " * 500)]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {(r.item_id, r.n_words) for r in decontaminate.unsearched_items(items).collect()}
    assert got == {(1, 4), (3, 0), (4, 0), (None, 2)}
    assert decontaminate.unsearched_items(items.limit(0)).count() == 0


def test_decontamination_of_awkward_rows(spark, awkward, nothing):
    copy = next(t for i, t, *_ in awkward_rows() if i == 6)
    bench = spark.createDataFrame([(1, copy), (2, None), (3, ""), (None, copy), (4, "one")], "item_id long, text string")
    rows = decontaminate.find_leaks(awkward, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == Counter((d, i) for d in (6, 7, 8, None) for i in (1, None))
    kept = decontaminate.drop_leaks(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(awkward_rows()) - 4
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.find_leaks(awkward, bench.limit(0)).count() == 0


# --- toxicity ---------------------------------------------------------------------------------


def test_toxicity_learns(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(600):
        own = words(rng, rng.randrange(20, 90)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(["nasty", "vile", "Rotten,"]))
        docs.append((i, " ".join(own)))
        labels.append((i, 0, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = toxicity.score_toxicity(frame, marks)
    rows = scored.withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {i: t for i, _, t in labels}
    out = [r for r in rows if r.out]
    assert 80 < len(out) < 160
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in out) >= 0.97 * len(out)
    # held-out labels play no part
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(frame, turned).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_ftrl_against_a_plain_loop():
    settings = toxicity.Settings(buckets=32, epochs=2)
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 32, 6)), int(rng.integers(0, 2))) for _ in range(50)]
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        pull = max(0.0, abs(z[i]) - (0 if i == 32 else settings.l1))
        return -np.sign(z[i]) * pull / ((settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for at, label in rows:
            own = [*at.tolist(), 32]
            w = [weight(i) for i in own]
            g = 1 / (1 + np.exp(-sum(w))) - label
            for i, x in zip(own, w):
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / settings.alpha * x
                n[i] += g * g
    got = dict(zip(*(x.tolist() for x in toxicity.fit_ftrl(rows, settings))))
    for i in range(33):
        assert got.get(i, 0.0) == pytest.approx(weight(i), abs=1e-9)


def test_toxicity_on_awkward_rows(spark, awkward, nothing, labels):
    scored = toxicity.score_toxicity(awkward, labels)
    rows = scored.collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    untrained = toxicity.score_toxicity(awkward, labels.limit(0)).collect()
    assert {r.score for r in untrained} == {0.5}


# --- line dedup -------------------------------------------------------------------------------


def plain_lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    holders = {}
    order = lambda i: 1 << 63 if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark, awkward, nothing):
    rng = random.Random(13)
    pool = [f"Line {k} of the Pool Ä" for k in range(12)] + ["short", "", "  padded line here \t", "PADDED line here"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(3, "Line 1 of the Pool Ä\nanother text of document three"), (None, "line 1 of the pool Ä"), (70, "aäöüßéèêëc"), (71, "AäöüßéèêëC")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_digest(line_dedup.dedup_lines(docs)).collect()
    assert Counter(tuple(r) for r in got) == plain_lines(rows)
    source = [(i, t) for i, t, *_ in awkward_rows()]
    wide = line_dedup.dedup_lines(awkward)
    assert set(awkward.columns) | {"n_dropped"} == set(wide.columns)
    assert Counter(tuple(r) for r in line_dedup.line_digest(wide).collect()) == plain_lines(source)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_of_three_documents(spark):
    docs = spark.createDataFrame([(i, "the very same line\nline of pair") for i in range(2)] + [(2, "The very same line")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert rows == {0: "the very same line\nline of pair", 1: "line of pair", 2: ""}


# --- URLs -------------------------------------------------------------------------------------


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return host, path, *(best or (None, None))


def test_url_filter(spark):
    rng = random.Random(14)
    pages = []
    for i in range(600):
        host = rng.choice(["good", "fine"]) + rng.choice([".COM", ".example.com", "www.example.com", ".net", ".org"])
        if host.endswith("www.example.com"):
            host = "www.example.com"
        tail = rng.choice(["", "/", "/en/1", "/es/2?x=http://a", "/fr/3#q", "?q=1", "#f", "/de"])
        pages.append((i, f"https://{host}{tail}"))
    pages += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "://"), (1004, "x://COM/"), (None, "http://Äb.com/en/"), (7, pages[7][1])]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit("clash"))
    rows = urls.judge_urls(frame, URL_RULES).collect()
    assert len(rows) == len(pages)
    wanted = Counter((i, *plain_rule(u)[:3]) for i, u in pages)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == wanted
    verdicts = {h + p: v for v, h, p in URL_RULES}
    for r in rows:
        assert r.verdict == (verdicts[r.rule] if r.rule else ("allow" if r.log_ratio >= r.bar else "block"))
    assert urls.judge_urls(frame.limit(0), URL_RULES).count() == 0


def test_url_models_tell_classes_apart(spark):
    rng = random.Random(15)
    rows = []
    for i in range(800):
        good = i % 2 == 0
        name = "".join(rng.choice("abcde" if good else "vwxyz") for _ in range(8))
        rows.append((f"http://{name}.org/{rng.randrange(100)}", good))
    frame = spark.createDataFrame(rows, "url string, accepted boolean")
    settings = urls.Settings(buckets=1 << 14)
    models = urls.train(frame.limit(400), settings)
    scored = urls.score_urls(frame, models, settings)
    bar = urls.calibrate(scored, settings)
    right = scored.where((F.col("log_ratio") >= bar) == F.col("accepted")).count()
    assert right >= 0.99 * len(rows)
    # probabilities of all bytes after a context sum to 1 at most, as hashing only adds mass
    owner, before, joint = urls.contexts(["http://abc.org/1"], settings)
    assert np.isfinite(models[True].log_likelihood(before, joint)).all()
