"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, and exact verification.

Texts with equal n-gram sets form a class; one representative of each class goes on. Band and row
counts are chosen for a target recall at the threshold. Representatives that share a bucket (equal
band hashes) belong to one candidate group, found by linking each member to the smallest member of
its buckets. Groups are dealt into blocks of bounded size, and a task compares two blocks that share
a bucket on their full n-gram sets. It returns the number of links of each member and edges that
connect what is linked, never the pairs, so that a large group of near copies costs rows in
proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from fixturelab.llm.common import NULL_ID, fresh, kept, map_arrow, slices, written
from fixturelab.session import ship_package

#: Words that a worker remembers by their hash; the memory is emptied beyond. It changes speed only.
REMEMBERED = 200_000


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` minima each, so that a pair at the threshold meets with at least ``recall``."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


class Words(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode())
        if len(word) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _ODD[1]
    values = (values ^ (values >> np.uint64(27))) * _ODD[2]
    return values ^ (values >> np.uint64(31))


def ngrams(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of all word n-grams; a text of fewer words has one gram of all of them."""
    known = kept("n-grams", "words", Words)
    words = np.fromiter(map(known.__getitem__, text.translate(_SPACE).split(" ")), np.uint64)
    words = words[words != _EMPTY]
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * _ODD[0] + words[k : len(words) - size + 1 + k]
        total = _mixed(total)
    return np.unique(total)


_SPACE = {ord(c): " " for c in "\t\n\x0b\x0c\r"}
_EMPTY = np.uint64(xxhash.xxh64_intdigest(b""))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    state = _mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD[0])
    return state[:count] | np.uint64(1), state[count:]


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """For each set (none empty), one hash for each band of its row minima under as many permutations."""
    scale, shift = _permutations(bands * rows)
    least = np.full((len(sets), bands * rows), np.iinfo(np.uint64).max, np.uint64)

    def lower(owners: list[int], parts: list[np.ndarray]) -> None:
        flat = np.concatenate(parts)
        starts = np.cumsum([0, *(len(x) for x in parts[:-1])])
        value, high = np.empty_like(flat), np.empty_like(flat)
        for at in range(bands * rows):
            np.multiply(flat, scale[at], out=value)
            value += shift[at]
            np.right_shift(value, np.uint64(32), out=high)
            value ^= high
            least[owners, at] = np.minimum(least[owners, at], np.minimum.reduceat(value, starts))

    owners, parts, held = [], [], 0
    for owner, grams in enumerate(sets):
        for low in range(0, len(grams), 16_384):
            part = grams[low : low + 16_384]
            if held + len(part) > 16_384 or owner in owners[-1:]:
                lower(owners, parts)
                owners, parts, held = [], [], 0
            owners.append(owner)
            parts.append(part)
            held += len(part)
    if parts:
        lower(owners, parts)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), 1))
    least = least.reshape(len(sets), bands, rows)
    for k in range(rows):
        out = _mixed(out * _ODD[0] + least[:, :, k])
    return out


def signatures(rows: DataFrame, n: int, bands: int, rows_per_band: int) -> DataFrame:
    """``id``, ``cls`` (128-bit hash of the n-gram set), ``size`` (of the set) and ``bands``.

    A text without words has a null class and no bands.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [ngrams(text or "", n) for text in part.column(1).to_pylist()]
                sizes = [len(x) for x in sets]
                classes = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                found = iter(band_hashes([x for x in sets if len(x)], bands, rows_per_band).view(np.int64))
                hashes = [next(found) if size else None for size in sizes]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(classes, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(hashes, pa.list_(pa.int64())),
                    ],
                    names=["id", "cls", "size", "bands"],
                )

    return map_arrow(rows, sign, "id long, cls binary, size long, bands array<long>")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of all nodes of the edges ``a``, ``b``.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    the rounds grow with the logarithm of the longest path. Labels are written once a round.
    """
    both = written(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = written(
            lowered.join(jump, "low").select("node", "old", F.least("low", "further").alias("label")), "labels"
        )
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels
    raise RuntimeError("components did not settle; the graph holds paths longer than 2 ** rounds")


def candidate_groups(representatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of two members or more (``bucket``, ``cls``), and the ``grp`` of each of their members."""
    buckets = representatives.select("cls", F.posexplode("bands").alias("band", "hash")).select(
        "cls", F.xxhash64("band", "hash").alias("bucket")
    )
    heads = buckets.groupBy("bucket").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).where("head < last")
    met = written(buckets.join(heads.select("bucket", "head"), "bucket"), "buckets")
    spokes = met.where("cls != head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    return met.select("bucket", "cls"), components(spokes).withColumnRenamed("label", "grp")


def blocks(groups: DataFrame, sizes: DataFrame, block_grams: int) -> DataFrame:
    """``cls`` and ``block``: whole groups share blocks of about ``block_grams`` n-grams; a larger group
    gets blocks of its own. A block is named by two numbers in one string."""
    members = groups.select(F.col("node").alias("cls"), "grp").join(sizes, "cls")
    totals = written(members.groupBy("grp").agg(F.sum("size").alias("total")), "totals")
    small = totals.where(F.col("total") <= block_grams).agg(F.sum("total")).first()[0] or 0
    shared = max(1, -(-small // block_grams))
    parts = F.ceil(F.col("total") / block_grams)
    name = F.when(
        F.col("total") <= block_grams, F.concat(F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(shared)).cast("string"))
    ).otherwise(F.concat(F.hex("grp"), F.lit("-"), F.pmod(F.xxhash64("cls"), parts).cast("string")))
    return written(members.join(totals, "grp").select("cls", name.alias("block")), "blocks")


def tiles(met: DataFrame, placed: DataFrame) -> DataFrame:
    """``one`` <= ``two``: every block with itself, and blocks that share a bucket."""
    inside = met.join(placed, "cls").select("bucket", "block").distinct()
    spread = inside.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    wide = written(inside.join(spread, "bucket", "left_semi"), "wide-buckets")
    other = wide.select("bucket", F.col("block").alias("two"))
    across = wide.withColumnRenamed("block", "one").join(other, "bucket").where("one < two").select("one", "two")
    alone = placed.select(F.col("block").alias("one"), F.col("block").alias("two"))
    return across.distinct().unionAll(alone.distinct())


def compare_sets(
    sets: list[np.ndarray], first: np.ndarray, same: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Number of links of each set, and the smallest position that links connect it with.

    ``same``: all sets against each other; else those of the first block against the others.
    """
    count = len(sets)
    sizes = np.array([len(x) for x in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, gram, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(count), sizes)[np.argsort(gram, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(df)[:-1]])
    links, label = np.zeros(count, np.int64), np.arange(count)
    for at in range(count) if same else np.flatnonzero(first).tolist():
        own = gram[bounds[at] : bounds[at + 1]]
        own = own[df[own] > 1]
        if not len(own):
            continue
        many = df[own]
        total = int(many.sum())
        places = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(total)
        common = np.bincount(holder[places], minlength=count)
        common[at] = 0
        if not same:
            common[first] = 0
        near = np.flatnonzero(common >= threshold * (sizes + sizes[at] - common) - 1e-9)
        near = near[common[near] > 0]
        if len(near):
            links[at] += len(near)
            if not same:
                links[near] += 1
            joined = np.unique(np.append(label[near], label[at]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return links, label


def verified(pairs: DataFrame, placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``cls``, ``links`` and ``root`` (a member it is connected with) from each tile it is in."""
    numbered = pairs.withColumn("tile", F.concat_ws("|", "one", "two"))
    one = numbered.select("tile", F.col("one").alias("block"), F.lit(True).alias("first"), (F.col("one") == F.col("two")).alias("same"))
    two = numbered.where("one < two").select("tile", F.col("two").alias("block"), F.lit(False).alias("first"), F.lit(False).alias("same"))
    members = one.unionAll(two).join(placed, "block").join(sets, "cls").select("tile", "cls", "first", "same", "grams")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls").combine_chunks()
        flat = table.column("grams").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        ends = flat.offsets.to_numpy()
        values = flat.values.to_numpy()
        own = [values[low:high] for low, high in zip(ends[:-1], ends[1:])]
        first = table.column("first").to_numpy().astype(bool)
        links, label = compare_sets(own, first, bool(table.column("same")[0].as_py()), threshold)
        names = table.column("cls").combine_chunks()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        found = pa.array(links > 0)
        return pa.table(
            {"cls": names.filter(found), "links": pa.array(links).filter(found), "root": names.take(pa.array(label)).filter(found)}
        )

    ship_package(members.sparkSession)
    return members.groupBy("tile").applyInArrow(compare, "cls binary, links long, root binary")


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    recall: float = 0.995,
    rows_per_band: int = 6,
    block_grams: int = 200_000,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each input row: ``doc_id``, ``class_id``, ``rep_id``, ``n_copies`` and ``n_links``.

    Words are runs without white space, as they are written; a text of fewer than ``n`` words has one
    gram of all of them. ``rep_id`` is the smallest id with the same n-gram set and ``n_copies`` the
    number of rows with that set; ``n_links`` counts the other sets with a Jaccard similarity of at
    least ``threshold``; ``class_id`` is the smallest id of all sets that such links connect. A null or
    wordless text has no grams: it is a class of its own id with no links, and so is a null id among
    such texts. Null ids count as one id after all others (and come back as null); repeated rows are
    copies. Candidates that share no band are lost, at the threshold at most a share of 1 - recall.
    """
    bands = bands_for(threshold, recall, rows_per_band)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))
    signed = written(signatures(rows, n, bands, rows_per_band), "signatures")
    worded = signed.where("cls is not null")
    classes = written(
        worded.groupBy("cls").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size")
        ),
        "classes",
    )
    # one row of signatures for each class: that of the smallest id
    firsts = worded.join(classes.select("cls", F.col("rep").alias("id")), ["cls", "id"], "left_semi")
    representatives = firsts.dropDuplicates(["cls"]).select("cls", "id", "size", "bands")
    representatives = written(representatives, "representatives")
    met, groups = candidate_groups(representatives)
    involved = groups.select(F.col("node").alias("cls")).join(representatives.select("cls", "id"), "cls")
    sets = written(_sets_of(rows, involved, n), "grams")
    placed = blocks(groups, representatives.select("cls", "size"), block_grams)
    found = written(verified(tiles(met, placed), placed, sets, threshold), "links")
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.where("cls != root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    # labels are hashes; the class id is the smallest document id below a label
    named = written(joined.join(classes.select(F.col("cls").alias("node"), "rep"), "node"), "named")
    ids = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    numbered = named.join(ids, "label").select(F.col("node").alias("cls"), "class_id")
    about = (
        classes.join(numbered, "cls", "left")
        .join(degree, "cls", "left")
        .select(
            "cls",
            F.col("rep").alias("rep_id"),
            F.col("copies").alias("n_copies"),
            F.coalesce("class_id", "rep").alias("class_id"),
            F.coalesce("links", F.lit(0)).alias("n_links"),
        )
    )
    out = signed.select("id", "cls").join(about, "cls", "left")

    def known(column):
        return F.when(column != NULL_ID, column)

    return out.select(
        known(F.col("id")).alias("doc_id"),
        known(F.coalesce("class_id", "id")).alias("class_id"),
        known(F.coalesce("rep_id", "id")).alias("rep_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _sets_of(rows: DataFrame, involved: DataFrame, n: int) -> DataFrame:
    """The n-gram set of each involved class, from the text of its smallest id."""
    wanted = rows.join(involved.select("id").distinct(), "id", "left_semi")
    found = with_class(wanted, n).join(involved.select("cls"), "cls", "left_semi")
    return found.dropDuplicates(["cls"])


def with_class(rows: DataFrame, n: int) -> DataFrame:
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [ngrams(x or "", n) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                        pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                    ],
                    names=["cls", "grams"],
                )

    return map_arrow(rows, classify, "cls binary, grams array<long>")


def keep_first_of_group(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    key: str = "doc_id",
    text: str = "text",
    keep_null_ids: bool = True,
) -> DataFrame:
    """One row of each class of near copies, whatever ids its rows have; all columns pass through.

    Rows are judged one by one. Of a class stays a row of the smallest id; of several texts of that id
    the one with the smallest hash, of equal rows any one. Rows without words stay. Rows with a null id
    stay too if ``keep_null_ids`` is set; else they come after all other ids and are copies like them.
    """
    row = fresh(docs, "_row")
    # numbers that a second reading can't change
    marked = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    judged = jaccard_join(marked, threshold, n, key=row, text=text).select(F.col("doc_id").alias("row"), "class_id")
    named = marked.select(F.col(row).alias("row"), F.col(key).alias("id"), F.md5(F.col(text)).alias("digest"))
    rivals = named.where("id is not null") if keep_null_ids else named
    firsts = (
        judged.join(rivals, "row")
        .groupBy("class_id")
        .agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest", "row")).alias("first"))
    )
    stay = firsts.select(F.col("first.row").alias(row))
    if keep_null_ids:
        stay = stay.unionAll(named.where("id is null").select(F.col("row").alias(row)))
    return marked.join(stay, row, "left_semi").drop(row)
