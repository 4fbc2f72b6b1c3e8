"""Token-id output: best-fit-decreasing packing into rows of one length.

Documents longer than a row are split without loss into pieces of a row at most. Pieces are dealt
by hash into partitions; each task streams them in rounds of bounded size and packs a round by best
fit, longest first, so that full pieces come to stand alone. The capacity search is a segment tree
over the remaining capacities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fixturelab.llm.bpe import Stretches, load_ranks, parse_ranks
from fixturelab.llm.common import kept, map_arrow, slices

#: Pieces packed together; a round for 2,048-token rows then holds at most 32 MB of ids.
ROUND = 4096
#: Documents whose pieces go to one partition on average.
PARTITION_ROWS = 8192


class CapacityTree:
    """Bins by remaining capacity; finds the smallest capacity that still holds a size."""

    def __init__(self, most: int):
        self.width = 1
        while self.width <= most:
            self.width *= 2
        self.count = [0] * (2 * self.width)
        self.bins: dict[int, list[int]] = {}

    def add(self, capacity: int, bin_: int) -> None:
        self.bins.setdefault(capacity, []).append(bin_)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest bin with ``size`` left, and its capacity; the bin leaves the tree."""
        count, at = self.count, size + self.width
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at *= 2
                if not count[at]:
                    at += 1
        capacity = at - self.width
        bin_ = self.bins[capacity].pop()
        self._change(capacity, -1)
        return bin_, capacity


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each bin: longest first, each into the fullest bin that holds it."""
    tree, bins = CapacityTree(length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        if found is None:
            bins.append([item])
            tree.add(length - sizes[item], len(bins) - 1)
        else:
            bins[found[0]].append(item)
            tree.add(found[1] - sizes[item], found[0])
    return bins


def id_stretches(ranks: bytes, pattern: str) -> Stretches:
    def make() -> Stretches:
        encode = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={}
        ).encode_ordinary
        return Stretches(lambda stretch: np.array(encode(stretch), "<i4").tobytes())

    return kept("packing", (hashlib.sha256(ranks).hexdigest(), pattern), make)


def token_pieces(
    docs: DataFrame, length: int, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``length`` ids: ``doc_id``, ``start`` (offset in the document), ``ids`` (int32 bytes)."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))
    kind = dict(docs.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = id_stretches(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                owner, starts, pieces = [], [], []
                for at, text in enumerate(part.column(1).to_pylist()):
                    ids = b"".join(stretches.values(text or ""))
                    for start in range(0, max(len(ids), 1), 4 * length):
                        owner.append(at)
                        starts.append(start // 4)
                        pieces.append(ids[start : start + 4 * length])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(pieces, pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, encode, f"doc_id {kind}, start long, ids binary")


def pack(pieces: DataFrame, length: int, partitions: int, pad: int = 0) -> DataFrame:
    """Rows of ``length`` ids from pieces of at most that many.

    Returns for each row: ``pack_id``, ``ids`` (array of ``length`` ids, padded with ``pad``),
    ``n_used``, ``cu_seqlens`` (0 and the end of each segment), ``position_ids`` (0, 1, ... from each
    segment's begin; 0 in the padding), ``doc_ids`` and ``starts`` (each segment's document and its
    offset there). Every piece becomes one segment, pieces without ids too (segments of length 0),
    so the documents can be restored from the rows; null ids and repeated rows keep their segments.
    """
    kind = dict(pieces.dtypes)["doc_id"]
    dealt = (
        pieces.select("doc_id", "start", "ids", F.xxhash64("doc_id", "start", "ids").alias("deal"))
        .repartition(partitions, "deal")
        .sortWithinPartitions("deal", "doc_id")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        offset = TaskContext.get().partitionId() << 32

        def build(docs: pa.Array, starts: np.ndarray, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            bins = best_fit_decreasing([len(x) // 4 for x in ids], length)
            for low in range(0, len(bins), 512):
                some = bins[low : low + 512]
                matrix = np.full((len(some), length), pad, np.int32)
                positions = np.zeros((len(some), length), np.int32)
                cuts, order, used = [], [], []
                for at, items in enumerate(some):
                    end = 0
                    cuts.append(0)
                    for item in items:
                        own = np.frombuffer(ids[item], "<i4")
                        matrix[at, end : end + len(own)] = own
                        positions[at, end : end + len(own)] = np.arange(len(own))
                        end += len(own)
                        cuts.append(end)
                    order += items
                    used.append(end)
                many = np.array([len(x) for x in some])
                ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                grid = pa.array(np.arange(len(some) + 1, dtype=np.int32) * length)
                take = pa.array(order, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(made, made + len(some), dtype=np.int64) + offset),
                        pa.ListArray.from_arrays(grid, pa.array(matrix.ravel())),
                        pa.array(used, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends + np.arange(len(some) + 1, dtype=np.int32)), pa.array(cuts, pa.int32())),
                        pa.ListArray.from_arrays(grid, pa.array(positions.ravel())),
                        pa.ListArray.from_arrays(pa.array(ends), docs.take(take)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(starts[order])),
                    ],
                    names=["pack_id", "ids", "n_used", "cu_seqlens", "position_ids", "doc_ids", "starts"],
                )
                made += len(some)

        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from build(
                pa.concat_arrays(whole.column(0).chunks), whole.column(1).to_numpy(), whole.column(2).to_pylist()
            )

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                held.append(part)
                count += part.num_rows
                if count >= ROUND:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    schema = (
        "pack_id long, ids array<int>, n_used int, cu_seqlens array<int>, position_ids array<int>, "
        f"doc_ids array<{kind}>, starts array<long>"
    )
    return map_arrow(dealt.select("doc_id", "start", "ids"), rows, schema)


def pack_documents(
    docs: DataFrame, length: int, rank_path: str, pattern: str, pad: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenize, split and pack whole documents; see ``pack``. Null and empty texts are segments of
    length 0."""
    partitions = max(1, -(-docs.count() // PARTITION_ROWS))
    return pack(token_pieces(docs, length, rank_path, pattern, key, text), length, partitions, pad)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: one row of ids, its cumulative lengths and its position resets a record."""
    packed.write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """The pieces again: ``doc_id``, ``start`` and ``ids`` as an array."""
    segment = F.explode(
        F.expr(
            "transform(doc_ids, (d, i) -> named_struct('doc', d, 'start', starts[i],"
            " 'low', cu_seqlens[i], 'high', cu_seqlens[i + 1]))"
        )
    )
    return packed.select("ids", segment.alias("s")).select(
        F.col("s.doc").alias("doc_id"),
        F.col("s.start").alias("start"),
        F.expr("slice(ids, s.low + 1, s.high - s.low)").alias("ids"),
    )
