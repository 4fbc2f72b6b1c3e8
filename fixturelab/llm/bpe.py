"""Byte-level BPE encoding and decoding from a rank file.

Each match of the split pattern is merged on its own. Merges wait in a rank queue: one bucket of
positions per merge rank, and a bitmap in levels of 64 bits above the buckets, so that find-first-set
picks the next rank in a few word operations. Positions belong to a linked list over the bytes; an
entry whose pair has changed meanwhile is stale and skipped. A piece of n bytes costs O(n log n)
at worst, which suits very long pieces.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixturelab.llm.common import kept, map_arrow, slices

#: Pieces longer than this are encoded each time; shorter ones are remembered by a worker.
REMEMBERED_CHARS = 48
#: Remembered stretches and pieces of a worker; a memory is emptied beyond. It changes speed only.
REMEMBERED = 700_000
REMEMBERED_PIECES = 600_000


#: The classes of the split pattern whose members depend on a library's Unicode version.
CLASSES = (r"\p{L}", r"\p{N}")

#: Code points of each class that only our pattern, and that only the library has, as sets in brackets.
Departures = tuple[tuple[str, str, str], ...]


def every_character() -> str:
    """All code points but surrogates."""
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _as_set(points: list[int]) -> str:
    """Code points as a set in brackets of escaped ranges; empty without any."""
    ranges: list[list[int]] = []
    for point in sorted(points):
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else ""


def departures(members: Callable[[str], str]) -> Departures:
    """Where a library, asked for the text of all matches of a class, differs from our own pattern."""
    found = []
    for name in CLASSES:
        own, theirs = set(regex.findall(name, every_character())), set(members(name))
        if own != theirs:
            found.append((name, _as_set([ord(x) for x in own - theirs]), _as_set([ord(x) for x in theirs - own])))
    return tuple(found)


@functools.cache
def tiktoken_departures() -> Departures:
    """The classes as tiktoken has them: it encodes the matches of a pattern and nothing else."""
    import tiktoken

    def members(name: str) -> str:
        coder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return coder.decode_bytes(coder.encode_ordinary(every_character())).decode()

    return departures(members)


class Splitter:
    """Matches of the split pattern, with a library's classes.

    Texts without a character that the classes disagree on, nearly all, take the plain pattern.
    """

    def __init__(self, pattern: str, departs: Departures = ()):
        self.plain = regex.compile(pattern).findall
        odd = "".join(minus[1:-1] + plus[1:-1] for _, minus, plus in departs)
        self.odd = re.compile(f"[{odd}]").search if odd else None
        for name, minus, plus in departs:
            kept_ = f"[{name}--{minus}]" if minus else name
            pattern = pattern.replace(name, f"[{kept_}||{plus}]" if plus else kept_)
        self.exact = regex.compile("(?V1)" + pattern).findall if odd else self.plain

    def find(self, text: str) -> list[str]:
        if self.odd is None or text.isascii() or self.odd(text) is None:
            return self.plain(text)
        return self.exact(text)


def load_ranks(path: str) -> bytes:
    """The bytes of a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Merger:
    """Encodes one piece of bytes by merge ranks.

    The queue's bitmap has two levels: a leaf of 256 bits for each run of 256 ranks, and one word
    above with a bit for each leaf that isn't empty. Every bucket is a heap of positions, so that
    equal ranks merge from the left.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.leaves = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.bit = [1 << i for i in range(max(256, len(self.leaves)))]

    def ids(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        rank_of, leaves, bit, n = ranks.get, self.leaves, self.bit, len(piece)
        after, before, current = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
        buckets: dict[int, list[int]] = {}
        top = 0
        for at in range(n - 1):
            rank = rank_of(piece[at : at + 2])
            if rank is not None:
                current[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)
                else:
                    buckets[rank] = [at]
                    leaves[rank >> 8] |= bit[rank & 255]
                    top |= bit[rank >> 8]
        while top:
            leaf = (top & -top).bit_length() - 1
            word = leaves[leaf]
            low = word & -word
            rank = leaf << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                word ^= low
                leaves[leaf] = word
                if not word:
                    top ^= bit[leaf]
            if current[at] != rank:
                continue  # stale: the pair has changed
            right = after[at]
            end = after[at] = after[right]
            current[right] = current[at] = -1
            left = before[at]
            found = []
            if end < n:
                before[end] = at
                found.append((at, rank_of(piece[at : after[end]])))
            if left >= 0:
                current[left] = -1
                found.append((left, rank_of(piece[left:end])))
            for at, rank in found:
                if rank is not None:
                    current[at] = rank
                    if rank in buckets:
                        heappush(buckets[rank], at)
                    else:
                        buckets[rank] = [at]
                        leaves[rank >> 8] |= bit[rank & 255]
                        top |= bit[rank >> 8]
        out, at = [], 0
        while at < n:
            end = after[at]
            out.append(ranks[piece[at:end]])
            at = end
        return out


class Uneven(Exception):
    """A stretch between single spaces that begins or ends with white space."""


class Memory(dict):
    """Value of each stretch of text between single spaces, computed on first sight."""

    def __init__(self, compute: Callable[[str], object], lead: str):
        super().__init__()
        self.compute, self.lead = compute, lead

    def __missing__(self, stretch: str):
        if not stretch or stretch[0].isspace() or stretch[-1].isspace():
            raise Uneven
        value = self.compute(self.lead + stretch)
        if len(stretch) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = value
        return value


class Pieces(dict):
    """Value of each match of the split pattern, computed on first sight."""

    def __init__(self, compute: Callable[[str], object]):
        super().__init__()
        self.compute = compute

    def __missing__(self, piece: str):
        value = self.compute(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = value
        return value


class Stretches:
    """Applies a function of text to stretches that the split pattern can't join.

    A single space between two characters other than white space begins a new match whatever stands
    before it, so the stretches between such spaces are independent, and a frequent stretch needs to
    be looked at once only.
    """

    def __init__(self, compute: Callable[[str], object]):
        self.compute = compute
        self.first, self.spaced = Memory(compute, ""), Memory(compute, " ")
        self.border = regex.compile(r"(?<=\S) (?=\S)")

    def values(self, text: str) -> Iterator:
        if not text:
            return iter(())
        parts = text.split(" ")
        try:
            head = self.first[parts[0]]
            return iter([head, *map(self.spaced.__getitem__, parts[1:])])
        except Uneven:
            pieces = self.border.split(text)
            return iter([self.compute(x if i == 0 else " " + x) for i, x in enumerate(pieces)])


class Encoder:
    """Texts to ids and back, as the rank file and the split pattern say."""

    def __init__(self, rank_data: bytes, pattern: str, departs: Departures = ()):
        ranks = parse_ranks(rank_data)
        self.merger = Merger(ranks)
        self.find = Splitter(pattern, departs).find
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = Pieces(self._merged)
        self.stretches = Stretches(self._packed)

    def _packed(self, stretch: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(stretch)))

    def _merged(self, piece: str) -> bytes:
        ids = self.merger.ids(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.stretches.values(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(rank_data: bytes, pattern: str, departs: Departures = ()) -> Encoder:
    """One encoder for each vocabulary in a worker, so that later tasks find its memory filled."""
    name = hashlib.sha256(rank_data).hexdigest(), pattern, departs
    return kept("bpe", name, lambda: Encoder(rank_data, pattern, departs))


def encode_documents(
    docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (bytes) of every whole text.

    The rank file is read on the driver and broadcast (1 MB for 50,000 ranks), with the characters whose
    class tiktoken sees in another way than our split pattern. A null text counts as
    the empty one and has no ids; null ids, repeated rows and empty tables pass through; other
    columns are not read. One narrow pass: no shuffle.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(rank_path))
    departs = tiktoken_departures()
    kind = dict(docs.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks.value, pattern, departs)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [coder.encode(x or "") for x in part.column(1).to_pylist()]
                decoded = [coder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    return map_arrow(
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")),
        encode,
        f"doc_id {kind}, ids binary, decoded binary",
    )


def decode_ids(spark: SparkSession, encoded: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The encoded table with the bytes of ``ids`` decoded into a column ``decoded``; null ids stay null."""
    ranks = spark.sparkContext.broadcast(load_ranks(rank_path))
    names = list(encoded.columns)
    at = names.index(ids)
    others = [c for c in names if c != "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks.value, pattern)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(at).to_pylist()]
            columns = [batch.column(names.index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=[*others, "decoded"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c in others)
    return map_arrow(encoded, decode, f"{schema}, decoded binary")


def encoding_digest(encoded: DataFrame) -> DataFrame:
    """Counts and checksums of ids and decoded bytes."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
