"""Token counts by the whole-token shortcut.

Before the job, each vocabulary string is tried: if the split pattern keeps it whole and the merges
turn it into its own id, it is proven to encode alone as one token. In the job such pieces count as
1 without any merge; only the other pieces are merged.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelab.llm.bpe import Departures, Pieces, Splitter, Stretches, departures, every_character
from fixturelab.llm.common import kept, map_arrow, n_bytes, slices


@functools.cache
def tokenizers_departures() -> Departures:
    """The classes of the split pattern as tokenizers has them, asked by its own splitter."""
    from tokenizers import Regex, pre_tokenizers

    def members(name: str) -> str:
        splitter = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        return "".join(piece for piece, _ in splitter.pre_tokenize_str(every_character()))

    return departures(members)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for
    itself, the other bytes follow from code point 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class PairMerger:
    """Number of tokens of a piece under an ordered list of pair merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            key = vocabulary[left] << 32 | vocabulary[right]
            self.pairs.setdefault(key, (rank, vocabulary[left + right]))
        self.letters = [vocabulary[x] for x in byte_letters()]

    def merge(self, piece: bytes) -> list[int]:
        pairs, ids, n = self.pairs.get, [self.letters[b] for b in piece], len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []
        for at in range(n - 1):
            if (found := pairs(ids[at] << 32 | ids[at + 1])) is not None:
                waiting.append((found[0], at, found[1], ids[at], ids[at + 1]))
        heapify(waiting)
        while waiting:
            _, at, new, left_id, right_id = heappop(waiting)
            right = after[at]
            if ids[at] != left_id or right >= n or ids[right] != right_id:
                continue
            end = after[right]
            ids[at], ids[right], after[at] = new, -1, end
            if end < n:
                before[end] = at
                if (found := pairs(new << 32 | ids[end])) is not None:
                    heappush(waiting, (found[0], at, found[1], new, ids[end]))
            left = before[at]
            if left >= 0 and (found := pairs(ids[left] << 32 | new)) is not None:
                heappush(waiting, (found[0], left, found[1], ids[left], new))
        return [x for x in ids if x >= 0]


class Counter:
    """Counts tokens of texts under a byte-level BPE description (a tokenizer's JSON)."""

    def __init__(self, description: str, pattern: str, whole: frozenset[str] | None = None, departs: Departures = ()):
        data = json.loads(description)
        model, splitter = data["model"], data["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and splitter["type"] == "ByteLevel"
            and not splitter["add_prefix_space"]
            and not model.get("ignore_merges")
            and data.get("normalizer") is None
        )
        if not plain:
            raise ValueError("only byte-level BPE without normalisation or added space is supported")
        self.merger = PairMerger(model["vocab"], model["merges"])
        self.find = Splitter(pattern, departs).find
        added = [x for x in data.get("added_tokens") or []]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError("added tokens that reach beyond their own string are not supported")
        special = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_strings = special
        self.whole = self.prove(model["vocab"]) if whole is None else whole
        self.pieces = Pieces(self._piece)
        self.stretches = Stretches(self._count)

    def prove(self, vocabulary: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that encode alone as one token, each tried."""
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        proven = []
        for token, number in vocabulary.items():
            if any(x not in byte_of for x in token):
                continue
            raw = bytes(byte_of[x] for x in token)
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if self.find(text) == [text] and self.merger.merge(raw) == [number]:
                proven.append(text)
        return frozenset(proven)

    def _count(self, stretch: str) -> int:
        return sum(map(self.pieces.__getitem__, self.find(stretch)))

    def _piece(self, piece: str) -> int:
        return 1 if piece in self.whole else len(self.merger.merge(piece.encode()))

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each and cut it."""
        if self.special is None or not any(x in text for x in self.special_strings):
            return sum(self.stretches.values(text))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(self.stretches.values(x)) for x in parts)


def counter(description: str, pattern: str, whole: frozenset[str] | None = None, departs: Departures = ()) -> Counter:
    """One counter for each vocabulary in a process."""
    name = hashlib.sha256(description.encode()).hexdigest(), pattern, departs
    return kept("token counts", name, lambda: Counter(description, pattern, whole, departs))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    The description and the proven strings are broadcast (a vocabulary is bounded), with the characters
    whose class tokenizers sees in another way than our split pattern. A null text is
    empty and has no tokens; null ids, repeated rows and empty tables pass through; other columns
    are not read. One narrow pass: no shuffle.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        description = file.read()
    departs = tokenizers_departures()
    proven = counter(description, pattern, None, departs).whole
    shared = docs.sparkSession.sparkContext.broadcast((description, proven))
    kind = dict(docs.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value[0], pattern, shared.value[1], departs)
        for batch in batches:
            for part in slices(batch, 1):
                tokens = [own.count(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(tokens, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), n_bytes(F.col(text)).alias("n_bytes"))
    counted = map_arrow(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
