"""Benchmark decontamination: near copies of benchmark items inside documents, by edit distance.

Items and documents are sequences of words. A random walk (one coin for each step and word) embeds a
sequence so that its edit distance becomes a Hamming distance: at every step the walk writes the word
it stands on and moves on or stays, as the coin says, and after an edit two walks soon meet again.
Bit-sampling LSH then reads the word at a few random steps and hashes them; it is repeated with fresh
walks until the target recall is reached. Windows of item size start at every word of a document;
hits are verified by exact edit distance against the whole item.

Walks that meet at one step stay together, and they can't overtake each other, so the walks of all
windows of a text are kept as one sorted array that shrinks as they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from fixturelab.llm.common import fresh, kept, map_arrow, slices

#: Marks dropped from both ends of a word before words are compared.
MARKS = ".,;:!?\"'()[]{}<>|*%&$#-_/\\`~^+="
#: Words that a worker remembers by number; the memory is emptied beyond. It changes speed only.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    """``edits``: share of an item's words that may differ; ``recall``: share of matches to be found,
    for items of any length and any kind of edit; ``samples``: steps read for one key at most, and
    ``tables``: repetitions above which fewer steps are read (two at least, then as many repetitions
    as it takes); ``window``: the longest window, which longer items are tiled with; ``min_words``:
    shorter items are no evidence and match nothing; ``block_bytes``: benchmark text that is
    broadcast at once, larger benchmarks take more passes over the documents."""

    edits: float = 0.2
    recall: float = 0.99
    samples: int = 4
    tables: int = 64
    window: int = 64
    min_words: int = 5
    block_bytes: int = 8_000_000


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def bare(word: str) -> str:
    return word.strip(MARKS).lower()


def item_words(text: str) -> list[str]:
    return [w for w in map(bare, text.split()) if w]


def edit_distance(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Edit distance of the whole pattern to the best stretch ending at each word of ``text``.

    Anchored: to the stretch from the begin of ``text``. Bit-parallel over the pattern's words.
    """
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for at, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << at
    up, down, score, out = full, 0, n, []
    for word in text:
        same = where.get(word, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        more = down | (full & ~(horizontal | up))
        less = up & horizontal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more = (more << 1 | anchored) & full
        less = less << 1 & full
        up = less | (full & ~(vertical | more))
        down = more & vertical
        out.append(score)
    return out


def steps(size: int, table: int, samples: int) -> list[int]:
    """The steps that a table reads: distinct, over the three quarters of a walk that stay inside."""
    draws = np.random.default_rng([size, table]).permutation(max(samples, size * 3 // 2))
    return sorted(draws[:samples].tolist())


def walk(
    words: np.ndarray, symbols: np.ndarray, starts: np.ndarray, size: int, table: int, samples: int
) -> tuple[np.ndarray, np.ndarray]:
    """A table's key of the window at each start (sorted), and whether all its words are known.

    ``words``: a hash of the word of each number."""
    keys = np.full(len(starts), np.uint64(table * 1_000_003 + size), np.uint64)
    valid = np.ones(len(starts), bool)
    walkers, owner = np.unique(starts, return_inverse=True)
    walkers = walkers.copy()
    reads = steps(size, table, samples)
    for step in range(reads[-1] + 1):
        if step % 64 == 0:
            seed = np.uint64(size) << np.uint64(40) | np.uint64(table) << np.uint64(20) | np.uint64(step // 64)
            coins = _mix(words + _mix(np.array([seed]))[0])
        here = symbols[walkers]
        if step in reads:
            word = here[owner]
            valid &= word > 0
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))
        walkers += ((coins[here] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
        if step % 8 == 7:
            new = np.empty(len(walkers), bool)
            new[0] = True
            np.not_equal(walkers[1:], walkers[:-1], out=new[1:])
            if not new.all():
                owner = (np.cumsum(new) - 1)[owner]
                walkers = walkers[new]
    return keys, valid


def window(n: int, settings: Settings) -> int:
    """The window of an item of n words: the largest power of two, or three quarters of one, that
    fits, up to the longest."""
    power = 1 << (n.bit_length() - 1)
    return min(settings.window, power * 3 // 2 if n >= power * 3 // 2 > power else power)


def allowed(n: int, settings: Settings) -> int:
    return int(settings.edits * n + 1e-9)


def spared(n: int, settings: Settings) -> int:
    """Edits that the best window of an item of n words holds at most: where the item's allowed
    edits don't all fit the overlap of its windows, the rest is shared between them."""
    size, k = window(n, settings), allowed(n, settings)
    windows = -(-n // size)
    overlap = windows * size - n
    return (k + min(k, overlap)) // windows


def most_edits(lengths: list[int], settings: Settings) -> dict[int, int]:
    """Edits of the best window of any item, by the size of the window."""
    most: dict[int, int] = {}
    for n in set(lengths):
        size = window(n, settings)
        most[size] = max(most.get(size, 0), spared(n, settings))
    return most


#: Kinds of edits of trial pairs: words replaced, inserted, deleted, or any of them.
KINDS = ("replace", "insert", "delete", "mixed")
#: Trial pairs of each kind.
TRIALS = 400


def edited(words: list[int], edits: int, kind: str, rng: np.random.Generator) -> list[int]:
    """The words after so many edits at random places; 0 is a word that no item has."""
    out = list(words)
    for _ in range(edits):
        own = kind if kind != "mixed" else KINDS[rng.integers(3)]
        at = int(rng.integers(len(out)))
        if own == "replace":
            out[at] = 0
        elif own == "insert":
            out.insert(at, 0)
        elif len(out) > 1:
            del out[at]
    return out


@lru_cache(maxsize=256)
def repetitions(size: int, edits: int, settings: Settings) -> tuple[int, int]:
    """Steps to read for a key and tables, so that a window of ``size`` distinct words that holds
    ``edits`` edits of any kind is found with ``settings.recall`` at least.

    The tables are tried on pairs of a window and its edited copy among unknown words, until each
    kind of edits reaches the recall; pairs differ in their chance, so that a mean hit rate of one
    table would promise too much.
    """
    rng = np.random.default_rng([size, edits])
    words = rng.integers(0, 1 << 64, 1 + len(KINDS) * TRIALS * size, dtype=np.uint64)
    words[0] = 0
    flat, copies, first, begins = [], [], [], []
    for pair in range(len(KINDS) * TRIALS):
        own = list(range(1 + pair * size, 1 + (pair + 1) * size))
        first.append(len(flat))
        flat += [*own, *[0] * (2 * size)]
        begins.append(len(copies) + size)
        copies += [*[0] * size, *edited(own, edits, KINDS[pair // TRIALS], rng), *[0] * (2 * size)]
    item, copy, first, begins = (np.array(x, np.int64) for x in (flat, copies, first, begins))
    shifts = np.arange(-edits, edits + 1)
    for samples in range(min(settings.samples, size), 0, -1):
        left = np.arange(len(first))
        table = 0
        while len(left):
            wanted, inside = walk(words, item, first[left], size, table, samples)
            places = (begins[left][:, None] + shifts).ravel()
            found, valid = walk(words, copy, places, size, table, samples)
            hit = (found.reshape(len(left), -1) == wanted[:, None]) & valid.reshape(len(left), -1) & inside[:, None]
            left = left[~hit.any(axis=1)]
            table += 1
            if np.bincount(left // TRIALS, minlength=len(KINDS)).max() <= (1 - settings.recall) * TRIALS:
                return samples, table
            if table >= settings.tables and samples > 2:
                break
    raise ValueError(f"recall {settings.recall} can't be reached")


def planned(lengths: list[int], settings: Settings) -> dict[int, tuple[int, int]]:
    """Steps to read and tables of each window size, for items of so many words."""
    return {size: repetitions(size, most, settings) for size, most in most_edits(lengths, settings).items()}


class Numbers(dict):
    """Number of a word as written: 0 if no item has it, -1 if nothing is left of it."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        plain = word.strip(MARKS).lower()
        value = self.numbers.get(plain, 0) if plain else -1
        if len(word) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


class Index:
    """Keys of the windows of a block of items."""

    def __init__(
        self, items: list[tuple[str, str]], settings: Settings, plan: dict[int, tuple[int, int]] | None = None
    ):
        self.settings = settings
        self.names: list[str] = []
        self.items: list[list[int]] = []
        self.numbers: dict[str, int] = {}
        for name, text in sorted(items):
            words = item_words(text)
            if len(words) >= settings.min_words:
                self.names.append(name)
                self.items.append([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])
        self.distinct = [frozenset(x) for x in self.items]
        #: a hash of each known word; number 0 is every other word
        self.coins = np.array(
            [0, *(xxhash.xxh64_intdigest(w.encode()) for w in self.numbers)], np.uint64
        )
        self.seen = Numbers(self.numbers)
        #: for each window size, the words of its items, and a hashed set of their word pairs (a pair of
        #: items' words may be taken for one of them)
        self.words: dict[int, np.ndarray] = {}
        self.pairs: dict[int, np.ndarray] = {}
        for words in self.items:
            size, own = window(len(words), settings), np.array(words, np.int64)
            self.words.setdefault(size, np.zeros(len(self.numbers) + 1, bool))[own] = True
            self.pairs.setdefault(size, np.zeros(1 << 22, bool))[self._pair(own[:-1], own[1:])] = True
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.plan = planned([len(x) for x in self.items], settings) if plan is None else plan
        self._index()

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = (left * 0x9E3779B1 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(42)).astype(np.int64)

    def allowed(self, n: int) -> int:
        return allowed(n, self.settings)

    def _index(self) -> None:
        by_size: dict[int, list[int]] = {}
        for at, words in enumerate(self.items):
            by_size.setdefault(window(len(words), self.settings), []).append(at)
        #: edits of the best window of any item of the size
        self.most = most_edits([len(x) for x in self.items], self.settings)
        for size, members in by_size.items():
            starts, owners, offsets, flat = [], [], [], []
            for at in members:
                words = self.items[at]
                places = sorted({*range(0, len(words) - size + 1, size), len(words) - size})
                for offset in places:
                    starts.append(len(flat) + offset)
                    owners.append(at)
                    offsets.append(offset)
                flat += words
                flat += [0] * (2 * size)  # a walk that leaves its item reads unknown words
            symbols = np.array(flat, np.int64)
            owner, offset = np.array(owners, np.int32), np.array(offsets, np.int32)
            keys, rows = [], []
            for table in range(self.plan[size][1]):
                own, valid = self.keys(symbols, np.array(starts, np.int64), size, table)
                keys.append(own[valid])
                rows.append(np.flatnonzero(valid).astype(np.int32))
            key, row = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(key, kind="stable")
            if len(order):
                self.sizes[size] = key[order], owner[row[order]], offset[row[order]]

    def keys(self, symbols: np.ndarray, starts: np.ndarray, size: int, table: int) -> tuple[np.ndarray, np.ndarray]:
        return walk(self.coins, symbols, starts, size, table, self.plan[size][0])

    def candidates(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and their presumed begins among the windows of a run of texts."""
        pair = self._pair(symbols[:-1], symbols[1:])
        items, begins = [], []
        for size, (known, owners, offsets) in self.sizes.items():
            # Necessary for the best window of any match: a word that no item of the size has is an edit, and an
            # edit breaks two word pairs of the window at most, so windows with more such words or fewer pairs go.
            most = self.most[size]
            strange = ~self.words[size][symbols]
            unknown = np.concatenate([[0], np.cumsum(strange)])
            kept = self.pairs[size][pair] & ~strange[:-1] & ~strange[1:]
            shared = np.concatenate([[0], np.cumsum(kept), [kept.sum()]])
            ends = np.minimum(np.arange(len(symbols)) + size, len(symbols))
            last = np.maximum(ends - 1, np.arange(len(symbols)))
            enough = shared[last] - shared[: len(symbols)] >= size - 1 - 2 * most
            starts = np.flatnonzero(enough & (unknown[ends] - unknown[:-1] <= most))
            if not len(starts):
                continue
            padded = np.concatenate([symbols, np.zeros(2 * size, np.int64)])
            for table in range(self.plan[size][1]):
                keys, valid = self.keys(padded, starts, size, table)
                rows = np.flatnonzero(valid)
                low = np.searchsorted(known, keys[rows], "left")
                high = np.searchsorted(known, keys[rows], "right")
                many = high - low
                rows, low, many = rows[many > 0], low[many > 0], many[many > 0]
                if len(rows):
                    each = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    items.append(owners[each])
                    begins.append(np.repeat(starts[rows], many) - offsets[each])
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(items), np.concatenate(begins)]), axis=1)
        return pairs[0], pairs[1]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, word after the last) of the best match of each found pair."""
        lists = []
        for text in texts:
            words = text.split()
            numbers = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
            lists.append(numbers[numbers >= 0])
        gap = np.zeros(1, np.int64)
        bounds = np.cumsum([0, *(len(x) + 1 for x in lists)])
        symbols = np.concatenate([y for x in lists for y in (x, gap)]) if lists else gap
        items, begins = self.candidates(symbols)
        if not len(items):
            return
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        order = np.lexsort((begins, items))
        items, begins = items[order], begins[order]
        # the window's begin is off by an edit each at most, and it may lie before the text
        middles = np.maximum(begins, 0) + np.array([len(x) // 2 for x in self.items], np.int64)[items]
        middles = np.clip(np.searchsorted(bounds, middles, "right") - 1, 0, len(texts) - 1)
        firsts = np.maximum(np.searchsorted(bounds, np.maximum(begins, 0), "right") - 1, 0)
        for item, begin, *owners in zip(items.tolist(), begins.tolist(), middles.tolist(), firsts.tolist()):
            pattern = self.items[item]
            n, k = len(pattern), self.allowed(len(pattern))
            for owner in set(owners):
                if owner >= len(texts):
                    continue
                low = max(begin - 2 * k, int(bounds[owner]))
                high = min(begin + n + 2 * k, int(bounds[owner + 1]) - 1)
                if high - low < n - k or done.get((owner, item), -1) >= high:
                    continue
                done[owner, item] = high
                region = symbols[low:high].tolist()
                # each distinct word of the item that the region lacks is an edit of its own
                if len(self.distinct[item].difference(region)) > k:
                    continue
                scores = edit_distance(pattern, region)
                least = min(scores)
                if least <= k:
                    end = scores.index(least) + 1
                    back = edit_distance(pattern[::-1], region[:end][::-1], anchored=True)
                    first = end - (back.index(least) + 1)
                    found = (least, low - int(bounds[owner]) + first, low - int(bounds[owner]) + end)
                    if (owner, item) not in best or found < best[owner, item]:
                        best[owner, item] = found
        for (owner, item), (edits, first, end) in sorted(best.items()):
            yield owner, item, edits, first, end


_SCHEMA = "item_key string, n_words int, edits int, first_word long, end_word long"


def _find(docs: DataFrame, items: list[tuple[str, str]], settings: Settings) -> DataFrame:
    lengths = [n for n in (len(item_words(text)) for _, text in items) if n >= settings.min_words]
    plan = planned(lengths, settings)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    name = hashlib.sha256(repr((sorted(items), settings)).encode()).hexdigest()
    kind = dict(docs.dtypes)["doc_id"]
    fields = pa.schema(
        [("item_key", pa.string()), ("n_words", pa.int32()), ("edits", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept("decontamination", name, lambda: Index(shared.value, settings, plan))
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                found = list(index.matches([x or "" for x in part.column(1).to_pylist()]))
                if not found:
                    continue
                owners, own_items, edits, first, end = map(list, zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owners, pa.int64())),
                        pa.array([index.names[i] for i in own_items], pa.string()),
                        pa.array([len(index.items[i]) for i in own_items], pa.int32()),
                        pa.array(edits, pa.int32()),
                        pa.array(first, pa.int64()),
                        pa.array(end, pa.int64()),
                    ],
                    names=["doc_id", *fields.names],
                )

    return map_arrow(docs, find, f"doc_id {kind}, {_SCHEMA}")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words``, ``edits``, ``first_word`` and ``end_word`` of every document
    and item whose best stretch of words is within ``settings.edits`` of the item's words.

    Words are runs without white space, without marks at their ends and in lower case; runs of marks
    alone don't count. Of several matches of one item the one with the fewest edits, then the first,
    is given. Null and empty texts match nothing and are matched by nothing; an item of fewer words
    than ``settings.min_words`` too (``unsearched_items`` lists them). Items with equal texts are searched once and all reported; null
    item ids stay null; each of several equal documents gets its rows. Benchmarks of any size are
    searched in blocks of ``settings.block_bytes`` of text, each in one pass without a shuffle.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    named = benchmark.select("item_id", F.md5(F.col("text")).alias("item_key"), F.col("text").alias("item_text"))
    named = named.where("item_text is not null")
    texts = named.select("item_key", "item_text").distinct()
    size = texts.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-size // settings.block_bytes))
    out = None
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == block)
        items = [(r["item_key"], r["item_text"]) for r in mine.collect()]
        found = _find(rows, items, settings)
        out = found if out is None else out.unionAll(found)
    return out.join(named.select("item_id", "item_key"), "item_key").select(
        "doc_id", "item_id", "n_words", "edits", "first_word", "end_word"
    )


def unsearched_items(benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id`` and ``n_words`` of the items that ``find_leaks`` leaves out: those of fewer words
    than ``settings.min_words``, null and empty texts (0 words) among them."""
    kind = dict(benchmark.dtypes)["item_id"]
    least = settings.min_words

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([len(item_words(text or "")) for text in batch.column(1).to_pylist()], pa.int64())
            found = pa.RecordBatch.from_arrays([batch.column(0), words], names=["item_id", "n_words"])
            yield found.filter(pc.less(words, least))

    return map_arrow(benchmark.select("item_id", "text"), short, f"item_id {kind}, n_words long")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without any leak; all columns pass through. A null id that leaks goes with all
    rows of null id that hold the same text."""
    id_, row = fresh(docs, "_id"), fresh(docs, "_row")
    marked = docs.withColumn(row, F.xxhash64(F.col(key), F.col(text)))
    leaks = find_leaks(
        marked.select(F.col(row).alias(id_), F.col(text).alias("text")), benchmark, settings, key=id_, text="text"
    )
    return marked.join(leaks.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)
