"""Spelling variant groups: words one edit apart, found over a reduced alphabet.

Every letter is hashed to one of a few symbols. Two words one edit apart have reduced words that are
equal or one edit apart, so the full one-edit neighbourhood of each distinct reduced word is generated
and joined with the reduced vocabulary; the words behind each meeting pair are then verified on their
letters. Corpus counts are summed in each task before any shuffle, and only distinct words go on.
"""

from __future__ import annotations

import zlib

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from fixturelab.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word once A-Z are lower-cased.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Longest word whose neighbourhood is generated; longer words are looked up by their halves.
LONGEST = 48


def symbol_table(symbols: int) -> str:
    """The symbol of each of ``LETTERS``: a digit-like character chosen by a hash of the letter."""
    return "".join(chr(ord("A") + zlib.crc32(f"letter {x}".encode()) % symbols) for x in LETTERS)


def reduced(word: Column, symbols: int) -> Column:
    return F.translate(word, LETTERS, symbol_table(symbols))


def neighbourhood(name: str, symbols: int) -> Column:
    """All strings at most one edit from the reduced word in column ``name``, itself included, each once."""
    letters = ", ".join(f"'{chr(ord('A') + i)}'" for i in range(symbols))
    head, tail = f"left({name}, i)", f"substr({name}, i + 1)"
    cut = f"transform(sequence(1, length({name})), i -> concat(left({name}, i - 1), substr({name}, i + 1)))"
    put = f"flatten(transform(sequence(0, length({name})), i -> transform(array({letters}), s -> concat({head}, s, {tail}))))"
    swap = (
        f"flatten(transform(sequence(1, length({name})), i -> transform(array({letters}), "
        f"s -> concat(left({name}, i - 1), s, substr({name}, i + 1)))))"
    )
    # swapping a symbol for itself gives the word itself
    return F.expr(f"array_distinct(concat({cut}, {put}, {swap}))")


def word_counts(
    docs: DataFrame, typo_every: int = 97, shortest: int = 5, least: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``word`` and ``n``: all words of at least ``shortest`` code points with ``least`` occurrences.

    Words are maximal letter runs with A-Z lower-cased. Where ``typo_every`` divides the CRC-32 of
    ``<id>:<run>``, the run loses the code point at that number modulo its length. A null id is empty.
    """
    plain = F.translate(F.col(text), UPPER, LOWER)
    runs = docs.where(F.col(text).isNotNull()).select(
        F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("_id"),
        F.explode(F.split(plain, "[^a-zÀ-ÿ]+")).alias("_run"),
    )
    hashed = runs.where("_run != ''").select("_run", F.crc32(F.concat("_id", "_run")).alias("_h"))
    typo = F.expr("concat(left(_run, cast(_h % length(_run) as int)), substr(_run, cast(_h % length(_run) as int) + 2))")
    words = hashed.select(F.when(F.col("_h") % typo_every == 0, typo).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def short_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """``word``, ``near``, ``near_n``: both directions of all pairs of words up to ``LONGEST`` letters."""
    short = words.where(F.length("word") <= LONGEST).select("word", "n", reduced(F.col("word"), symbols).alias("r"))
    vocabulary = short.select("r").distinct()
    around = vocabulary.select("r", F.explode(neighbourhood("r", symbols)).alias("q"))
    meeting = around.join(vocabulary.select(F.col("r").alias("q")), "q", "left_semi")
    mine = meeting.join(short.select("r", "word"), "r").select("q", "word")
    other = short.select(F.col("r").alias("q"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # the edit test is part of the join, so rows that fail it are never made
    return mine.join(other, (mine["q"] == other["q"]) & _one_edit("word", "near")).select("word", "near", "near_n")


def long_pairs(words: DataFrame) -> DataFrame:
    """The same of pairs with a word above ``LONGEST`` letters: one edit leaves the first or the last
    half of the shorter length as it is."""
    long = words.where(F.length("word") >= LONGEST)
    keys = long.select(
        "word",
        "n",
        F.explode(F.expr("array(length(word), length(word) - 1)")).alias("m"),
    ).select(
        "word",
        "n",
        "m",
        F.explode(
            F.expr("array(struct('first' as side, left(word, m div 2) as half), struct('last' as side, right(word, m div 2) as half))")
        ).alias("k"),
    )
    keys = keys.select("word", "n", "m", F.col("k.side").alias("side"), F.xxhash64("k.side", "m", "k.half").alias("h"))
    other = keys.select("h", "m", "side", F.col("word").alias("near"), F.col("n").alias("near_n"))
    mine = keys.select("h", "m", "side", "word")
    same_first = F.expr("left(word, m div 2) = left(near, m div 2)")
    shorter = F.least(F.length("word"), F.length("near")) == F.col("m")
    once = (F.col("side") == "first") | ~same_first
    over = F.greatest(F.length("word"), F.length("near")) > LONGEST
    return mine.join(other, ["h", "m", "side"]).where(shorter & over & once & _one_edit("word", "near")).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words with a ``form``: links are doubled until none goes further.

    A form has at least twice the occurrences of its word, so links hold no circle, and the rounds are
    the logarithm of the longest chain, which itself is at most the logarithm of the largest count.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        links = written(stepped, "spelling-links")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def spelling_groups(
    docs: DataFrame,
    symbols: int = 6,
    typo_every: int = 97,
    shortest: int = 5,
    least: int = 3,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the one
    with the most occurrences (ties: smallest by code points) if it has at least twice those of the
    word, else null; ``root`` is where the forms end, the word itself without one. Null and empty
    texts have no words, a null id is written as nothing, repeated rows count again, an empty table
    has no words, and other columns are not read. ``symbols`` changes only the work, not the result.
    """
    words = written(word_counts(docs, typo_every, shortest, least, key, text), "spelling-words")
    pairs = short_pairs(words, symbols).unionAll(long_pairs(words))
    about = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    strong = -F.col("best.less") >= 2 * F.col("n")
    named = words.join(about, "word", "left").select(
        "word",
        F.when(strong, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    named = written(named, "spelling-forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
