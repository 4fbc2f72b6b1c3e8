"""Quality rules: counts of words, marks and repeats, and a hashed n-gram likelihood ratio.

The ratio compares two smoothed multinomials over hashed words and word pairs: one counted on trusted
documents, one on the whole corpus. A document's score is its mean log ratio for each n-gram; the
threshold is a low quantile of the scores of trusted documents that the counts have not seen.
DataFrame and SQL functions only. Only texts whose id is probably trusted, by a bitmap of fixed size,
meet the labels by shuffle, once; all others are counted where they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from fixturelab.llm.common import written

#: Characters counted as symbols (fixed by the rule).
SYMBOLS = "#*$%&|<>"

#: The text without nulls, its separators turned to spaces, its words and its lines with a word.
_SEPARATORS = r"\t\n\u000B\u000C\r"
_PLAIN = f"translate(_text, '{_SEPARATORS}', '     ')"
_WORDS = f"filter(split({_PLAIN}, ' '), x -> x != '')"
_GRAMS = (
    "concat(transform(w, x -> pmod(xxhash64(x), {b})),"
    " if(size(w) < 2, array(), zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1),"
    " (x, y) -> pmod(xxhash64(x, y), {b}))))"
)
#: Hashes of the windows of three words, by position.
_WINDOWS = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
#: Hashes that stand more than once in a sorted array.
_TWICE = (
    "transform(array(sort_array(h)), s -> array_distinct(filter(zip_with(slice(s, 1, size(s) - 1),"
    " slice(s, 2, size(s) - 1), (x, y) -> if(x = y, x, null)), x -> x is not null)))[0]"
)
#: Begins of repeated windows: by lookup where few repeat, else by sorting hashes with positions.
_FEW = 8
_BY_LOOKUP = "filter(sequence(0, size(h) - 1), i -> array_contains(r, h[i]))"
_BY_SORT = (
    "transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), p ->"
    " sort_array(transform(filter(p, (x, k) -> (k > 0 and p[greatest(k - 1, 0)].h = x.h) or"
    " (k < size(p) - 1 and p[least(k + 1, size(p) - 1)].h = x.h)), x -> x.i)))[0]"
)
#: Words under any repeated window: each begin adds three, or less if the next begin is nearer.
_COVERED = "aggregate(zip_with(b, slice(b, 2, size(b)), (x, y) -> least(3, coalesce(y - x, 3))), 0, (a, x) -> a + x)"


def _bind(name: str, value: str, body: str) -> str:
    """SQL for ``let name = value in body``: the value is computed once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


_BEGINS = f"if(size(r) = 0, array(), if(size(r) <= {_FEW}, {_BY_LOOKUP}, {_BY_SORT}))"
_REPEATED = (
    "if(size(w) < 4, 0, "
    + _bind("h", _WINDOWS, _bind("r", _TWICE, _bind("b", _BEGINS, f"if(size(b) = 0, 0, {_COVERED})")))
    + ")"
)
_DUPLICATES = _bind(
    "l",
    f"filter(split(_text, '\\n'), x -> btrim(x, ' {_SEPARATORS}') != '')",
    "size(l) - size(array_distinct(l))",
)


@dataclass(frozen=True)
class Settings:
    """``unseen``: one of so many trusted documents (by a hash of the id) is for the threshold;
    ``id_bits``: size of the bitmap of trusted ids, and so of what is broadcast (8 MB); ``salts``: parts
    into which the rows of one id are dealt when they meet its label."""

    buckets: int = 1 << 16
    unseen: int = 4
    id_bits: int = 1 << 26
    salts: int = 16
    smoothing: float = 1.0
    false_rejects: float = 0.005


def _plain(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))


def base_columns(text: Column) -> dict[str, Column]:
    """The counts of the rules, from a column ``_text`` without nulls."""
    spaces = f" {_SEPARATORS}"
    return {
        "word_chars": F.expr(f"cast(length(translate(_text, '{spaces}', '')) as bigint)"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.expr(f"cast({_DUPLICATES} as bigint)"),
    }


def gram_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """``bucket``, ``n`` of all words and word pairs, and ``target`` of those in rows with a true ``fit``;
    counted in each task before the shuffle."""
    grams = _bind("w", _WORDS, _GRAMS.format(b=settings.buckets))
    return (
        docs.select("fit", F.explode(F.expr(grams)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count_if("fit").alias("target"))
    )


def _tables(counts: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Dense counts of the trusted documents and of the corpus."""
    rows = counts.toPandas()  # at most settings.buckets rows
    target, corpus = np.zeros(settings.buckets), np.zeros(settings.buckets)
    target[rows["bucket"].to_numpy(np.int64)] = rows["target"].to_numpy(np.float64)
    corpus[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return target, corpus


def log_ratios(trusted: np.ndarray, corpus: np.ndarray, smoothing: float) -> np.ndarray:
    """Log of the smoothed share among trusted documents over that in the corpus, by bucket."""

    def share(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + smoothing) / (counts.sum() + smoothing * len(counts)))

    return share(trusted) - share(corpus)


def trusted_ids(labels: DataFrame, settings: Settings) -> DataFrame:
    """``id`` and ``fit`` (true: for the counts; false: for the threshold) of all trusted documents."""
    return (
        labels.where("quality = 1 and doc_id is not null")
        .select(F.col("doc_id").alias("id"))
        .distinct()
        .select("id", (F.pmod(F.xxhash64("id"), F.lit(settings.unseen)) != 0).alias("fit"))
    )


def with_grams(docs: DataFrame, settings: Settings, repeats: bool) -> DataFrame:
    """The documents (with ``_text``) and ``_m``: number of words, hashed grams and, if asked, repeated words."""
    counted = f"'r', {_REPEATED}, " if repeats else ""
    return docs.withColumn(
        "_m", F.expr(_bind("w", _WORDS, f"named_struct('n', size(w), {counted}'g', {_GRAMS.format(b=settings.buckets)})"))
    )


def mean_ratio(ratios: np.ndarray) -> Column:
    """Mean of the log ratios of ``_m.g``, 0 without grams."""
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    total = F.aggregate("_m.g", F.lit(0.0), lambda sum_, b: sum_ + F.get(table, b.cast("int")))
    return total / F.greatest(F.size("_m.g"), F.lit(1))


def scored(docs: DataFrame, ratios: np.ndarray, settings: Settings) -> DataFrame:
    """The documents (with ``_text``) and their word counts, repeats and mean log ratio."""
    return with_grams(docs, settings, repeats=True).withColumns(
        {
            "n_words": F.col("_m.n").cast("long"),
            "n_repeat_words": F.col("_m.r").cast("long"),
            "log_ratio": mean_ratio(ratios),
        }
    ).drop("_m")


#: Bits of one bitmap row (fixed by ``bitmap_construct_agg``).
_ROW_BITS = 32_768


def probably_trusted(rows: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """The rows with ``_maybe``: false only if the id is not in ``ids``.

    One bit for each hash of an id: ``id_bits`` bits in all, whatever the number of ids; more ids only
    make more rows that turn out to have no label.
    """

    def place(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(settings.id_bits))

    bitmaps = ids.select(place("id").alias("p")).groupBy(F.expr(f"p div {_ROW_BITS}").alias("_row")).agg(
        F.bitmap_construct_agg(F.col("p") % _ROW_BITS).alias("_bits")
    )
    at = rows.withColumn("_p", place("doc_id")).withColumn("_row", F.expr(f"_p div {_ROW_BITS}"))
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast((_p % {_ROW_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(_p % 8 as int)")
    found = F.col("doc_id").isNotNull() & F.col("_bits").isNotNull() & (F.get(F.array(*[byte.bitwiseAND(1 << i) for i in range(8)]), bit) > 0)
    return at.join(F.broadcast(bitmaps), "_row", "left").select(*rows.columns, found.alias("_maybe"))


def with_labels(rows: DataFrame, ids: DataFrame, settings: Settings) -> DataFrame:
    """``_text`` and ``fit`` (null: no trusted id) of the rows, by one shuffle at every size; the rows of
    one id are dealt to ``salts`` tasks."""
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(settings.salts)))
    every = F.explode(F.expr(f"sequence(0L, {settings.salts - 1}L)"))
    known = ids.select(F.col("id").alias("doc_id"), "fit", every.alias("_salt"))
    return dealt.join(known.hint("merge"), ["doc_id", "_salt"], "left").select("_text", "fit")


def low_value(values: DataFrame, name: str, share: float, bins: int = 1024) -> float | None:
    """The value at rank floor(share x (n - 1)) of a column without nulls, exactly; null without rows."""
    return value_at(values, name, lambda n: int(share * (n - 1)), bins)


def value_at(values: DataFrame, name: str, rank_of: Callable[[int], int], bins: int = 1024) -> float | None:
    """The value at the rank (from 0) that ``rank_of`` gives for n rows, exactly; null without rows.

    A histogram of ``bins`` bins shows the bin of that rank, and the next pass looks at the range of
    its values only, until one value or at most ``bins`` rows are left.
    """
    x = F.col(name)
    low, high, left = values.agg(F.min(x), F.max(x), F.count("*")).first()
    if not left:
        return None
    rank = rank_of(left)
    while low < high:
        inside = values.where(x.between(low, high))
        if left <= bins:
            return sorted(r[0] for r in inside.select(x).collect())[rank]
        place = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("bin")
        rows = sorted(inside.groupBy(place).agg(F.count("*"), F.min(x), F.max(x)).collect())
        for _, left, low, high in rows:
            if rank < left:
                break
            rank -= left
    return low


def judge_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts, score and verdict of every whole text: ``doc_id``, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``log_ratio``, ``threshold``, ``base_failed``
    and ``kept``.

    A null text has no words and fails the base rule, as an empty one does. Without trusted
    documents every ratio is 0 and only the base rule rejects. Null ids, repeated rows and empty
    tables pass through; labels whose id or quality is null are not used; other columns are not read.
    Windows of three words are compared by 64-bit hashes within one text.
    """
    rows = _plain(docs.select("doc_id", "text"), "text").select("doc_id", "_text")
    chosen = written(trusted_ids(labels, settings), "trusted-ids")
    sorted_out = probably_trusted(rows, chosen, settings)
    met = written(with_labels(sorted_out.where("_maybe").drop("_maybe"), chosen, settings), "trusted-texts")
    others = sorted_out.where("not _maybe").select("_text", F.lit(False).alias("fit"))
    counts = gram_counts(others.unionAll(met.select("_text", F.coalesce("fit", F.lit(False)).alias("fit"))), settings)
    target, corpus = _tables(counts, settings)
    ratios = log_ratios(target, corpus, settings.smoothing) if target.sum() else np.zeros(settings.buckets)
    # read from the written table, so that no text but those for the threshold is looked at
    unseen = with_grams(met.where("not fit"), settings, repeats=False).where("_m.n >= 50")
    cut = low_value(written(unseen.select(mean_ratio(ratios).alias("log_ratio")), "unseen-scores"), "log_ratio", settings.false_rejects)
    threshold = F.lit(cut if cut is not None and target.sum() else float("-inf"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        scored(rows.withColumns(base_columns(F.col("_text"))), ratios, settings)
        .withColumn("base_failed", failed)
        .withColumn("threshold", threshold)
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.col("threshold")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio",
            "threshold", "base_failed", "kept",
        )
    )
