r"""Fill-in-the-middle: texts cut into prefix, middle and suffix at line borders, and put in a new order.

``regexp_count`` gives the number n of units (lines with their break). Two numbers hashed from the id
say after which units to cut, and a pattern of each row's own, with possessive groups ``unit{a}`` and
``unit{b-a}``, captures all three parts in one match, which the replacement writes in the new order.
SQL functions only, one narrow pass.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: A line with its break, or the rest of a text without one.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _numbers(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the id; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, rate: int = 100, suffix_first: int = 50, seed: int = 7, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every text.

    ``rate`` per cent of the ids are transformed, and of those ``suffix_first`` per cent get the form
    ``spm`` (suffix, prefix, middle), the others ``psm``. A text that is empty or holds a mark is
    ``plain`` and stays as it is, without lengths. A null text counts as the empty one; null ids,
    repeated rows and empty tables pass through; other columns are not read.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = own.withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    first, second, third, fourth = _numbers(F.col("doc_id"), seed)
    one, two = first % (F.col("n") + 1), second % (F.col("n") + 1)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(mark))
    plain = (F.col("_text") == "") | marked | (third % 100 >= rate)
    form = F.when(plain, "plain").when(fourth % 100 < suffix_first, "spm").otherwise("psm")
    placed = own.withColumns({"_a": F.least(one, two), "_b": F.greatest(one, two), "form": form})
    pattern = F.format_string(f"(?s)\\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\\z", F.col("_a"), F.col("_b") - F.col("_a"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    moved = F.regexp_replace("_text", pattern, order)
    done = placed.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(moved))
    prefix, middle, _ = spans(F.col("output"), F.col("form"))
    return done.select(
        "doc_id",
        "n",
        "form",
        prefix[1].cast("long").alias("prefix_chars"),
        middle[1].cast("long").alias("middle_chars"),
        "output",
    )


def spans(output: Column, form: Column) -> tuple[tuple[Column, Column], ...]:
    """(begin, length) in code points of prefix, middle and suffix in an output; null if it is plain.

    The marks are not in the text, and no mark begins as another ends, so their first places are theirs.
    """
    at = {mark: F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE)}
    moved, suffix_first = form != "plain", form == "spm"

    def part(mark: str, end: Column) -> tuple[Column, Column]:
        begin = at[mark] + len(mark)
        return F.when(moved, begin), F.when(moved, end - begin)

    return (
        part(PREFIX, F.when(suffix_first, at[MIDDLE]).otherwise(at[SUFFIX])),
        part(MIDDLE, F.length(output) + 1),
        part(SUFFIX, F.when(suffix_first, at[PREFIX]).otherwise(at[MIDDLE])),
    )


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form alone; null for a null output."""
    pieces = [F.substring(output, *span) for span in spans(output, form)]
    return F.when(form == "plain", output).otherwise(F.concat(*pieces))


def middle_digest(filled: DataFrame) -> DataFrame:
    """Lengths and checksums of the output and of the text restored from it."""
    return filled.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
