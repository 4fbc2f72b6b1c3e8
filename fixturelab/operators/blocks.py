"""Ordered state over long sequences, cut into blocks so that no key lands in one task.

A league, a team or a pair of teams may own a large part of all rows, so no window here is
partitioned by such a key alone. Three shapes cover the features:

* frames of bounded reach: ``with_halo`` copies the last ``reach`` positions of a block into the
  next one; windows inside a block then see everything they need;
* running sums over all history: ``running_sums`` adds the totals of the earlier blocks;
* last-n over all history: ``recent_rows`` adds the last n rows of the earlier blocks.

The tables carried between blocks hold one row (or n rows) per key and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Matches that one task of a windowed state takes at a time, whatever their number in all.
TASK_ROWS = 50_000


def dense_position(df: DataFrame, part: Sequence[str], coarse: str, keys: Sequence[str], out: str,
                   splits: int = 8, low_high: DataFrame | None = None) -> DataFrame:
    """0-based dense position of each row in ``part``, ordered by ``coarse`` and then ``keys``.

    Rows are numbered inside (part, coarse, range of the first key) cells and shifted by the counts
    of the earlier cells. Only the cell counts, bounded by the distinct ``coarse`` values times
    ``splits``, pass through a window per part. The first key must be numeric and not null;
    ``low_high`` may give its range (columns ``_lo``, ``_hi``) where that is cheaper to read elsewhere.
    """
    lead = keys[0]
    if low_high is None:
        low_high = df.agg(F.min(lead).alias("_lo"), F.max(lead).alias("_hi"))
    cell = F.floor((F.col(lead) - F.col("_lo")) * F.lit(float(splits)) / (F.col("_hi") - F.col("_lo") + F.lit(1)))
    tagged = df.crossJoin(F.broadcast(low_high)).withColumn("_cell", cell).drop("_lo", "_hi")
    cell_keys = [*part, coarse, "_cell"]
    before = W.partitionBy(*part).orderBy(coarse, "_cell").rowsBetween(W.unboundedPreceding, -1)
    counts = (
        tagged.groupBy(*cell_keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*cell_keys).orderBy(*keys)
    return (
        tagged.withColumn("_i", F.row_number().over(inside))
        .join(counts, cell_keys)
        .withColumn(out, (F.col("_offset") + F.col("_i") - 1).cast("long"))
        .drop("_cell", "_offset", "_i")
    )


def with_halo(df: DataFrame, pos: str, size: int, reach: int, block: str = "block", halo: str = "halo") -> DataFrame:
    """Tag rows with their block of ``size`` positions and copy the last ``reach`` ones into the next."""
    own = F.floor(F.col(pos) / F.lit(size))
    last = F.floor((F.col(pos) + F.lit(reach)) / F.lit(size))
    return df.withColumn(block, F.explode(F.sequence(own, last))).withColumn(halo, F.col(block) != own)


def block_of(pos: str | Column, size: int) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(size))


def tasks_for(rows: int, least: int = 1) -> int:
    """Number of tasks for so many matches: ``TASK_ROWS`` each, or ``least`` where one block holds more."""
    return max(1, -(-rows // max(TASK_ROWS, least)))


def team_blocks(matches: DataFrame, per_team: int, least: int = 4096) -> int:
    """Rows of a block that holds ``per_team`` matches for each home team of the largest league.

    A block leaves one row, or a few, for each of its teams; with as many teams as matches these would
    be as many as the matches themselves. So blocks grow with the number of teams (no result depends on it).
    """
    teams = matches.groupBy("league").agg(F.approx_count_distinct("home").alias("_n")).agg(F.max("_n")).first()[0]
    return max(least, per_team * (teams or 0))


def earlier_rows(cell: Sequence[str], order: Sequence[str], day: str | None = None) -> W:
    """Frame of the rows before the current one, or of the days before its day."""
    if day is not None:
        return W.partitionBy(*cell).orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    return W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str,
                 sums: dict[str, Column], day: str | None = None) -> DataFrame:
    """Sums over all strictly earlier rows of the key, zero where there are none.

    ``block`` must not decrease along ``order``. With ``day`` (a day number that no block splits)
    rows of the same day do not see each other.
    """
    names = list(sums)
    df = df.select("*", *[sums[n].alias(f"_v_{n}") for n in names])
    cell = [*keys, block]
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carry = df.groupBy(*cell).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    carry = carry.select(*cell, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in names])
    inside = earlier_rows(cell, order, day)
    df = df.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in names])
    df = df.join(carry, cell)
    for n in names:
        df = df.withColumn(n, F.col(f"_i_{n}") + F.col(f"_c_{n}"))
    return df.drop(*[f"_{p}_{n}" for p in "vic" for n in names])


def dealt_by_cell(df: DataFrame, cell: Sequence[str], payload: Column, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with the payload as ``_p``, dealt by cell, and the names of the columns that are found in ``_p`` alone.

    A column that is a field of the payload travels once. What a block leaves to later ones is made
    from the payload too; if it holds all columns, both are read from one shuffle. Rows without a cell,
    which meet no other, are left out before it and not in one of the two alone.
    """
    for c in cell:
        df = df.where(F.col(c).isNotNull())
    df = df.withColumn("_p", payload)
    kind = df.schema["_p"].dataType
    fields = kind.names if isinstance(kind, StructType) else []
    held = [c for c in df.columns if c in fields and c not in (*cell, *keep)]
    return df.drop(*held).repartition(*cell), held


def recent_rows(df: DataFrame, keys: Sequence[str], order: str, block: str, n: int, payload: Column,
                out: str, day: str | None = None) -> DataFrame:
    """``array`` of the payloads of the last ``n`` strictly earlier rows of the key, oldest first.

    ``day`` as in :func:`running_sums`. Fields of the payload that are named like a column must hold it.
    """
    cell, names = [*keys, block], df.columns
    df, held = dealt_by_cell(df, cell, payload, [order, *([day] if day else [])])
    back = W.partitionBy(*cell).orderBy(F.desc(order))
    tails = df.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= n).select(*cell, order, "_p")
    along = W.partitionBy(*keys).orderBy(order)
    first = W.partitionBy(*cell).orderBy(order)
    carry = (
        tails.withColumn("_carry", F.collect_list("_p").over(along.rowsBetween(-n, -1)))
        .withColumn("_k", F.row_number().over(first))
        .where(F.col("_k") == 1)
        .select(*cell, "_carry")
    )
    merged = F.concat(F.col("_carry"), F.coalesce(F.col("_own"), F.filter(F.array("_p"), lambda x: F.lit(False))))
    if day is None:
        df = df.withColumn("_own", F.collect_list("_p").over(first.rowsBetween(-n, -1)))
    else:
        # the list left by the last row of the days before
        df = df.withColumn("_incl", F.struct(F.col(order).alias("o"), F.collect_list("_p").over(first.rowsBetween(1 - n, 0)).alias("l")))
        df = df.withColumn("_own", F.max("_incl").over(earlier_rows(cell, [order], day))["l"]).drop("_incl")
    return (
        df.join(carry, cell)
        .withColumn(out, F.slice(merged, F.greatest(F.size(merged) - F.lit(n - 1), F.lit(1)), n))
        .select(*[F.col("_p")[c].alias(c) if c in held else c for c in names], out)
    )
