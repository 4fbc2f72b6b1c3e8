"""Line dedup: lines that several documents share stay in one of them.

Lines are exploded with their positions, normalised and hashed (128 bits). One aggregate counts the
documents of every hash; lines of a shared hash go from all documents but the smallest id that holds
it; the rest is put together again by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from fixturelab.llm.common import NULL_ID, SPACES, fresh, map_arrow, slices, written

#: A hash with more than this share of all hashed lines is hot; there are at most 1 / share of them.
HOT_SHARE = 1e-4

_STRIP = SPACES.encode()


def line_keys(text: str, least: int) -> tuple[list[int], list[bytes]]:
    """Positions and hashes of the lines whose key has ``least`` code points or more."""
    positions, hashes, digest = [], [], xxhash.xxh3_128_digest
    for at, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(_STRIP).lower()  # bytes.lower() changes A-Z only
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            positions.append(at)
            hashes.append(digest(key))
    return positions, hashes


def explode_lines(docs: DataFrame, least: int) -> DataFrame:
    """One row a line: ``id``, ``row`` (hash of the text), ``at`` and the two halves of the key's hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                counts, positions, hashes = [], [], []
                for text in part.column(2).to_pylist():
                    at, keys = line_keys(text or "", least)
                    counts.append(len(at))
                    positions += at
                    hashes += keys
                halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                owner = np.repeat(np.arange(part.num_rows), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)),
                        part.column(1).take(pa.array(owner)),
                        pa.array(np.array(positions, np.int32)),
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                    ],
                    names=["id", "row", "at", "h1", "h2"],
                )

    return map_arrow(docs, explode, "id long, row long, at int, h1 long, h2 long")


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes that ``min_docs`` documents or more hold, with the smallest id and the number of lines.

    Counting documents needs one row for each pair of hash and document; for two documents the
    smallest and largest ids decide, and the aggregate needs no such pairs.
    """
    if min_docs == 2:
        counted = lines.groupBy("h1", "h2").agg(
            F.min("id").alias("keeper"), F.max("id").alias("last"), F.count("*").alias("n")
        )
        return counted.where("keeper < last").select("h1", "h2", "keeper", "n")
    pairs = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
    counted = pairs.groupBy("h1", "h2").agg(
        F.min("id").alias("keeper"), F.count("*").alias("docs"), F.sum("n").alias("n")
    )
    return counted.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper", "n")


def dropped_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    """``id``, ``row`` and the sorted positions to drop, for the documents that lose a line.

    Hot hashes (at most 1 / HOT_SHARE, so of bounded size) meet the lines by broadcast; the others
    by a shuffle in which no hash holds more than that share of the rows.
    """
    shared = written(shared_lines(lines, min_docs), "shared-lines")
    total = shared.agg(F.sum("n")).first()[0] or 0
    bar = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(shared.where(F.col("n") > bar).select("h1", "h2", F.col("keeper").alias("hot_keeper")))
    rest = shared.where(F.col("n") <= bar).select("h1", "h2", "keeper")
    marked = lines.join(hot, ["h1", "h2"], "left")
    known = marked.where(F.col("hot_keeper").isNotNull() & (F.col("hot_keeper") != F.col("id")))
    others = marked.where(F.col("hot_keeper").isNull()).join(rest, ["h1", "h2"]).where("keeper != id")
    gone = known.select("id", "row", "at").unionAll(others.select("id", "row", "at"))
    return gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def drop_lines(texts: pa.Array, gone: pa.Array) -> tuple[list[str], list[int], list[int]]:
    kept, lines, dropped = [], [], []
    for text, positions in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        own = (text or "").split("\n")
        lines.append(len(own))
        if positions:
            out = set(positions)
            kept.append("\n".join(x for i, x in enumerate(own) if i not in out))
        else:
            kept.append(text or "")
        dropped.append(len(positions or ()))
    return kept, lines, dropped


def dedup_lines(
    docs: DataFrame, min_docs: int = 2, least: int = 10, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with shared lines removed, and two more columns, ``n_lines`` and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z in lower case. All lines with a key
    of ``least`` code points or more that ``min_docs`` documents hold go, except from the smallest id.
    A null text counts as one empty line and becomes the empty text. All rows with one id are one
    document; null ids are one document after all others. Every row stays, repeated rows too; a
    column of the input named like an added one is replaced.
    """
    id_, row, gone = fresh(docs, "_id"), fresh(docs, "_row"), fresh(docs, "_gone")
    plain = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.xxhash64(F.col(text)).alias("row"),
        F.col(text).alias("text"),
    )
    drops = dropped_positions(explode_lines(plain, least), min_docs)
    joined = (
        docs.withColumns(
            {id_: F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), row: F.xxhash64(F.col(text))}
        )
        .join(drops.select(F.col("id").alias(id_), F.col("row").alias(row), F.col("gone").alias(gone)), [id_, row], "left")
    )
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = joined.select(*[F.col(f"`{c}`") for c in own], gone)
    at = own.index(text)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                kept, lines, dropped = drop_lines(part.column(at), part.column(len(own)))
                columns = [part.column(i) for i in range(len(own))]
                columns[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                    names=[*own, "n_lines", "n_dropped"],
                )

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return map_arrow(rows, rebuild, f"{fields}, n_lines long, n_dropped long")


def line_digest(deduped: DataFrame, key: str = "doc_id") -> DataFrame:
    return deduped.select(
        F.col(key).alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )
