"""URL filter: host and path rules first, a ratio of character language models for the rest.

Two variable-order Markov models, one of the URLs that rules allow and one of those they block, give
each character a probability: the longest context seen decides, smoothed by the shorter ones. A URL
without a rule is accepted if the difference of log-likelihoods for each character reaches a bar that
is calibrated on URLs with a rule which the models have not seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from fixturelab.llm.common import kept, map_arrow, slices

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
Rule = tuple[str, str, str]


@dataclass(frozen=True)
class Settings:
    """``order``: longest context; ``buckets``: hashed contexts of each order and class (this bounds
    the models); ``holdout``: one URL in so many calibrates; ``bins``: grid of the bar; ``chunk``: bytes
    looked at together, which bounds the memory of a task whatever the length of a URL."""

    order: int = 4
    buckets: int = 1 << 18
    discount: float = 0.75
    holdout: int = 5
    bins: int = 2001
    span: float = 4.0
    chunk: int = 1 << 17


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    found = F.instr(text, "://")
    rest = F.when(found > 0, F.substring(text, found + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together) and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@dataclass
class Chunk:
    """Bytes of some URLs in a row: ``owner`` and length of each part, how many of its first bytes only
    give context to the rest, and the place of its first byte in the URL."""

    flat: bytes
    owners: list[int]
    sizes: list[int]
    leads: list[int]
    starts: list[int]


def chunks(urls: list[str], settings: Settings) -> Iterator[Chunk]:
    """The bytes of all URLs, an end mark after each, in chunks of about ``settings.chunk`` bytes.

    A URL may go through several chunks; each part but the first repeats the bytes its contexts need.
    """
    parts: list[tuple[bytes, int, int, int]] = []
    held = 0
    for owner, url in enumerate(urls):
        raw = url.encode() + b"\x00"
        at = 0
        while at < len(raw):
            if held >= settings.chunk:
                yield _chunk(parts)
                parts, held = [], 0
            end = min(len(raw), at + settings.chunk - held)
            lead = min(at, settings.order)
            parts.append((raw[at - lead : end], owner, lead, at - lead))
            held += end - at
            at = end
    if parts:
        yield _chunk(parts)


def _chunk(parts: list[tuple[bytes, int, int, int]]) -> Chunk:
    raws, owners, leads, starts = map(list, zip(*parts))
    return Chunk(b"".join(raws), owners, [len(x) for x in raws], leads, starts)


def chunk_contexts(chunk: Chunk, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners of the chunk's bytes, and for each order the bucket of the context and of the context
    with the byte."""
    flat = np.frombuffer(chunk.flat, np.uint8).astype(np.uint64)
    sizes = np.array(chunk.sizes, np.int64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = inside >= np.repeat(chunk.leads, sizes)
    place = inside + np.repeat(chunk.starts, sizes)
    context = np.zeros(len(flat), np.uint64)
    before, joint = [], []
    for order in range(settings.order + 1):
        if order:
            earlier = np.full(len(flat), np.uint64(256))
            earlier[order:] = flat[:-order] if order < len(flat) else flat[:0]
            earlier[place < order] = 256  # before the begin
            context = _mix(context * np.uint64(0x9E3779B97F4A7C15) + earlier + np.uint64(1))
        seed = _mix(context + np.uint64((order + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        before.append((seed % np.uint64(settings.buckets)).astype(np.int64)[own])
        joint.append((_mix(seed + flat + np.uint64(7)) % np.uint64(settings.buckets)).astype(np.int64)[own])
    return np.repeat(chunk.owners, sizes)[own], np.array(before), np.array(joint)


def contexts(urls: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a few short URLs at once."""
    whole = Chunk(b"", [], [], [], [])
    for chunk in chunks(urls, replace(settings, chunk=1 << 62)):
        whole = chunk
    return chunk_contexts(whole, settings)


class Model:
    """Counts of one class: how often each hashed context, and context with a byte, was seen, and
    with how many distinct joint buckets a context was seen."""

    def __init__(self, settings: Settings):
        shape = settings.order + 1, settings.buckets
        self.seen, self.joint, self.kinds = (np.zeros(shape, np.float32) for _ in range(3))
        self.discount = settings.discount

    def log_likelihood(self, before: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """Of each byte: absolute discounting, from no context up to the longest."""
        share = np.full(before.shape[1], 1 / 257)
        for order in range(len(before)):
            total = self.seen[order, before[order]]
            own = np.maximum(self.joint[order, joint[order]] - self.discount, 0.0)
            freed = self.discount * self.kinds[order, before[order]]
            scale = np.maximum(np.maximum(total, 1.0), own + freed)
            share = np.where(total > 0, (own + np.maximum(freed, 1e-3) * share) / scale, share)
        return np.log(np.maximum(share, 1e-12))


def count_contexts(urls: DataFrame, settings: Settings) -> DataFrame:
    """``accepted``, ``order``, ``before`` (bucket of the context), ``joint`` (bucket of context and byte)
    and ``n``; summed in each batch and each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                accepted = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for chunk in chunks([x or "" for x in part.column(0).to_pylist()], settings):
                    yield summed(accepted, *chunk_contexts(chunk, settings))

    def summed(accepted: np.ndarray, owner: np.ndarray, before: np.ndarray, joint: np.ndarray) -> pa.RecordBatch:
        groups = []
        for order in range(settings.order + 1):
            code = (accepted[owner] * settings.buckets + before[order]) * settings.buckets + joint[order]
            values, n = np.unique(code, return_counts=True)
            groups.append((np.full(len(values), order), values, n))
        orders, codes, n = (np.concatenate(x) for x in zip(*groups))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(codes // settings.buckets // settings.buckets == 1),
                pa.array(orders.astype(np.int32)),
                pa.array(codes // settings.buckets % settings.buckets),
                pa.array(codes % settings.buckets),
                pa.array(n.astype(np.int64)),
            ],
            names=["accepted", "order", "before", "joint", "n"],
        )

    pairs = map_arrow(urls, count, "accepted boolean, order int, before long, joint long, n long")
    return pairs.groupBy("accepted", "order", "before", "joint").agg(F.sum("n").alias("n"))


def train(urls: DataFrame, settings: Settings = Settings()) -> dict[bool, Model]:
    """Models of the accepted and the other URLs (columns ``url``, ``accepted``), counted over all rows.

    What comes to the driver are sums by bucket: at most 3 x (order + 1) x buckets x 2 numbers.
    """
    summed = count_contexts(urls, settings)
    # the arrays hold one number a bucket, whatever the number of URLs
    by_context = summed.groupBy("accepted", "order", F.col("before").alias("bucket")).agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")
    )
    by_joint = summed.groupBy("accepted", "order", F.col("joint").alias("bucket")).agg(F.sum("n").alias("n"))
    models = {True: Model(settings), False: Model(settings)}
    for part, fields in ((by_context, ("seen", "kinds")), (by_joint, ("joint",))):
        rows = part.toPandas()
        for accepted, model in models.items():
            own = rows[rows["accepted"] == accepted]
            at = own["order"].to_numpy(np.int64), own["bucket"].to_numpy(np.int64)
            for field in fields:
                getattr(model, field)[at] = own["n" if field != "kinds" else "kinds"].to_numpy(np.float32)
    return models


def score_urls(rows: DataFrame, models: dict[bool, Model], settings: Settings, url: str = "url") -> DataFrame:
    """The rows with ``log_ratio``: accepted minus blocked log-likelihood, by byte; a null URL is empty."""
    packed = {
        a: {f: (np.flatnonzero(getattr(m, f)).astype(np.int32), getattr(m, f)[getattr(m, f) != 0]) for f in ("seen", "joint", "kinds")}
        for a, m in models.items()
    }
    name = hashlib.sha256(b"".join(x.tobytes() for m in packed.values() for p in m.values() for x in p)).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    names = [c for c in rows.columns if c != "log_ratio"]
    at = names.index(url)
    rows = rows.select(*[F.col(f"`{c}`") for c in names])

    def unpack() -> dict[bool, Model]:
        unpacked = {}
        for accepted, fields in shared.value.items():
            unpacked[accepted] = Model(settings)
            for field, (places, values) in fields.items():
                getattr(unpacked[accepted], field).ravel()[places] = values
        return unpacked

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("urls", name, unpack)
        for batch in batches:
            for part in slices(batch, at):
                gain, size = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for chunk in chunks([x or "" for x in part.column(at).to_pylist()], settings):
                    owner, before, joint = chunk_contexts(chunk, settings)
                    each = own[True].log_likelihood(before, joint) - own[False].log_likelihood(before, joint)
                    gain += np.bincount(owner, weights=each, minlength=part.num_rows)
                    size += np.bincount(owner, minlength=part.num_rows)
                ratio = pa.array(gain / np.maximum(size, 1), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, ratio], names=[*names, "log_ratio"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return map_arrow(rows, score, f"{fields}, log_ratio double")


def calibrate(scored: DataFrame, settings: Settings) -> float:
    """The bar with the best mean of the two classes' shares judged right, on a fixed grid.

    A histogram of ``settings.bins`` bins is all that reaches the driver. The lowest of equal bars.
    """
    step = 2 * settings.span / (settings.bins - 1)
    place = F.least(F.greatest(F.floor((F.col("log_ratio") + settings.span) / step), F.lit(0)), F.lit(settings.bins - 1))
    counts = {True: np.zeros(settings.bins), False: np.zeros(settings.bins)}
    for row in scored.groupBy("accepted", place.cast("int").alias("bin")).count().collect():
        counts[row["accepted"]][row["bin"]] = row["count"]
    if not counts[True].sum() or not counts[False].sum():
        return 0.0
    kept = counts[True][::-1].cumsum()[::-1] / counts[True].sum()
    gone = 1 - counts[False][::-1].cumsum()[::-1] / counts[False].sum()
    return float(int(np.argmax(kept + gone)) * step - settings.span)


def judge_urls(
    pages: DataFrame, rules: list[Rule], settings: Settings = Settings(), key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``log_ratio`` and ``bar`` of every URL.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the
    models. A URL of any length is judged whole, chunk by chunk. If a class has no URL, the bar is 0. Null ids, repeated rows and empty tables pass through;
    other columns are not read.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    parsed = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", rule).withColumn("ruling", verdict)
    known = ruled.where("ruling is not null").select("url", (F.col("ruling") == "allow").alias("accepted"))
    held = F.pmod(F.xxhash64("url"), F.lit(settings.holdout)) == 0
    models = train(known.where(~held), settings)
    bar = calibrate(score_urls(known.where(held), models, settings), settings)
    scored = score_urls(ruled, models, settings)
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruling", F.when(F.col("log_ratio") >= bar, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"),
        "log_ratio",
        F.lit(bar).alias("bar"),
    )
