"""Sources, weights and quotas."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udfs import hash_bucket
from .clean import first_of_equal


def largest_remainder(weights: Sequence[float], total: int) -> list[int]:
    """Whole shares of total in proportion to weights: floors, and one more for the largest fractions (ties: the first)."""
    if len(weights) == 1:
        return [total]
    for i, w in enumerate(weights, 1):
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or w <= 0:
            raise ValueError(f"weight {w!r} of source {i} is no number above 0")
    raw = [total * (w / sum(weights)) for w in weights]
    shares = [math.floor(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: shares[i] - raw[i])[: total - sum(shares)]:
        shares[i] += 1
    return shares


def take_quotas(docs: DataFrame, quotas: dict[str, int], order: str = "doc_id") -> DataFrame:
    """L1: the first rows of each source, as many as its quota; sources without one are left out."""
    limits = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    rank = F.row_number().over(Window.partitionBy("source").orderBy(order))
    most = max(quotas.values(), default=0)
    # the constant bound lets each task cut its own part of a source before the shuffle
    ranked = docs.filter(F.col("source").isin(list(quotas))).withColumn("rank_", rank).filter(F.col("rank_") <= most)
    return ranked.filter(F.col("rank_") <= limits[F.col("source")]).drop("rank_")


def collect_conversations(sources: Sequence[tuple[DataFrame, int | None]], limit: int, key: str, order: str) -> DataFrame:
    """L2: sources in turn, each with its own limit, without what earlier sources have given; then the first `limit`."""
    accepted: DataFrame | None = None
    for i, (rows, own) in enumerate(sources):
        fresh = first_of_equal(rows, key, [order])
        if accepted is not None:
            fresh = fresh.join(accepted.select(key), key, "left_anti")
        # a limit is a number of rows that the caller names; the sort for it keeps that many
        fresh = (fresh.orderBy(order).limit(own) if own is not None else fresh).withColumn("source_idx", F.lit(i))
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
    if accepted is None:
        raise ValueError("no sources")
    return accepted.orderBy("source_idx", order).limit(limit)


def merge_records(inputs: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """All inputs, without repeats of earlier rows."""
    numbered = [rows.withColumn("input_idx", F.lit(i)) for i, rows in enumerate(inputs)]
    return first_of_equal(reduce(DataFrame.unionByName, numbered), key, ["input_idx", order])


def normalized_weights(sources: DataFrame, weight: str = "weight") -> DataFrame:
    """A10: weights that add up to 1, over a table with a row for each source."""
    return sources.withColumn("share", F.col(weight) / F.sum(weight).over(Window.partitionBy(F.lit(1))))


def hash_split(docs: DataFrame, ratio: float = 0.01, text: str = "text", bucket: Column | None = None) -> DataFrame:
    """Valid or train by the hash of the text; the same text is always on the same side."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    place = hash_bucket(text) if bucket is None else bucket
    return docs.withColumn("split", F.when(place < ratio, "valid").otherwise("train"))
