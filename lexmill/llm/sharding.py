"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 2).

The ring has 2**16 cells. Each shard owns VIRTUAL_NODES points on it; a row's hash names its cell, and the row goes to the shard
of the next point clockwise that isn't full, in ring order. A shard is full at its equal part of the rows (law `rows`: counts
at most one apart). Only rows whose own shard is full move on, so a further shard moves little beyond what it takes.

Rows are numbered along the ring by a range sort, so placement needs only the number of rows in each cell (2**16 counts at
most, whatever the input) and a table of at most shards * (VIRTUAL_NODES + 1) + 1 segments of row numbers.

Results for odd input: null text has 0 bytes and the CRC of the empty text, null, repeated or clashing ids and columns are
rows like any other (equal rows are told apart by an arbitrary number), an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, table, text_or_empty

RING_BITS = 16
VIRTUAL_NODES = 256
SHARDS = 24
#: monotonically_increasing_id() has the row's number inside its partition in the low 33 bits.
ROW_BITS = 33


@dataclass(frozen=True)
class Segment:
    """Rows first..first+count-1 along the ring go to slots slot.. of a shard."""

    first: int
    count: int
    shard: int
    slot: int


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of all virtual nodes."""

    def cell(shard: int, i: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{i}".encode(), digest_size=8).digest(), "big") >> (64 - RING_BITS)

    return sorted((cell(s, i), s) for s in range(shards) for i in range(virtual_nodes))


def place_cells(counts: np.ndarray, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[Segment]:
    """Walk the ring once: counts[c] rows in cell c go to the first shard clockwise that has room."""
    points = ring_points(shards, virtual_nodes)
    cells = np.array([c for c, _ in points])
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    # all rows between two points start their walk at the same point
    start = np.searchsorted(cells, np.arange(len(counts))) % len(points)
    found: list[Segment] = []
    row, c = 0, 0
    while c < len(counts):
        end = c
        while end < len(counts) and start[end] == start[c]:
            end += 1
        left, at = int(counts[c:end].sum()), int(start[c])
        while left:
            shard = points[at][1]
            if n := min(left, room[shard] - used[shard]):
                found.append(Segment(row, n, shard, used[shard]))
                used[shard] += n
                row += n
                left -= n
            at = (at + 1) % len(points)
        c = end
    return found


def shard_rows(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, id_column: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Return doc_id, size, text_crc32, shard, slot (and the columns in keep, under kept_<name>) for every row of docs."""
    text = text_or_empty("text")
    slim = checkpointed(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            *[F.col(c).alias(f"kept_{c}") for c in keep],
        )
        .withColumn("hash", F.xxhash64("doc_id", "text_crc32", "size"))
        .withColumn("cell", F.shiftrightunsigned("hash", 64 - RING_BITS).cast("int"))
        .withColumn("tie", F.monotonically_increasing_id())
    )
    ranged = checkpointed(
        slim.repartitionByRange(shuffle_partitions(docs.sparkSession), "cell", "hash", "doc_id", "text_crc32", "tie")
        .sortWithinPartitions("cell", "hash", "doc_id", "text_crc32", "tie")
        .withColumn("number", F.monotonically_increasing_id())
        .withColumn("range", F.shiftright("number", ROW_BITS).cast("int"))
    )
    counted = ranged.groupBy("range", "cell").count().toPandas()  # one row for each range and cell: at most 2**16 + ranges
    counts = np.zeros(1 << RING_BITS, dtype=np.int64)
    np.add.at(counts, counted["cell"].to_numpy(dtype=np.int64), counted["count"].to_numpy(dtype=np.int64))
    in_range = np.zeros(int(counted["range"].max()) + 1 if len(counted) else 1, dtype=np.int64)
    np.add.at(in_range, counted["range"].to_numpy(dtype=np.int64), counted["count"].to_numpy(dtype=np.int64))
    starts = np.concatenate([[0], np.cumsum(in_range)[:-1]])
    segments = place_cells(counts, shards, virtual_nodes)
    first = np.array([s.first for s in segments], dtype=np.int64)
    shard = np.array([s.shard for s in segments], dtype=np.int32)
    slot = np.array([s.slot for s in segments], dtype=np.int64)

    @F.pandas_udf("shard int, slot long")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for numbers in batches:
            n = numbers.to_numpy(dtype=np.int64)
            row = starts[n >> ROW_BITS] + (n & ((1 << ROW_BITS) - 1))
            at = np.searchsorted(first, row, side="right") - 1
            yield pd.DataFrame({"shard": shard[at], "slot": slot[at] + row - first[at]})

    placed = ranged.withColumn("placed", assign("number"))
    return placed.select("doc_id", "size", "text_crc32", *[f"kept_{c}" for c in keep], "placed.shard", "placed.slot")


def shard_manifest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The columns of docs but for the text, with size, text_crc32, shard and slot: which row of which shard a document is."""
    kept = [c for c in docs.columns if c not in ("doc_id", "text", "size", "text_crc32", "shard", "slot")]
    out = shard_rows(docs, shards, keep=kept)
    return out.select("doc_id", *[F.col(f"kept_{c}").alias(c) for c in kept], "size", "text_crc32", "shard", "slot")


def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law `rows` of op2_bounded_ring: rows, slots and sizes of each shard's rows and of all."""
    out = shard_rows(table(spark, sf_dir, "documents"))
    each = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"))
    return each.join(F.broadcast(out.agg(F.sum("size").alias("all_bytes"))))  # one row


ORACLE_SHARD_COUNTS = f"""
WITH d AS (SELECT count(*) AS n, sum(octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS all_bytes FROM documents),
s AS (SELECT shard, n // {SHARDS} + CASE WHEN shard < n % {SHARDS} THEN 1 ELSE 0 END AS k, all_bytes FROM range({SHARDS}) r(shard), d)
SELECT shard::INT AS shard, k AS n_rows, 0::BIGINT AS first_slot, k - 1 AS last_slot, k AS n_slots, all_bytes FROM s WHERE k > 0
"""
