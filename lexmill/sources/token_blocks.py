"""A token stream stored in blocks, and windows at any position of it.

All rows' ids stand one after the other, two bytes each, in blocks of a fixed number of ids. Block b begins at position b * block, and the table
is sorted by block in small row groups, so a window reads the one or two blocks that it lies in, whatever rows its ids came from.

Rows are sorted once when a stream is written. Each task packs its own rows from the position at which the tasks before it end; only the pieces of
blocks that several tasks share have to meet, and no group is larger than a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import uniform
from ..session import checkpointed
from .sinks import replace

#: Ids in a block.
BLOCK = 16_384
#: Bytes of a row group, of which a window reads one or two.
GROUP_BYTES = 1 << 20
#: As many blocks are named to the scan as literals; more are joined.
NAMED_BLOCKS = 1000


@dataclass
class TokenBlocks:
    spark: SparkSession
    path: str
    total: int
    block: int

    @cached_property
    def table(self) -> DataFrame:
        """(block, data)"""
        return self.spark.read.schema("block long, data binary").parquet(f"{self.path}/blocks")


def write_token_blocks(rows: DataFrame, path: str, order: Sequence[str], tokens: str = "tokens", block: int = BLOCK) -> TokenBlocks:
    """Store the ids of all rows in order; null rows hold none. Ids that need over two bytes are an error."""
    if block <= 0:
        raise ValueError("block must be positive")

    def write(rows: DataFrame, to: str) -> None:
        spark = rows.sparkSession
        ids = F.coalesce(F.col(tokens).cast("array<int>"), F.array().cast("array<int>"))
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("row"), ids.alias("ids"))
        held = checkpointed(ordered)
        counts = held.groupBy(F.shiftright("row", 33).alias("part")).agg(F.sum(F.size("ids")).alias("n")).orderBy("part").collect()
        starts, total = {}, 0
        for r in counts:  # one for each task that wrote
            starts[r["part"]] = total
            total += r["n"]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if at is None:
                    at = starts[batch.column(0)[0].as_py() >> 33]
                flat = np.asarray(batch.column(1).flatten())
                if len(flat) and (flat.min() < 0 or flat.max() > 0xFFFF):
                    raise ValueError("ids must fit two bytes")
                flat = flat.astype("<u2")
                cuts = [0, *range(block - at % block, len(flat), block), len(flat)]
                pieces = [(at + a, flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
                at += len(flat)
                yield pa.RecordBatch.from_arrays([pa.array([p // block for p, _ in pieces], pa.int64()), pa.array([p for p, _ in pieces], pa.int64()), pa.array([d for _, d in pieces], pa.binary())], names=["block", "at", "data"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, parts = None, []
            schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])
            for batch in batches:
                done = []
                for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if parts and b != current:
                        done.append({"block": current, "data": b"".join(parts)})
                        parts = []
                    current = b
                    parts.append(data)
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
            if parts:
                yield pa.RecordBatch.from_pylist([{"block": current, "data": b"".join(parts)}], schema=schema)

        pieces = checkpointed(held.mapInArrow(pack, "block long, at long, data binary"))
        whole = pieces.repartitionByRange("block").sortWithinPartitions("block", "at").select("block", "data").mapInArrow(join, "block long, data binary")
        whole.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{to}/blocks")
        spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(block).alias("block")).write.parquet(f"{to}/stats")

    replace(rows, path, write)
    return open_token_blocks(rows.sparkSession, path)


def open_token_blocks(spark: SparkSession, path: str) -> TokenBlocks:
    stats = spark.read.parquet(f"{path}/stats").first()
    return TokenBlocks(spark, path, stats["total"], stats["block"])


def ids_of(data: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda d: np.frombuffer(d, dtype="<u2").astype(np.int32))

    return run(data)


def read_at(stream: TokenBlocks, places: DataFrame, length: int, position: str = "position") -> DataFrame:
    """places with ids, the `length` ids from each position on; places without so many ids after them are left out.

    Of each block only the window's part goes on from the join.
    """
    if length <= 0:
        raise ValueError("length must be positive")
    size = stream.block
    at = F.col(position).cast("long")
    inside = places.filter((at >= 0) & (at + length <= stream.total)).withColumn("window_", F.monotonically_increasing_id())
    inside = checkpointed(inside)
    wanted = inside.select("window_", at.alias("from_"), F.explode(F.sequence(F.floor(at / size), F.floor((at + length - 1) / size))).alias("block"))
    named = [r["block"] for r in wanted.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
    table = stream.table.filter(F.col("block").isin(named)) if len(named) <= NAMED_BLOCKS else stream.table
    begin = F.greatest(F.col("from_") - F.col("block") * size, F.lit(0))
    end = F.least(F.col("from_") + length - F.col("block") * size, F.lit(size))
    cut = wanted.join(table, "block").select("window_", "block", F.substring("data", (begin * 2 + 1).cast("int"), ((end - begin) * 2).cast("int")).alias("data"))
    whole = cut.groupBy("window_").agg(F.sort_array(F.collect_list(F.struct("block", "data"))).alias("pieces"))
    found = whole.select("window_", ids_of(F.aggregate("pieces", F.lit(b""), lambda s, p: F.concat(s, p["data"]))).alias("ids"))
    return inside.join(found, "window_").drop("window_")


def stream_windows(stream: TokenBlocks, draws: DataFrame, length: int, seed: int, key: str = "draw") -> DataFrame:
    """A window of the whole stream for each draw, with next-token targets: start, x and y; starts depend on seed and key only."""
    last = stream.total - length - 1
    placed = draws.withColumn("start", F.floor(uniform(seed, key) * F.lit(last)).cast("long")) if last > 0 else draws.limit(0).withColumn("start", F.lit(0).cast("long"))
    found = read_at(stream, placed, length + 1, "start")
    return found.withColumns({"x": F.slice("ids", 1, length), "y": F.slice("ids", 2, length)}).drop("ids")
