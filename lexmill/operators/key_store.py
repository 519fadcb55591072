"""Deduplication against what earlier runs have kept (A3, A9, L2 over many runs).

A store is a folder with a run=... folder for each run: the digests that it kept, sorted, and a filter of them for each bucket of digests. A new run's rows are
first made distinct among themselves. Their digests then meet the filters bucket by bucket, in a stream that holds the filters of one bucket;
most new ones are told to be new there. Those that a filter knows are looked up among the stored digests themselves, so no filter decides alone.

A run is named by the caller and stored whole or not at all; when it's run again it takes the place of its first try, whose keys it doesn't meet.
Runs of one store follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources.sinks import replace
from .clean import first_of_equal

#: Buckets of digests, which keep their number as long as the store lives: a bucket's digests of one run must fit in a task.
BUCKETS = 256
#: Bits of a filter for each digest (rounded up to a power of two), and how many of them a digest sets.
BITS = 16
HASHES = 4
#: As many doubtful digests (of 32 bytes) are broadcast to the stored ones.
BROADCAST = 200_000


def digest(*keys: Column | str) -> Column:
    """SHA-256 of the keys, 32 bytes; nulls and borders between keys count."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    told = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat_ws("|", *told).cast("binary"), 256))


def positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """Places of digests (n x 32 bytes) in a filter: their own 64-bit words, as digests are random already."""
    return digests.view("<u8")[:, :HASHES] % np.uint64(bits)


def filter_of(digests: np.ndarray) -> bytes:
    bits = 1 << max(3, (len(digests) * BITS - 1).bit_length())
    held = np.zeros(bits, dtype=bool)
    held[positions(digests, bits).ravel()] = True
    return np.packbits(held, bitorder="little").tobytes()


def known(digests: np.ndarray, held: bytes) -> np.ndarray:
    bits = np.frombuffer(held, dtype=np.uint8)
    at = positions(digests, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), 32)


@dataclass
class KeyStore:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def runs(self) -> list[str]:
        """The names of the runs that are stored."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(conf)
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n.removeprefix("run=") for n in names if n.startswith("run=") and not n.endswith(".partial"))

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.conv(F.hex(F.substring(key, 29, 4)), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def stored(self, what: str, runs: Sequence[str]) -> DataFrame | None:
        tables = [self.spark.read.parquet(f"{self.path}/run={r}/{what}") for r in runs]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def keep_new(self, rows: DataFrame, key: Column, order: Sequence[str], run: str) -> DataFrame:
        """The rows whose digest (key) neither an earlier row of these nor another run has, whole; their digests are stored as this run's."""
        if not run or set(run) & set("/=") or run.endswith(".partial"):
            raise ValueError(f"a run can't be named {run!r}")
        earlier = [r for r in self.runs() if r != run]
        first = checkpointed(first_of_equal(rows.withColumn("digest_", key), "digest_", list(order)))
        fresh = first
        if earlier:
            seen = self.seen(first.select(F.col("digest_").alias("key")), earlier)
            fresh = first.join(seen.withColumnRenamed("key", "digest_"), "digest_", "left_anti")
        fresh = checkpointed(fresh)
        self.store(fresh.select(F.col("digest_").alias("key")), run)
        return fresh.drop("digest_")

    def seen(self, keys: DataFrame, runs: Sequence[str]) -> DataFrame:
        """Those of the distinct digests (key) that one of the runs has stored."""
        doubtful = checkpointed(self.doubtful(keys, runs))
        n = doubtful.count()
        if n == 0:
            return doubtful
        return self.stored("keys", runs).select("key").join(F.broadcast(doubtful) if n <= BROADCAST else doubtful, "key", "left_semi").distinct()

    def doubtful(self, keys: DataFrame, runs: Sequence[str]) -> DataFrame:
        """The digests that a filter of one of the runs knows: all that are stored, and few others."""
        filters = self.stored("filters", runs).select("bucket", F.lit(0).alias("kind"), F.col("filter").alias("data"))
        asked = keys.select(self.bucket("key").alias("bucket"), F.lit(1).alias("kind"), F.col("key").alias("data"))
        met = filters.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "kind")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held = None, []
            for batch in batches:
                bucket, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(bucket)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if bucket[a] != current:
                        current, held = bucket[a], []
                    part = batch.column(2).slice(a, b - a)
                    if kind[a] == 0:
                        held += part.to_pylist()
                    elif held:
                        digests = rows_of(part)
                        hit = np.any([known(digests, f) for f in held], axis=0)
                        if hit.any():
                            yield pa.RecordBatch.from_arrays([part.filter(pa.array(hit))], names=["key"])

        return met.mapInArrow(probe, "key binary")

    def store(self, keys: DataFrame, run: str) -> None:
        def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held = None, []

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([filter_of(np.concatenate(held))], pa.binary())], names=["bucket", "filter"])

            for batch in batches:
                bucket = np.asarray(batch.column(0))
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if held and bucket[a] != current:
                        yield done()
                        held = []
                    current = int(bucket[a])
                    held.append(rows_of(batch.column(1).slice(a, b - a)))
            if held:
                yield done()

        def write(rows: DataFrame, to: str) -> None:
            placed = rows.select(self.bucket("key").alias("bucket"), "key").repartition("bucket").sortWithinPartitions("bucket", "key")
            placed.write.parquet(f"{to}/keys")
            made = self.spark.read.parquet(f"{to}/keys").repartition("bucket").sortWithinPartitions("bucket")
            made.mapInArrow(filters, "bucket int, filter binary").write.parquet(f"{to}/filters")

        replace(keys, f"{self.path}/run={run}", write)
