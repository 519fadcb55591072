"""Exact deduplication by composable polynomial fingerprints (operator 5).

A text's fingerprint is its byte length and the value of its UTF-8 bytes as a polynomial, modulo two primes. Chunks are hashed
side by side and combined by arithmetic shifted by length: hash(a + b) = hash(a) * base**len(b) + hash(b). Texts with equal
fingerprints are then compared chunk by chunk: a group whose n-th chunks aren't all the same is a collision and is told apart.

Only fingerprints of over one row are compared, and equal chunks meet in a map-side sum, so a group of any number of copies
moves one chunk for each task that holds some of it.

Results for odd input: null text counts as empty; null doc_ids stay only if a group has no other; of repeated rows with the
largest doc_id one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, few, table, text_or_empty

#: Two primes under 2**31, so that products of residues fit 64 bits, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Values combined at once on each level of the tree of chunks.
FAN = 16
#: Characters in a chunk of the comparison.
CHUNK = 65536


def combine(left: tuple[int, int], right: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of the concatenation of two texts, from theirs."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def polynomial_hashes(texts: Sequence[bytes], prime: int, base: int) -> np.ndarray:
    """Hash of each text: on each level, FAN neighbours combine into one; zeros in front of a text don't change its value."""
    if not texts:
        return np.zeros(0, dtype=np.uint64)
    p = np.uint64(prime)
    width = np.array([max(1, -(-len(t) // FAN)) for t in texts], dtype=np.int64)
    padded = b"".join([x for t in texts for x in (bytes(max(1, -(-len(t) // FAN)) * FAN - len(t)), t)])
    values = np.frombuffer(padded, dtype=np.uint8)
    step = 1
    while True:
        powers = np.array([pow(base, step * (FAN - 1 - i), prime) for i in range(FAN)], dtype=np.uint64)
        rows = values.reshape(-1, FAN)
        if step == 1:  # bytes times residues add up to less than 2**53: exact in floating point
            values = (rows.astype(np.float64) @ powers.astype(np.float64)).astype(np.uint64) % p
        else:
            values = (rows * powers % p).sum(axis=1) % p
        if (width == 1).all():
            return values
        step *= FAN
        ends = np.cumsum(width)
        wider = -(-width // FAN)
        spread = np.zeros(int(wider.sum()) * FAN, dtype=np.uint64)
        shift = np.cumsum(wider) * FAN - ends  # a text's values move so that its last one ends its last row
        spread[np.arange(len(values)) + np.repeat(shift, width)] = values
        values, width = spread, wider


def fingerprint_column(text: Column, primes: Sequence[int] = PRIMES) -> Column:
    """struct(h1, h2): the polynomial hashes of a text."""
    primes = tuple(primes)

    @F.pandas_udf("h1 long, h2 long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for i in range(0, len(batch), 512):
                raw = [t.encode("utf-8", "surrogatepass") for t in batch.iloc[i : i + 512]]
                parts.append(np.stack([polynomial_hashes(raw, p, b % p) for p, b in zip(primes, BASES, strict=True)], axis=1))
            found = np.concatenate([*parts, np.zeros((0, 2), dtype=np.uint64)]).astype(np.int64)
            yield pd.DataFrame({"h1": found[:, 0], "h2": found[:, 1]})

    return run(text)


KEY = ["h1", "h2", "n_bytes"]


def fingerprinted(docs: DataFrame, primes: Sequence[int], *columns: Column) -> DataFrame:
    text = text_or_empty("text")
    out = docs.select(*columns, text.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"), fingerprint_column(text, primes).alias("h"))
    return out.select("*", "h.h1", "h.h2").drop("h")


def collisions(docs: DataFrame, repeated: DataFrame, primes: Sequence[int], chunk: int = CHUNK) -> DataFrame:
    """Of the fingerprints in `repeated`, those whose texts differ in some chunk."""
    members = fingerprinted(docs, primes).join(repeated.select(*KEY), KEY, "left_semi")
    pieces = members.select(*KEY, F.posexplode(F.regexp_extract_all("content", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("at", "piece"))
    contents = pieces.groupBy(*KEY, "at", "piece").agg(F.lit(1).alias("one"))
    return contents.groupBy(*KEY, "at").count().filter(F.col("count") > 1).select(*KEY).distinct()


def duplicates(docs: DataFrame, id_column: str = "doc_id", primes: Sequence[int] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept and text_sha256 for every row of docs."""
    slim = fingerprinted(docs, primes, F.col(id_column).alias("doc_id"), F.sha2(text_or_empty("text").cast("binary"), 256).alias("text_sha256"))
    rows = checkpointed(slim.drop("content").withColumn("row", F.monotonically_increasing_id()))
    repeated = checkpointed(rows.groupBy(*KEY).count().filter(F.col("count") > 1))
    n = repeated.count()
    differing = checkpointed(collisions(docs, few(repeated, n), primes, chunk))
    if differing.isEmpty():
        rows = rows.withColumn("told", F.lit(""))
    else:  # texts that share a fingerprint but not all chunks
        rows = rows.join(differing.withColumn("collides", F.lit(True)), KEY, "left")
        rows = checkpointed(rows.withColumn("told", F.when(F.col("collides"), F.col("text_sha256")).otherwise("")).drop("collides"))
    groups = rows.groupBy(*KEY, "told").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    found = rows.join(few(groups, n), [*KEY, "told"], "left")
    alone = F.col("keep").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def op5_polynomial_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP5 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS content FROM documents),
g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM d JOIN g USING (content)
"""
