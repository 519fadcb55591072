"""Writers (K1-K7). A table is written beside its path and renamed, so that a reader sees the old one or the new one, whole."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in a file of a token stream, which is read whole.
STREAM_ROWS = 100_000


def replace(rows: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """write(rows, beside), then put what it wrote in the place of `path`."""
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.partial"
    write(rows, beside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = new.getFileSystem(conf)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{beside} couldn't be renamed")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written on the way to another."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(conf).delete(gone, True)


def write_text(rows: DataFrame, path: str, text: str = "text") -> None:
    """K1: a document for each line."""
    replace(rows.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")), path, lambda df, p: df.write.text(p))


def write_report(report: DataFrame, path: str) -> None:
    """K2: one row as a JSON file on the driver, whole or not at all."""
    row = report.first().asDict(recursive=True)
    part = Path(f"{path}.partial")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(json.dumps(row, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(part, path)


def write_answer(prompt: str, answer: str, path: str) -> None:
    """K8: a prompt and its answer as a text file on the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f"{prompt}{answer}\n", encoding="utf-8")


def write_records(records: DataFrame, path: str) -> None:
    """K3: JSON lines."""
    replace(records, path, lambda df, p: df.write.json(p))


def write_tokens(rows: DataFrame, path: str) -> None:
    """K4: a table of token arrays."""
    replace(rows, path, lambda df, p: df.write.parquet(p))


def write_token_stream(rows: DataFrame, path: str, tokens: str = "tokens", end: int = 3) -> None:
    """K4: files of two-byte little-endian ids, a row's after the one before. Each row must end with the id `end` and have no other.

    The text writer writes them: a line's end is the id `end`, so nothing stands between the ids of two rows.
    """

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            ids = [np.asarray(x) for x in batch]
            if any(not len(x) or x[-1] != end or (x[:-1] == end).any() or x.max() > 0xFFFF or x.min() < 0 for x in ids):
                raise ValueError(f"rows must be ids of two bytes that end with {end} and hold no other")
            yield pd.Series([x[:-1].astype("<u2").tobytes() for x in ids], dtype=object)

    line_end = int(end).to_bytes(2, "little").decode("ascii")
    packed = rows.select(pack(tokens).cast("string").alias("value"))
    replace(packed, path, lambda df, p: df.write.option("lineSep", line_end).option("maxRecordsPerFile", STREAM_ROWS).text(p))


def token_stream(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """K4: each partition's tokens in two-byte little-endian blocks (part, block, data), in the rows' order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            flat = np.concatenate([np.asarray(x, dtype="<u2") for x in batch.column(0).to_pylist()] or [np.zeros(0, dtype="<u2")])
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([flat.tobytes()])], names=["block", "data"])

    return rows.select(tokens).mapInArrow(pack, "block long, data binary").withColumn("part", F.spark_partition_id())


def write_chunks(chunks: DataFrame, path: str) -> None:
    """K6: a chunk table; an empty one is an error."""

    def write(rows: DataFrame, to: str) -> None:
        rows.write.parquet(to)
        if rows.sparkSession.read.parquet(to).isEmpty():
            raise ValueError("no text to index")

    replace(chunks, path, write)


write_vectors = write_chunks  # K7
write_examples = write_tokens  # K5
