"""Readers (S1, S4-S10, S12, U1). Paths are Spark paths; nothing opens a file on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_space
from ..operators.quota import largest_remainder, take_quotas
from .manifests import TextSource, training_mix

MESSAGES = "array<struct<role: string, content: string>>"
RECORD = f"messages {MESSAGES}, source string, kind string, qid string"


def open_source(spark: SparkSession, source: TextSource) -> DataFrame:
    """A table of a source: by suffix a parquet, JSON or CSV path, else a table of the catalog."""
    name = source.dataset
    for suffix, kind in ((".parquet", "parquet"), (".jsonl", "json"), (".json", "json"), (".csv", "csv"), (".orc", "orc")):
        if name.rstrip("/").endswith(suffix):
            return spark.read.option("header", "true").format(kind).load(name)
    return spark.table(name)


def read_sources(spark: SparkSession, sources: Sequence[TextSource], total: int | None = None, opener: Callable[[SparkSession, TextSource], DataFrame] = open_source) -> DataFrame:
    """(source_idx, source, row_idx, text) of all sources in turn, white space collapsed, empty and non-text rows out.

    Each source gives its limit, or its share of total by weight. Row numbers follow the files' order.
    """
    if total is not None and any(s.limit is not None for s in sources):
        raise ValueError("a total can't be combined with limits")
    limits: list[int | None] = [s.limit for s in sources] if total is None else list(largest_remainder([s.weight for s in sources], total))
    parts = []
    for i, (source, limit) in enumerate(zip(sources, limits, strict=True)):
        rows = opener(spark, source)
        if dict(rows.dtypes)[source.text_column] != "string":
            raise ValueError(f"{source.dataset}: {source.text_column} isn't text")
        rows = rows.select(F.lit(i).alias("source_idx"), F.lit(str(i)).alias("source"), F.monotonically_increasing_id().alias("row_idx"), collapse_space(source.text_column).alias("text"))
        rows = rows.filter("text IS NOT NULL AND text <> ''")
        parts.append((rows if limit is None else take_quotas(rows, {str(i): limit}, "row_idx")).withColumn("source", F.lit(source.dataset)))
    return reduce(DataFrame.unionByName, parts)


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(row_idx, text), a document for each line."""
    return spark.read.text(list(paths)).select(F.monotonically_increasing_id().alias("row_idx"), F.col("value").alias("text"))


def read_records(spark: SparkSession, *paths: str, schema: str = RECORD) -> DataFrame:
    """Records from JSON lines; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that are there: inputs that are missing are left out of a merge."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
    return [p for p in paths if there(p)]


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source, text) of all .md and .txt files (in any case) under a path, source being the path below it; doc_id grows in
    the order of the sources. No such file is an error."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[mM][dD],[tT][xX][tT]}").text(path, wholetext=True)
    full = F.col("_metadata.file_path")
    root = path.rstrip("/").removeprefix("file:")
    below = F.when(F.contains(full, F.lit(f"{root}/")), F.substring_index(full, f"{root}/", -1)).otherwise(F.substring_index(full, "/", -1))
    found = files.select(F.url_decode(below).alias("source"), F.col("value").alias("text"))
    if found.isEmpty():
        raise ValueError(f"{path} has no .md or .txt files")
    return found.orderBy("source").select(F.monotonically_increasing_id().alias("doc_id"), "source", "text")


def read_token_stream(spark: SparkSession, path: str, end: int = 3) -> DataFrame:
    """(file, doc_idx, tokens) of files of two-byte little-endian ids, a row for each run of ids up to `end`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_buffer(), dtype="<u2")
                ends = np.flatnonzero(ids == end) + 1
                if len(ids) and (not len(ends) or ends[-1] != len(ids)):
                    raise ValueError(f"{name} doesn't end with {end}")
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ends), pa.string()), pa.array(np.arange(len(ends), dtype=np.int64)), lists], names=["file", "doc_idx", "tokens"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(split, "file string, doc_idx long, tokens array<int>")


def read_token_mix(spark: SparkSession, manifest: str) -> DataFrame:
    """The token streams of a training manifest, with source_idx and share (of all weights)."""
    parts = [read_token_stream(spark, path).withColumns({"source_idx": F.lit(i), "share": F.lit(share)}) for i, (path, share) in enumerate(training_mix(manifest))]
    return reduce(DataFrame.unionByName, parts)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table, checked."""
    found = spark.read.parquet(path)
    kinds = dict(found.dtypes)
    if kinds.get("source") != "string" or kinds.get("text") != "string":
        raise ValueError("a chunk table needs source and text")
    return found


def import_chunks(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """S9 for a JSON index {version, chunks: [{source, text}]}."""
    read = spark.read.schema("version int, chunks array<struct<source: string, text: string>>").option("mode", "FAILFAST").json(path, multiLine=True)
    head = read.select("version", F.col("chunks").isNotNull().alias("has"), F.exists("chunks", lambda c: c["source"].isNull() | c["text"].isNull()).alias("bad")).first()
    if head is None or head["version"] != version or not head["has"]:
        raise ValueError("not an index of this version")
    if head["bad"]:
        raise ValueError("the index has malformed chunks")
    return read.select(F.posexplode("chunks").alias("chunk_idx", "c")).select(F.lit(0).cast("long").alias("doc_id"), "c.source", "chunk_idx", "c.text")


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """A vector table whose vectors have one length, made by the model that is asked for."""
    found = spark.read.parquet(path)
    sizes = found.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError("vectors differ in length")
    if model is not None and found.filter(~F.col("model").eqNullSafe(F.lit(model))).limit(1).count():
        raise ValueError(f"the vectors aren't {model}'s")
    return found


def read_examples(spark: SparkSession, path: str, max_length: int, vocabulary: int) -> DataFrame:
    """Encoded examples, checked for length and ids."""
    found = spark.read.parquet(path)
    bad = found.filter((F.size("input_ids") != max_length) | (F.size("labels") != max_length) | (F.array_max("input_ids") >= vocabulary) | (F.array_max("labels") >= vocabulary))
    if bad.limit(1).count():
        raise ValueError("examples of another length or vocabulary")
    return found
