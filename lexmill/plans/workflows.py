"""Workflows: stages that are written and read again, with resume."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import converted, message_fingerprint
from ..operators.chat import encode_conversations, normalize_alpaca, normalize_conversations, pad, tokenizer_ids
from ..operators.clean import CleanOptions, clean_corpus
from ..operators.encode import END, PAD, conversation_encoder, encode_corpus, train_tokenizer
from ..operators.grounded import SynthesisOptions, normalize_qa, synthesize
from ..operators.quota import collect_conversations, hash_split, merge_records
from ..sources.manifests import ChatSource
from ..sources.readers import existing


def content_digest(table: DataFrame) -> str:
    """A fingerprint of a table's schema and rows, whatever their order: sums of two hashes of each row, in one pass."""
    parts = []
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = f.dataType.typeName() in ("array", "struct", "map")
        # hashes pass over nulls, so nulls are told apart by what is written of them
        parts += [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c, c.isNull()]
        if f.dataType.typeName() in ("array", "struct") and "map" not in f.dataType.simpleString():
            parts.append(c)
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")) for seed in (1, 2)]
    return hashlib.sha256(f"{table.schema.json()}/{tuple(table.agg(F.count(F.lit(1)), *sums).first())}".encode()).hexdigest()


@dataclass
class Workflow:
    """Runs named stages into tables under a folder (W2); with resume, a stage whose table is whole isn't run again.

    A table's name has a digest of its stage's options and of all that it needs: given tables by their content, earlier stages by their own
    digests. So a changed input or option runs again what depends on it, and nothing else.
    """

    spark: SparkSession
    folder: str
    resume: bool = True
    ran: list[str] = field(default_factory=list)
    digests: dict[str, str] = field(default_factory=dict)

    def given(self, name: str, table: DataFrame) -> DataFrame:
        """Names an input; it is read once for its fingerprint."""
        self.digests[name] = content_digest(table)
        return table

    def stage(self, name: str, make: Callable[[], DataFrame], *options: object, needs: Sequence[str] = ()) -> DataFrame:
        told = "/".join([name, repr(options), *(f"{n}={self.digests[n]}" for n in needs)])
        self.digests[name] = digest = hashlib.sha256(told.encode()).hexdigest()[:24]
        made = f"{self.folder}/{name}/options={digest}"
        if not (self.resume and existing(self.spark, [f"{made}/_SUCCESS"])):
            make().write.mode("overwrite").parquet(made)
            self.ran.append(name)
        return self.spark.read.parquet(made)


def counters(read: DataFrame, kept: DataFrame, tokens: str | None = None) -> DataFrame:
    """One row with how many rows were read, accepted and skipped, and the tokens of those accepted."""
    n = read.agg(F.count(F.lit(1)).alias("read"))
    taken = kept.agg(F.count(F.lit(1)).alias("accepted"), *([F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("tokens")] if tokens else []))
    return n.join(F.broadcast(taken)).withColumn("skipped", F.col("read") - F.col("accepted"))  # one row each


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def run_corpus(spark: SparkSession, docs: DataFrame, folder: str, options: CleanOptions = CleanOptions(), ratio: float = 0.01, vocabulary: int = 8192, convert: Callable[[str], str] | None = None, resume: bool = True, model: bytes | None = None, flow: Workflow | None = None) -> DataFrame:
    """Convert, clean, split, and encode both sides with a tokenizer (model; without one, one of `vocabulary` pieces is trained). Returns (doc_id, split, tokens)."""
    flow = flow or Workflow(spark, folder, resume)
    raw, source = flow.given("docs", docs), "docs"
    if convert is not None:
        source = "converted"
        raw = flow.stage(source, lambda: docs.withColumn("text", converted("text", convert)), getattr(convert, "__qualname__", type(convert).__name__), needs=["docs"])
    clean = not_empty(flow.stage("clean", lambda: clean_corpus(raw, options), options, needs=[source]), "document passed the filters")
    split = flow.stage("split", lambda: hash_split(clean, ratio), ratio, needs=["clean"])
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    if len(counts) < 2:
        raise ValueError(f"one side of the split is empty: {counts}")
    if model is not None:
        return flow.stage("tokens", lambda: encode_corpus(split, model).select("doc_id", "split", "tokens"), hashlib.sha256(model).hexdigest(), needs=["split"])
    made = flow.stage("tokenizer", lambda: spark.createDataFrame([(bytearray(train_tokenizer(split.filter("split = 'train'"), vocabulary)),)], "model binary"), vocabulary, needs=["split"]).first()["model"]
    return flow.stage("tokens", lambda: encode_corpus(split, bytes(made)).select("doc_id", "split", "tokens"), needs=["split", "tokenizer"])


def collected(sources: Sequence[tuple[ChatSource, DataFrame]], limit: int) -> DataFrame:
    """The first `limit` valid conversations of sources in turn, without repeats: row_idx, messages, source, digest, source_idx."""

    def normal(source: ChatSource, rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("row_idx", F.monotonically_increasing_id())
        if source.format == "conversations":
            read = normalize_conversations(numbered.withColumnRenamed(source.messages_column, "messages"))
        else:
            read = normalize_alpaca(numbered, source.instruction_column, source.input_column, source.output_column)
        return read.select("row_idx", "messages", F.lit(source.dataset).alias("source"), message_fingerprint("messages").alias("digest"))

    return collect_conversations([(normal(s, df), s.limit) for s, df in sources], limit, "digest", "row_idx")


def run_chat(spark: SparkSession, sources: Sequence[tuple[ChatSource, DataFrame]], folder: str, model: bytes, limit: int = 40000, max_length: int = 512, resume: bool = True) -> DataFrame:
    """Collect conversations, encode (with a tokenizer's model) and pad them. Returns messages, source, input_ids and labels."""
    flow = Workflow(spark, folder, resume)
    given = [f"source {i}" for i in range(len(sources))]
    for name, (_, rows) in zip(given, sources, strict=True):
        flow.given(name, rows)
    rows = flow.stage("records", lambda: collected(sources, limit), limit, [s for s, _ in sources], needs=given)
    return not_empty(flow.stage("examples", lambda: encoded(rows, max_length, model), max_length, hashlib.sha256(model).hexdigest(), needs=["records"]), "conversation fits the length")


def encoded(rows: DataFrame, max_length: int, model: bytes) -> DataFrame:
    return pad(encode_conversations(rows, tokenizer_ids(conversation_encoder(model)), max_length, END), max_length, PAD)


def run_grounded(spark: SparkSession, folder: str, model: bytes, qa: DataFrame | None = None, chunks: DataFrame | None = None, options: SynthesisOptions = SynthesisOptions(), max_length: int = 512, resume: bool = True) -> DataFrame:
    """Grounded records from question-answer rows, from chunks or both, merged without repeats, encoded and padded."""
    if qa is None and chunks is None:
        raise ValueError("question-answer rows or chunks are needed")
    flow, parts, names = Workflow(spark, folder, resume), [], []
    if qa is not None:
        flow.given("qa rows", qa)
        names.append("qa")
        parts.append(flow.stage("qa", lambda: normalize_qa(qa), needs=["qa rows"]))
    if chunks is not None:
        flow.given("chunks", chunks)
        names.append("synthetic")
        parts.append(flow.stage("synthetic", lambda: synthesize(chunks, options).select("messages", "source", "kind", F.lit(None).cast("string").alias("qid")), options, needs=["chunks"]))
    keyed = [p.withColumn("row_idx", F.monotonically_increasing_id()).withColumn("digest", message_fingerprint("messages")) for p in parts]
    merged = not_empty(flow.stage("merged", lambda: merge_records(keyed, "digest", "row_idx"), needs=names), "grounded record")
    return flow.stage("examples", lambda: encoded(merged, max_length, model), max_length, hashlib.sha256(model).hexdigest(), needs=["merged"])
