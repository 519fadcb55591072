"""Command line (E7): python -m lexmill COMMAND ...; paths are Spark paths, tables are parquet."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.convert import phrases_converted
from .operators import clean, encode, grounded, key_store, postings, retrieval, vector_index, verify
from .plans.workflows import collected, counters, run_corpus
from .session import checkpointed, ship
from .sources import manifests, readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill", description="Prepare and query text corpora with Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *paths: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=what)
        for p in paths:
            made.add_argument(p)
        return made

    command("collect", "documents of the sources of a manifest", "manifest", "output").add_argument("--total", type=int)
    cleaned = command("clean", "accepted documents of a table (doc_id, text), and a report", "input", "output")
    cleaned.add_argument("--report")
    cleaned.add_argument("--min-chars", type=int, default=20)
    cleaned.add_argument("--max-chars", type=int, default=20000)
    cleaned.add_argument("--min-cjk-ratio", type=float, default=0.15)
    command("encode", "a token stream of a table (doc_id, text), with a tokenizer trained on it", "input", "output").add_argument("--vocabulary", type=int, default=8192)
    command("corpus", "clean, split, tokenize and encode, with resume", "input", "folder").add_argument("--ratio", type=float, default=0.01)
    index = command("index", "chunks of a folder of .md and .txt files", "input", "output")
    index.add_argument("--size", type=int, default=600)
    index.add_argument("--overlap", type=int, default=80)
    command("records", "grounded records of chunks", "input", "output")
    command("postings", "a stored BM25 index of chunks", "input", "output")
    stored = command("vectors", "vectors (vec_id, embedding) stored by cluster", "input", "output")
    stored.add_argument("--key", default="vec_id")
    stored.add_argument("--clusters", type=int, default=vector_index.CLUSTERS)
    changed = command("convert", "a table whose texts are converted by JSON dictionaries, one after the other", "input", "output")
    changed.add_argument("dictionaries", nargs="+")
    known = command("dedup", "rows whose texts no earlier run of a store has kept", "input", "output", "store", "run")
    known.add_argument("--order", default="doc_id")
    talks = command("chat", "conversations of a manifest's sources, as records", "manifest", "output")
    talks.add_argument("--limit", type=int, default=40000)
    answered = command("qa", "grounded records of question-answer rows", "input", "output")
    answered.add_argument("--max-context-chars", type=int, default=320)
    asked = command("ask", "what chunks, or a stored index of them, say on a query", "input", "query")
    asked.add_argument("--index", action="store_true", help="input is a stored index")
    asked.add_argument("--mode", choices=verify.MODES, default="cited")
    asked.add_argument("--answer", help="the generated answer that modes generate, verified and reliable work on")
    asked.add_argument("--least-overlap", type=float, default=0.5)
    asked.add_argument("--show-sources", action="store_true")
    asked.add_argument("--output", help="a file for the query and the answer")
    asked.add_argument("--top-k", type=int, default=3)
    asked.add_argument("--least", type=float, default=1.0)
    asked.add_argument("--max-chars", type=int, default=500)
    asked.add_argument("--conflicts", choices=("ignore", "warn", "refuse"), default="warn")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """Do what the arguments say; returns what is to be printed."""
    ship(spark)
    if args.command == "collect":
        sinks.write_tokens(readers.read_sources(spark, manifests.text_sources(manifests.load_json(args.manifest)), args.total), args.output)
        return f"{spark.read.parquet(args.output).count()} documents"
    if args.command == "index":
        sinks.write_chunks(retrieval.build_chunks(readers.read_folder(spark, args.input), args.size, args.overlap), args.output)
        return f"{spark.read.parquet(args.output).count()} chunks"
    if args.command == "ask":
        return ask(spark, args)
    if args.command == "chat":
        sources = [(x, readers.open_source(spark, manifests.TextSource(x.dataset))) for x in manifests.chat_sources(manifests.load_json(args.manifest))]
        sinks.write_records(collected(sources, args.limit), args.output)
        return f"{spark.read.json(args.output).count()} conversations"
    rows: DataFrame = spark.read.parquet(args.input)
    if args.command == "clean":
        options = clean.CleanOptions(args.min_chars, args.max_chars, args.min_cjk_ratio)
        sinks.write_tokens(clean.clean_corpus(rows, options), args.output)
        report = clean.report(clean.outcomes(rows, options))
        if args.report:
            sinks.write_report(report, args.report)
        return json.dumps(report.first().asDict(recursive=True), ensure_ascii=False)
    if args.command == "encode":
        made = encode.encode_corpus(rows, encode.train_tokenizer(rows, args.vocabulary))
        sinks.write_token_stream(made, args.output)
        return json.dumps(counters(rows, made, "tokens").first().asDict())
    if args.command == "corpus":
        return json.dumps({r["split"]: r["count"] for r in run_corpus(spark, rows, args.folder, ratio=args.ratio).groupBy("split").count().collect()})
    if args.command == "records":
        sinks.write_records(grounded.synthesize(rows), args.output)
        return f"{spark.read.json(args.output).count()} records"
    if args.command == "postings":
        index = postings.write_index(rows, args.output)
        return f"{index.n} chunks"
    if args.command == "vectors":
        held = vector_index.write_vector_index(rows, args.output, args.key, args.clusters)
        return f"{held.sizes.sum()} vectors in {len(held.clusters)} clusters"
    if args.command == "convert":
        sinks.write_tokens(rows.withColumn("text", phrases_converted("text", *[manifests.load_json(d) for d in args.dictionaries])), args.output)
        return f"{spark.read.parquet(args.output).count()} documents"
    if args.command == "dedup":
        kept = key_store.KeyStore(spark, args.store).keep_new(rows, key_store.digest("text"), [args.order], args.run)
        sinks.write_tokens(kept, args.output)
        return f"{spark.read.parquet(args.output).count()} documents"
    made, counts = grounded.qa_records(rows.withColumn("row_idx", F.monotonically_increasing_id()), (1 << 31) - 1, max_context_chars=args.max_context_chars)
    sinks.write_records(made, args.output)
    return json.dumps(counts)


def ask(spark: SparkSession, args: argparse.Namespace) -> str:
    """An answer to one query, from a chunk table or a stored index."""
    if args.index:
        index = postings.open_index(spark, args.input)
        asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(args.query).alias("text"))
        hits = retrieval.search_many(index.documents, asked, top_k=args.top_k, least=args.least, lexical=lambda table, k: postings.search_batch(index, table, k)).drop("query_id")
    else:
        hits = retrieval.search(spark.read.parquet(args.input), args.query, top_k=args.top_k, least=args.least)
    hits = checkpointed(hits.withColumn("source", F.coalesce("source", F.lit(""))))  # top_k rows
    if hits.isEmpty():
        raise ValueError("no chunk is evidence enough for this query")
    generated = None if args.answer is None else spark.range(1).select(F.col("id").alias("answer_id"), F.lit(args.answer).alias("answer"))
    said, warnings = verify.answer(args.mode, hits, args.query, generated, max_chars=args.max_chars, least=args.least_overlap, policy=args.conflicts)
    text = said.first()["text"]
    if args.output:
        sinks.write_answer(args.query + "\n", text, args.output)
    sources = [f"[{h['rank']}] {h['source']} ({h['score']:.2f})" for h in hits.orderBy("rank").collect()] if args.show_sources else []
    return "\n".join([*warnings, *sources, text])


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(run(SparkSession.builder.appName("lexmill").getOrCreate(), args))


if __name__ == "__main__":
    main()
