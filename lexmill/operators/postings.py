"""A stored inverted index for BM25 (A4, A5, J1, L3; K6 and S9 for indexes).

An index is a folder of three tables:

* documents: the rows with `doc`, a number that grows in the order of the rows, sorted by it;
* postings: for each term and range of BLOCK numbers a block with the documents, counts and lengths, and `best`, the largest weight of
  the block but for idf; sorted by term, in a folder for each hash bucket, so that a query reads the blocks of its terms only;
* stats: one row.

A search first reads the blocks' heads (term, range, n, best). They give document frequencies and, for each query and range, a bound of
all scores in it. The ranges with the largest bounds are scored first; the k-th score found is the floor under which no other range is
opened. Inside a range documents are scored one at a time: terms whose bounds add up to less than the floor can't bring a document in by
themselves and are only looked up for documents that other terms hold.

A term that a third of all documents hold is one block for each range (two, if the range was read in two tasks), so no group is larger than
a range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..functions.udfs import cuts
from ..session import checkpointed
from ..sources.sinks import remove, replace
from .retrieval import DIGITS, K1, SLICE, SLICE_WORDS, B, weight

#: Documents in a range; a power of two.
BLOCK = 8192
#: Folders of postings; up to 32 are listed without a job of their own.
BUCKETS = 32
#: Ranges that a query opens before it has a floor.
FIRST = 2
#: Query terms (repeated ones once) in a block of queries, which the driver holds.
BLOCK_TERMS = 50_000
#: What rounding may hide between a bound and a score.
SLACK = 2 * 10.0**-DIGITS


@dataclass
class Index:
    spark: SparkSession
    path: str
    order: tuple[str, ...]
    n: int
    average: float
    block: int
    buckets: int

    @cached_property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")


def local(spark: SparkSession, schema: str, *columns: Sequence) -> DataFrame:
    """A small table of the driver's, which no task has to read: a schema and its columns."""
    kinds = spark.sql(f"SELECT from_json(NULL, '{schema}') AS x").schema["x"].dataType
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds]
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields)))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(chunks: DataFrame, path: str, order: Sequence[str] = ("doc_id", "chunk_idx"), block: int = BLOCK, buckets: int = BUCKETS) -> Index:
    """Build the index of a chunk table; it takes the place of one at `path` when it is whole. Null texts hold no terms."""
    if block & (block - 1) or block <= 0 or buckets <= 0:
        raise ValueError("block must be a power of two and buckets positive")
    shift = block.bit_length() - 1

    def write(rows: DataFrame, to: str) -> None:
        spark = rows.sparkSession
        numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())
        numbered.write.parquet(f"{to}/documents")
        documents = spark.read.parquet(f"{to}/documents")
        made = documents.select("doc", tokens("text").alias("words")).mapInArrow(partial(term_blocks, block=block), "term string, range long, docs array<int>, tfs array<int>, lengths array<int>")
        made.write.parquet(f"{to}/unsorted")
        unsorted = spark.read.parquet(f"{to}/unsorted")
        n = documents.count()
        with_text, total = (x or 0 for x in unsorted.filter("term IS NULL").agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first())
        average = total / with_text if total else 1.0
        best = F.array_max(F.zip_with("tfs", "lengths", lambda tf, length: weight(tf, length, F.lit(1.0), F.lit(average))))
        # the bounds of the ranges are drawn from a first run of what stands before the exchange, so weights are worked out after it
        stored = unsorted.filter("term IS NOT NULL").withColumn("bucket", bucket_of(F.col("term"), buckets)).repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range")
        stored.select("term", "range", F.size("docs").alias("n"), best.alias("best"), "docs", "tfs", "lengths", "bucket").write.partitionBy("bucket").parquet(f"{to}/postings")
        remove(spark, f"{to}/unsorted")
        stats = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(average).cast("double").alias("average"), F.array(*map(F.lit, order)).alias("order"), F.lit(block).alias("block"), F.lit(buckets).alias("buckets"))
        stats.write.parquet(f"{to}/stats")

    replace(chunks, path, write)
    return open_index(chunks.sparkSession, path)


def term_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks (term, range, docs, tfs, lengths) of documents (doc, words) that come in order, and for each range a row without a term that holds
    the lengths of its texts. What is held at once is the counts of one range; a range that is read in two tasks gives two blocks of a term."""
    shift, place, last, held = block.bit_length() - 1, -1, -1, []
    for batch in batches:
        doc, words = np.asarray(batch.column(0)), batch.column(1)
        if not len(doc):
            continue
        size = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
        borders = np.flatnonzero((np.diff(doc >> shift) != 0) | (np.diff(doc) < 0)) + 1
        runs = zip([0, *borders], [*borders, len(doc)], strict=True)
        for at, end in ((a + x, a + y) for a, b in runs for x, y in cuts(size[a:b], SLICE, SLICE_WORDS)):
            if held and (doc[at] >> shift != place or doc[at] < last):
                yield range_blocks(place, held)
                held = []
            place, last = int(doc[at] >> shift), doc[end - 1]
            held.append(counted((doc[at:end] & (block - 1)).astype(np.int32), words.slice(at, end - at)))
    if held:
        yield range_blocks(place, held)


def counted(low: np.ndarray, words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; number, length, place among the terms and count of what each document holds; the lengths of texts that aren't null."""
    said, length = words.flatten().dictionary_encode(), pc.list_value_length(words)
    size = np.asarray(pc.fill_null(length, 0)).astype(np.int64)
    many = max(len(said.dictionary), 1)
    pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + np.asarray(said.indices), return_counts=True)
    row = pair // many
    return said.dictionary, low[row], size[row].astype(np.int32), pair % many, tf.astype(np.int32), np.asarray(length.drop_null()).astype(np.int32)


def range_blocks(place: int, held: Sequence[tuple]) -> pa.RecordBatch:
    """The blocks of a range from what its documents hold, in their order."""
    terms = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
    start = np.cumsum([0, *(len(h[0]) for h in held)])
    code = np.concatenate([np.asarray(terms.indices)[start[i] + h[3]] for i, h in enumerate(held)])
    order = np.argsort(code, kind="stable")  # documents stay in order
    ends = np.cumsum(np.bincount(code, minlength=len(terms.dictionary)))
    texts = np.concatenate([h[5] for h in held])

    def lists(at: int, more: np.ndarray) -> pa.Array:
        values = np.concatenate([np.concatenate([h[at] for h in held])[order], more])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends, [len(values)]]), pa.int32()), pa.array(values, pa.int32()))

    none = np.zeros(0, dtype=np.int32)
    every = pa.concat_arrays([terms.dictionary, pa.nulls(1, terms.dictionary.type)])
    columns = [every.cast(pa.string()), pa.array(np.full(len(every), place), pa.int64()), lists(1, none), lists(4, none), lists(2, texts)]
    return pa.RecordBatch.from_arrays(columns, names=["term", "range", "docs", "tfs", "lengths"])


def open_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats").first()
    return Index(spark, path, tuple(stats["order"]), stats["n"], stats["average"], stats["block"], stats["buckets"])


def term_frequencies(index: Index) -> DataFrame:
    """A4: (term, df) of all terms, from the heads of their blocks."""
    return blocks(index).groupBy("term").agg(F.sum("n").alias("df"))


def blocks(index: Index, terms: dict[str, int] | None = None) -> DataFrame:
    """The blocks, those of `terms` (with their buckets) only if given: these reach the scan as folders and literals."""
    if index.n == 0:
        return index.spark.createDataFrame([], "term string, range long, n int, best double, docs array<int>, tfs array<int>, lengths array<int>, bucket int")
    if terms is None:
        return index.postings
    return index.postings.filter(F.col("bucket").isin(sorted(set(terms.values()))) & F.col("term").isin(sorted(terms)))


@dataclass
class Asked:
    """A block of queries: their terms with weights (repeats times idf), and each term's bucket."""

    queries: dict[object, list[tuple[str, float]]]
    buckets: dict[str, int]
    kind: str

    def table(self, spark: SparkSession) -> DataFrame:
        each = [(q, t, w) for q, terms in self.queries.items() for t, w in terms]
        return local(spark, f"query_id {self.kind}, term string, weight double", *zip(*each, strict=True))


def ask(index: Index, said: Sequence[tuple[object, dict[str, int], dict[str, int]]], kind: str) -> Asked:
    """Queries (id, repeats of each term, buckets) with their weights; terms that no document holds are left out."""
    buckets = {t: b for _, _, own in said for t, b in own.items()}
    if not buckets:
        return Asked({}, {}, kind)
    df = {r["term"]: r["df"] for r in blocks(index, buckets).groupBy("term").agg(F.sum("n").alias("df")).collect()}
    idf = {t: math.log1p((index.n - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    queries = {q: sorted((t, times * idf[t]) for t, times in repeats.items() if t in idf) for q, repeats, _ in said}
    return Asked({q: terms for q, terms in queries.items() if terms}, {t: b for t, b in buckets.items() if t in df}, kind)


def bounds(index: Index, asked: Asked) -> DataFrame:
    """(query_id, range, bound): no document of the range has a larger score, but for rounding."""
    heads = blocks(index, asked.buckets).select("term", "range", "best").join(F.broadcast(asked.table(index.spark)), "term")
    return heads.groupBy("query_id", "range").agg(F.sum(F.col("weight") * F.col("best")).alias("bound"))


def scored(index: Index, asked: Asked, ranges: DataFrame, top_k: int, floors: dict[object, float], only: dict[int, set] | None = None, but: dict[int, set] | None = None) -> DataFrame:
    """(query_id, doc, score) of the best top_k documents (with ties) of each query in each of the ranges; none is under the query's floor.

    only: the queries of each range; but: the queries that a range has answered.
    """
    average, shift, queries = index.average, index.block.bit_length() - 1, asked.queries
    found = blocks(index, asked.buckets).join(F.broadcast(ranges) if only is not None else ranges, "range")
    opened = found.groupBy("range").agg(F.collect_list(F.struct("term", "docs", "tfs", "lengths")).alias("blocks"))
    kind = asked.table(index.spark).schema["query_id"].dataType
    schema = pa.schema([("query_id", to_arrow_type(kind)), ("doc", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = {}
                for b in own.values:
                    tf, length = (np.asarray(b[c].values, dtype=np.float64) for c in ("tfs", "lengths"))
                    term, doc, share = b["term"].as_py(), np.asarray(b["docs"].values), tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
                    if term in held:  # the range was read in more than one task
                        doc, share = (np.concatenate(x) for x in zip(held[term], (doc, share), strict=True))
                        order = np.argsort(doc)
                        doc, share = doc[order], share[order]
                    held[term] = (doc, share)
                ids, docs, scores = [], [], []
                for q in queries if only is None else only[place]:
                    if but is not None and q in but.get(place, ()):
                        continue
                    doc, score = best_documents([(w, *held[t]) for t, w in queries[q] if t in held], floors.get(q, 0.0), top_k)
                    ids += [q] * len(doc)
                    docs.append((place << shift) + doc.astype(np.int64))
                    scores.append(score)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(np.concatenate(docs)), pa.array(np.concatenate(scores))], schema=schema)

    return opened.select("range", "blocks").mapInArrow(run, f"query_id {asked.kind}, doc long, score double").withColumn("score", F.round("score", DIGITS)).filter("score > 0")


def best_documents(terms: Sequence[tuple[float, np.ndarray, np.ndarray]], floor: float, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores, best first, of the best top_k and of others that rounding may tie with them, among those that reach the floor.

    terms: weight, documents in order, and each one's share. Terms that together stay under the floor bring no document in.
    """
    by_bound = sorted(range(len(terms)), key=lambda i: terms[i][0] * terms[i][2].max())
    low, spare = 0.0, set()
    for i in by_bound:
        low += terms[i][0] * terms[i][2].max()
        if low >= floor - SLACK:
            break
        spare.add(i)
    bringing = [terms[i][1] for i in range(len(terms)) if i not in spare]
    if not bringing:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    docs = np.unique(np.concatenate(bringing))
    score = np.zeros(len(docs))
    for w, held, share in terms:
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        score += np.where(held[at] == docs, w * share[at], 0.0)
    least = max(floor - SLACK, np.partition(score, len(score) - top_k)[len(score) - top_k] - SLACK if len(score) > top_k else -1.0)
    docs, score = docs[score >= least], score[score >= least]
    # copies of a text have one score to the last bit: the first top_k of them are enough
    order = np.lexsort((docs, -score))
    change = np.concatenate([[0], np.flatnonzero(np.diff(score[order])) + 1]) if len(docs) else np.zeros(0, dtype=np.int64)
    copy = np.arange(len(docs)) - np.repeat(change, np.diff(np.append(change, len(docs))))
    kept = order[copy < top_k]
    return docs[kept], score[kept]


def best_of(found: DataFrame, top_k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def search_block(index: Index, asked: Asked, top_k: int, first: int = FIRST) -> list[tuple]:
    """(query_id, doc, score, rank) of a block of queries."""
    if not asked.queries:
        return []
    spark = index.spark
    bound = bounds(index, asked)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    started: dict[int, set] = {}
    for r in bound.withColumn("place", place).filter(F.col("place") <= first).collect():
        started.setdefault(r["range"], set()).add(r["query_id"])
    wanted = local(spark, "range long", started)
    # at most `first` ranges of top_k documents for each query of the block
    opened = best_of(scored(index, asked, wanted, top_k, {}, only=started), top_k).collect()
    floors = {r["query_id"]: r["score"] for r in opened if r["rank"] == top_k}
    rest = still_open(spark, asked, bound, floors, started)
    found = scored(index, asked, rest, top_k, floors, but=started).unionByName(local(spark, f"query_id {asked.kind}, doc long, score double", *([r[c] for r in opened] for c in ("query_id", "doc", "score"))))
    return [tuple(r) for r in best_of(found, top_k).select("query_id", "doc", "score", "rank").collect()]


def still_open(spark: SparkSession, asked: Asked, bound: DataFrame, floors: dict[object, float], started: dict[int, set]) -> DataFrame:
    """The ranges that may hold a document which some query's floor lets in, without those that have answered."""
    table = F.broadcast(local(spark, f"query_id {asked.kind}, floor double", asked.queries, [float(floors.get(q, 0.0)) for q in asked.queries]))
    answered = [(q, r) for r, own in started.items() for q in own]
    done = F.broadcast(local(spark, f"query_id {asked.kind}, range long", [q for q, _ in answered], [r for _, r in answered]))
    return bound.join(table, "query_id").filter(F.col("bound") + SLACK >= F.col("floor")).join(done, ["query_id", "range"], "left_anti").select("range").distinct()


def search_batch(index: Index, queries: DataFrame, top_k: int = 3, first: int = FIRST) -> DataFrame:
    """A5 for every query (query_id, text): query_id, the document's columns, score and rank; ties go by the order of the documents.

    Queries are taken in blocks of bounded size, each for one search over the index.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    spark, kind = index.spark, queries.schema["query_id"].dataType.simpleString()
    terms = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    each = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "times", bucket_of(F.col("term"), index.buckets).alias("bucket"))).alias("terms"))
    found, held, size = None, [], 0

    def searched() -> DataFrame:
        best = search_block(index, ask(index, held, kind), top_k, first)
        rows = local(spark, f"query_id {kind}, doc long, score double, rank int", *([b[i] for b in best] for i in range(4)))
        documents = index.documents.filter(F.col("doc").isin(sorted({b[1] for b in best})))
        return F.broadcast(rows).join(documents, "doc").select("query_id", *[c for c in documents.columns if c != "doc"], "score", "rank")

    for r in each.toLocalIterator():
        own = [(t["term"], t["times"], t["bucket"]) for t in r["terms"]]
        if held and size + len(own) > BLOCK_TERMS:
            part = checkpointed(searched())
            found, held, size = part if found is None else found.unionByName(part), [], 0
        held.append((r["query_id"], {t: n for t, n, _ in own}, {t: b for t, _, b in own}))
        size += len(own)
    last = searched()
    return last if found is None else found.unionByName(last)


def search_index(index: Index, query: str, top_k: int = 3) -> DataFrame:
    """The top_k documents of one query, with score and rank."""
    return search_batch(index, index.spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("text")), top_k).drop("query_id")
