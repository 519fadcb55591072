"""Chunk tables, BM25, dense and hybrid retrieval.

Statistics of the corpus are one row or one row for each query term; scores are columns of the chunk table, so one query is two
scans and a top-k, and nothing but the top k rows of each task is moved. Many queries at once meet the chunks by term.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import content_terms, tokens
from ..functions.udfs import chunk, cuts, embedded
from ..session import checkpointed, written

K1 = 1.2
B = 0.75
#: Scores are rounded so that the order of additions can't change a ranking.
DIGITS = 6
#: Query terms in one broadcast, and in one matrix of a task.
BLOCK_TERMS, PART_TERMS = 200_000, 8192
#: Rows whose words are counted at once, and their words unless it is one row.
SLICE, SLICE_WORDS = 2048, 1 << 19
#: Rows scored at once, and cells of their matrix unless it is one row.
SCORED_ROWS, SCORED_CELLS = 1024, 1 << 22
#: Query vectors in one broadcast.
BLOCK_QUERIES = 256


def build_chunks(docs: DataFrame, size: int = 600, overlap: int = 80, source: str = "source", order: str = "doc_id") -> DataFrame:
    """(doc_id, source, chunk_idx, text), in the order of the documents."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")
    exploded = docs.select(F.col(order).alias("doc_id"), F.col(source).alias("source"), F.posexplode(chunk("text", size, overlap)).alias("chunk_idx", "text"))
    return exploded.select("doc_id", "source", "chunk_idx", "text")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """P8 of the query, repeats kept."""
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def term_statistics(chunks: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A4: (term, df) over all chunks, and one row (n, average_length)."""
    counted = chunks.select(tokens(text).alias("tokens"))
    df = counted.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df, counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("average_length"))


def occurrences(tokens_column: str, term: str) -> Column:
    return F.size(F.filter(tokens_column, lambda x: x == F.lit(term)))


def weight(tf: Column, length: Column, idf: Column, average: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25(chunks: DataFrame, query: str, top_k: int | None = 3, order: Sequence[str] = ("doc_id", "chunk_idx")) -> DataFrame:
    """A5, L3: the top_k chunks with a score above 0, best first, ties in the order of the chunks; adds score and rank."""
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")
    spark = chunks.sparkSession
    asked = query_terms(spark, query)
    distinct = sorted(set(asked))
    repeats = {t: asked.count(t) for t in distinct}
    found = chunks.withColumn("tokens_", tokens("text")).withColumn("length_", F.size("tokens_"))
    for i, t in enumerate(distinct):
        found = found.withColumn(f"tf{i}_", occurrences("tokens_", t))
    found = found.drop("tokens_")
    stats = found.agg(F.count(F.lit(1)).alias("n"), F.avg("length_").alias("average"), *[F.count_if(F.col(f"tf{i}_") > 0).alias(f"df{i}") for i in range(len(distinct))]).first()
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        idf = math.log1p((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}_")
        score = score + F.when(tf > 0, F.lit(float(repeats[t])) * weight(tf, F.col("length_"), F.lit(idf), F.lit(stats["average"] or 1.0))).otherwise(0.0)
    scored = found.select(*chunks.columns, F.round(score, DIGITS).alias("score"))
    if top_k is None:
        return ranked(scored.filter("score > 0"), None, order)
    # the cut comes first: a filter below it would be pushed down and count the tokens again for each term
    return ranked(scored, top_k, order).filter("score > 0")


def ranked(scored: DataFrame, top_k: int | None, order: Sequence[str]) -> DataFrame:
    """The best top_k rows (all if None) with their rank, ties by `order`."""
    by = [F.desc("score"), *order]
    best = scored.orderBy(*by) if top_k is None else scored.orderBy(*by).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def held_terms(rows: DataFrame, key: Sequence[str], words: Column, vocabulary: Sequence[str]) -> DataFrame:
    """(key, length, ids, tfs): for each row the number of its words (null for none) and places in a bounded vocabulary with their counts, by place.
    Nothing is moved: a row's words are counted where it is read, and what is left of them is written."""
    shared = rows.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))
    chosen = rows.select(F.struct(*key).alias("key"), words.alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, end - at) for b in batches for at, end in cuts(np.asarray(pc.fill_null(pc.list_value_length(b.column(1)), 0)), SLICE, SLICE_WORDS)):
            said, length = batch.column(1), pc.list_value_length(batch.column(1))
            size = np.asarray(pc.fill_null(length, 0)).astype(np.int64)
            ids = np.asarray(pc.fill_null(pc.index_in(said.flatten(), value_set=shared.value), -1)).astype(np.int64)
            many = max(len(shared.value), 1)
            pair, tf = np.unique((np.repeat(np.arange(len(size)), size) * many + ids)[ids >= 0], return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pair // many, minlength=len(size)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pair % many, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), length.cast(pa.int32()), *lists], names=["key", "length", "ids", "tfs"])

    return written(chosen.mapInArrow(run, f"key {chosen.schema['key'].dataType.simpleString()}, length int, ids array<int>, tfs array<int>"))


def frequencies(held: DataFrame, n: int) -> np.ndarray:
    """In how many rows of held_terms() each of the n words of its vocabulary stands."""
    df = np.zeros(n, dtype=np.int64)
    for r in held.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        df[r["id"]] = r["count"]
    return df


def term_blocks(each: DataFrame, size: int) -> Iterator[list[tuple[object, list]]]:
    """(id, terms) of a table in blocks of at most `size` terms, or one row."""
    block, n = [], 0
    for key, terms in each.toLocalIterator():
        if block and n + len(terms) > size:
            yield block
            block, n = [], 0
        block.append((key, terms))
        n += len(terms)
    if block:
        yield block


def bm25_batch(chunks: DataFrame, queries: DataFrame, top_k: int = 3, order: Sequence[str] = ("doc_id", "chunk_idx")) -> DataFrame:
    """BM25 of every query (query_id, text) against all chunks: query_id, the chunk's columns, score and rank.

    Queries are taken in blocks of bounded size. For a block chunks are tokenised once; what they hold of its terms is written, scored where
    it is read, and a task passes on a query's best top_k rows only, so neither words nor pairs of query and chunk are moved.
    """
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    each = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "times")).alias("terms"))
    found = None
    for block in term_blocks(each, BLOCK_TERMS):
        part = best_scores(chunks, block, to_arrow_type(queries.schema["query_id"].dataType), queries.schema["query_id"].dataType.simpleString(), top_k, order)
        # written before the next block is read, so that one block at a time is held
        found = checkpointed(part) if found is None else found.unionByName(checkpointed(part))
    if found is None:
        found = queries.select("query_id").crossJoin(chunks.select(*order)).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0)).limit(0)
    return found.join(chunks, list(order))


def best_scores(chunks: DataFrame, block: Sequence[tuple[object, list]], kind: pa.DataType, name: str, top_k: int, order: Sequence[str]) -> DataFrame:
    """(query_id, order, score, rank) of the best top_k chunks of each query of a block."""
    vocabulary = sorted({t["term"] for _, terms in block for t in terms})
    at = {t: i for i, t in enumerate(vocabulary)}
    held = held_terms(chunks, order, tokens("text"), vocabulary)
    n, average = held.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = frequencies(held, len(vocabulary))
    idf = np.where(df > 0, np.log1p((n - df + 0.5) / (df + 0.5)), 0.0)
    asked = [(q, np.array([at[t["term"]] for t in terms]), np.array([t["times"] for t in terms], dtype=np.float64)) for q, terms in block]
    shared = chunks.sparkSession.sparkContext.broadcast([(q, ids, times * idf[ids]) for q, ids, times in asked])
    words = len(vocabulary)
    average = average or 1.0

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = query_parts(shared.value, words)
        floors = [np.full(len(part[0]), -np.inf) for part in parts]
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column(2))).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            ids, tf = (np.asarray(batch.column(i).flatten()) for i in (2, 3))
            length = np.repeat(np.asarray(pc.fill_null(batch.column(1), 0)), size)
            share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
            for (queries_, place, weights), floor in zip(parts, floors, strict=True):
                step = max(1, min(SCORED_ROWS, SCORED_CELLS // max(len(weights), 1)))
                for a in range(0, len(size), step):
                    b = min(a + step, len(size))
                    column, own = place[ids[start[a] : start[b]]], share[start[a] : start[b]]
                    row = np.repeat(np.arange(b - a), size[a:b])
                    table = np.zeros((b - a, len(weights)))
                    table[row[column >= 0], column[column >= 0]] = own[column >= 0]
                    scores = np.round(table @ weights, DIGITS)
                    # a row under the k-th best score that the task has seen isn't among the best
                    scores[(scores <= 0) | (scores < floor)] = -np.inf
                    keys = batch.column(0).slice(a, b - a)
                    r, q = best_rows(scores, keys_of(keys), top_k)
                    if not len(r):
                        continue
                    full = np.bincount(q, minlength=len(floor)) == top_k
                    least = np.full(len(floor), np.inf)
                    np.minimum.at(least, q, scores[r, q])
                    floor[full] = least[full]
                    yield pa.RecordBatch.from_arrays([pa.array([queries_[i] for i in q], kind), keys.take(pa.array(r)), pa.array(scores[r, q])], names=["query_id", "key", "score"])

    found = held.mapInArrow(best, f"query_id {name}, key {held.schema['key'].dataType.simpleString()}, score double").select("query_id", *[F.col("key")[c].alias(c) for c in order], "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def query_parts(asked: Sequence[tuple[object, np.ndarray, np.ndarray]], words: int) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """Queries in parts of bounded size: ids, each word's row in the part's matrix (or -1) and the matrix of weights, a column for each query."""
    parts, held, n = [], [], 0
    for q in [*asked, None]:
        if held and (q is None or len(held) == BLOCK_QUERIES or n + len(q[1]) > PART_TERMS):
            used = np.unique(np.concatenate([ids for _, ids, _ in held]))
            place = np.full(words, -1)
            place[used] = np.arange(len(used))
            weights = np.zeros((len(used), len(held)))
            for i, (_, ids, w) in enumerate(held):
                weights[place[ids], i] = w
            parts.append(([key for key, _, _ in held], place, weights))
            held, n = [], 0
        if q is not None:
            held.append(q)
            n += len(q[1])
    return parts


def dense(vectors: DataFrame, query: Sequence[float], top_k: int, order: Sequence[str] = ("vec_id",)) -> DataFrame:
    """L4: the top_k rows by the product of embedding and query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    product = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return ranked(vectors.select(*[c for c in vectors.columns if c != "embedding"], F.round(product, DIGITS).alias("score")), top_k, order)


def keys_of(column: pa.Array) -> pa.Array:
    """A column that sorts as keys do: a struct by its fields in turn."""
    if not pa.types.is_struct(column.type):
        return column
    fields = pa.table(column.flatten(), names=[str(i) for i in range(column.type.num_fields)])
    order = pc.sort_indices(fields, sort_keys=[(n, "ascending") for n in fields.column_names], null_placement="at_start")
    place = np.empty(len(column), dtype=np.int64)
    place[np.asarray(order)] = np.arange(len(column))
    return pa.array(place)


def best_rows(scores: np.ndarray, keys: pa.Array, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best top_k scores of each column, ties by key, nulls first; scores of minus infinity never."""
    many = len(scores) > top_k
    least = np.partition(scores, len(scores) - top_k, axis=0)[len(scores) - top_k] if many else np.full(scores.shape[1], -np.inf)
    at, column = np.nonzero((scores >= least) & (scores > -np.inf))
    place = np.empty(len(keys), dtype=np.int64)
    place[np.asarray(pc.sort_indices(keys, null_placement="at_start"))] = np.arange(len(keys))
    order = np.lexsort((place[at], -scores[at, column], column))
    at, column = at[order], column[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1]) if len(column) else np.zeros(0, dtype=np.int64)
    number = np.arange(len(column)) - np.repeat(first, np.diff(np.append(first, len(column))))
    return at[number < top_k], column[number < top_k]


def dense_batch(vectors: DataFrame, queries: np.ndarray, top_k: int, key: str = "vec_id") -> DataFrame:
    """L4 for a block of queries (one for each row of a matrix that the caller bounds): query_id, key, score and rank."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(queries, dtype=np.float64))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack(batch.column(1).to_pylist()).astype(np.float64)
            scores = np.round(points @ shared.value.T, DIGITS)
            at, query = best_rows(scores, keys_of(batch.column(0)), top_k)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), batch.column(0).take(pa.array(at)), pa.array(scores[at, query])], names=["query_id", key, "score"])

    kind = dict(vectors.dtypes)[key]
    found = vectors.select(key, "embedding").filter("embedding IS NOT NULL").mapInArrow(best, f"query_id long, {key} {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def dense_all(vectors: DataFrame, queries: DataFrame, top_k: int, key: str = "vec_id", block: int = BLOCK_QUERIES) -> DataFrame:
    """L4 for every query (query_id, embedding) of a table of any size: blocks of bounded size, each broadcast for one pass over all vectors."""
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL").toLocalIterator()
    found = None
    while held := list(islice(asked, block)):
        ids = F.array(*[F.lit(r["query_id"]) for r in held])
        # written before the next block is read, so that one block at a time is held
        part = checkpointed(dense_batch(vectors, np.array([r["embedding"] for r in held], dtype=np.float64), top_k, key).withColumn("query_id", F.get(ids, F.col("query_id").cast("int"))))
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = dict(vectors.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
        return vectors.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double, rank int")
    return found


def embed_chunks(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], model: str) -> DataFrame:
    """E5, K7: chunks with unit vectors and the model's name."""
    return chunks.withColumn("embedding", embedded("text", encode)).withColumn("model", F.lit(model))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Unit vector of the mean of the token vectors whose mask is 1."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: x / norm)


def fuse(rankings: Sequence[DataFrame], top_k: int | None = None, constant: int = 60, key: Sequence[str] = ("source", "text")) -> DataFrame:
    """Reciprocal rank fusion of rankings (key columns and rank); ties go to the list and rank that came first."""
    union = None
    for i, r in enumerate(rankings):
        part = r.select(*key, "rank", F.lit(i).alias("list_id"))
        union = part if union is None else union.unionByName(part)
    if union is None:
        raise ValueError("no rankings")
    fused = union.groupBy(*key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_id", "rank")).alias("first_"))
    return ranked(fused, top_k, ["first_"]).drop("first_")


def rerank(hits: DataFrame, query: str, score: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """Hits by the scores that an injected model gives to (query, text); hits with equal scores keep their order."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([float(x) for x in score([(query, t) for t in batch])])

    return ranked(hits.drop("score").withColumn("score", run("text")).withColumnRenamed("rank", "rank_"), None, ["rank_"]).drop("rank_")


def enough_evidence(hits: DataFrame, least: float = 1.0) -> bool:
    """the best score reaches least (0: always)."""
    return least <= 0 or (hits.agg(F.max("score")).first()[0] or 0.0) >= least


def direct_evidence(query: Column | str, texts: Column, least: int = 2) -> Column:
    """some text of an array shares at least `least` content terms with the query."""
    asked = content_terms(query)
    return (F.size(asked) > 0) & F.exists(texts, lambda t: F.size(F.array_intersect(asked, content_terms(t))) >= least)


def search(chunks: DataFrame, query: str, mode: str = "bm25", top_k: int = 3, candidates: int = 20, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, scorer: Callable | None = None, least: float = 1.0) -> DataFrame:
    """The retrieval query: lexical candidates and evidence gate, then lexical, dense or hybrid ranking, reranking and cut."""
    if mode not in ("bm25", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    wide = max(top_k, candidates)
    lexical = bm25(chunks, query, wide)
    if not enough_evidence(lexical, least):
        raise ValueError("no chunk is evidence enough for this query")
    hits = lexical
    if mode != "bm25":
        if vectors is None or query_vector is None:
            raise ValueError(f"mode {mode} needs vectors and a query vector")
        near = dense(vectors, query_vector, wide, order=["source", "text"])
        hits = near if mode == "vector" else fuse([lexical, near], wide)
    if scorer is not None:
        hits = rerank(hits, query, scorer)
    return hits.filter(F.col("rank") <= top_k).select("rank", "source", "text", "score").withColumn("scorer", F.lit("rerank" if scorer else mode))


def fuse_many(rankings: Sequence[DataFrame], top_k: int, constant: int = 60, key: Sequence[str] = ("source", "text")) -> DataFrame:
    """A6, L5 for many queries: fuse() of each query_id's rankings (query_id, key columns and rank)."""
    parts = [r.select("query_id", *key, "rank", F.lit(i).alias("list_id")) for i, r in enumerate(rankings)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", *key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_id", "rank")).alias("first_"))
    return ranked_many(fused, top_k, ["first_"]).drop("first_")


def ranked_many(scored: DataFrame, top_k: int, order: Sequence[str]) -> DataFrame:
    """The best top_k rows of each query_id with their rank; the bound on the rank is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def rerank_many(hits: DataFrame, queries: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], top_k: int) -> DataFrame:
    """L6 for many queries: each query's hits by the scores that an injected model gives to (query, text); equal scores keep their order."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, texts in batches:
            yield pd.Series([float(x) for x in score(list(zip(asked, texts, strict=True)))])

    said = queries.select("query_id", F.col("text").alias("asked_"))
    scored = hits.drop("score").withColumnRenamed("rank", "rank_").join(said, "query_id").withColumn("score", run("asked_", "text"))
    return ranked_many(scored.drop("asked_"), top_k, ["rank_"]).drop("rank_")


def search_many(chunks: DataFrame, queries: DataFrame, mode: str = "bm25", top_k: int = 3, candidates: int = 20, vectors: DataFrame | None = None, scorer: Callable | None = None, least: float = 1.0, key: Sequence[str] = ("source", "text"), order: Sequence[str] = ("doc_id", "chunk_idx"), lexical: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """search() of a whole table of queries (query_id, text and, but for mode bm25, embedding) in one plan.

    query_id, rank, key columns, score and scorer; a query without evidence enough has no rows. key names what chunks and vectors have in
    common. lexical(queries, k) stands in for the scan that finds lexical candidates, such as a stored index's search.
    """
    if mode not in ("bm25", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "bm25" and (vectors is None or "embedding" not in queries.columns):
        raise ValueError(f"mode {mode} needs vectors and a vector of each query")
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    wide = max(top_k, candidates)
    found = checkpointed((lexical(queries, wide) if lexical else bm25_batch(chunks, queries, wide, order)).select("query_id", *key, "score", "rank"))
    enough = queries.select("query_id").distinct() if least <= 0 else found.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= least).select("query_id")
    hits = found
    if mode != "bm25":
        named = vectors.select(F.struct(*key).alias("key_"), "embedding")
        near = dense_all(named, queries.join(enough, "query_id", "left_semi"), wide, "key_").select("query_id", *[F.col("key_")[c].alias(c) for c in key], "score", "rank")
        hits = near if mode == "vector" else fuse_many([found, near], wide, key=key)
    hits = hits.join(enough, "query_id", "left_semi")
    if scorer is not None:
        hits = rerank_many(hits, queries, scorer, top_k)
    return hits.filter(F.col("rank") <= top_k).select("query_id", "rank", *key, "score", F.lit("rerank" if scorer else mode).alias("scorer"))
