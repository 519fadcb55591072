"""Exact vector search over stored clusters.

An index holds every vector in the folder of its nearest centre, with its distance from it, the farthest first. For a query q, no vector x
at distance r from centre c has a product above q.c + |q| r. So the clusters whose centres answer best are scored first, and the k-th
product is the floor: a cluster whose radius keeps it under the floor isn't read, and in those that are read only vectors that lie far
enough from their centre are multiplied. Results are those of a scan.

Centres are fitted to a bounded sample (SAMPLE vectors, those with the least hashes of their keys); every vector is stored. A cluster may hold a third of all
vectors: it's sorted by ranges, so several tasks write and read it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources.sinks import replace
from .postings import local
from .retrieval import BLOCK_QUERIES, DIGITS, best_rows, keys_of

SAMPLE = 20_000
CLUSTERS = 32
ROUNDS = 10
#: What rounding may hide between a bound and a product.
SLACK = 2 * 10.0**-DIGITS


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    key: str
    #: Of each cluster that holds vectors: its number, centre, radius and how many it holds.
    clusters: list[int]
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @cached_property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def fit_centres(points: np.ndarray, clusters: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds, begun with points drawn far from each other; as many as there are distinct points at most."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    if len(distinct) <= clusters:
        return distinct
    centres = distinct[[rng.integers(len(distinct))]]
    away = ((distinct - centres[0]) ** 2).sum(axis=1)
    while len(centres) < clusters and away.sum() > 0:
        centres = np.vstack([centres, distinct[rng.choice(len(distinct), p=away / away.sum())]])
        away = np.minimum(away, ((distinct - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        nearest, _ = nearest_centres(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each point's nearest centre and the distance from it."""
    near = (-2 * points @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(axis=1))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, whose lists have one length."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def write_vector_index(vectors: DataFrame, path: str, key: str = "vec_id", clusters: int = CLUSTERS, sample: int = SAMPLE, seed: int = 0) -> VectorIndex:
    """Store (key, embedding) by cluster; the index takes the place of one at `path` when it is whole. Null vectors are left out."""
    spark = vectors.sparkSession
    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    sizes = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError("vectors differ in length")
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), key), "embedding").limit(sample).select("embedding").toArrow()
    points = matrix(drawn.column(0).combine_chunks()) if drawn.num_rows else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(fit_centres(points, clusters, seed=seed) if len(points) else points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, away = nearest_centres(matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], names=[key, "embedding", "cluster", "away"])

    def write(rows: DataFrame, to: str) -> None:
        placed = checkpointed(rows.mapInArrow(place, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>, cluster int, away double"))
        placed.repartitionByRange("cluster", F.desc("away")).sortWithinPartitions("cluster", F.desc("away"), key).write.partitionBy("cluster").parquet(f"{to}/vectors")
        held = placed.groupBy("cluster").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()
        made = local(spark, "cluster int, centre array<double>, radius double, n long", [r["cluster"] for r in held], [shared.value[r["cluster"]].tolist() for r in held], [r["radius"] for r in held], [r["n"] for r in held])
        made.withColumn("key", F.lit(key)).write.parquet(f"{to}/clusters")

    replace(rows, path, write)
    return open_vector_index(spark, path, key)


def open_vector_index(spark: SparkSession, path: str, key: str = "vec_id") -> VectorIndex:
    held = spark.read.parquet(f"{path}/clusters").orderBy("cluster").collect()
    centres = np.array([r["centre"] for r in held]) if held else np.zeros((0, 1))
    return VectorIndex(spark, path, key, [r["cluster"] for r in held], centres, np.array([r["radius"] for r in held]), np.array([r["n"] for r in held], dtype=np.int64))


def products(index: VectorIndex, queries: np.ndarray, wanted: dict[int, list[int]], floors: np.ndarray, top_k: int, counted: Accumulator | None = None) -> DataFrame:
    """(query, key, score) of the best top_k of each query in each batch of the clusters that it wants, none under its floor.

    queries: a row for each; wanted: numbers of queries by cluster. `counted` adds up the products that were worked out.
    """
    spark, key = index.spark, index.key
    place = {c: i for i, c in enumerate(index.clusters)}
    at_centre, norms = queries @ index.centres.T, np.linalg.norm(queries, axis=1)
    # a vector nearer to its centre than this can't reach the query's floor
    needed = {c: (floors[own] - SLACK - at_centre[own, place[c]]) / np.maximum(norms[own], 1e-300) for c, own in wanted.items()}
    least = {c: float(x.min()) for c, x in needed.items()}
    shared = spark.sparkContext.broadcast((queries, {c: np.array(own) for c, own in wanted.items()}, needed))
    chosen = index.vectors.filter(F.col("cluster").isin(sorted(wanted)) & (F.col("away") >= min(least.values(), default=0.0)))
    chosen = chosen.join(F.broadcast(local(spark, "cluster int, least double", list(least), list(least.values()))), "cluster").filter("away >= least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own, far = shared.value
        for batch in batches:
            keys = keys_of(batch.column(0))
            points, away, cluster = matrix(batch.column(1)), np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for c in np.unique(cluster):
                rows = np.flatnonzero(cluster == c)
                rows = rows[np.argsort(-away[rows], kind="stable")]
                # the farthest come first, so each query wants a beginning of them
                many = np.searchsorted(-away[rows], -far[c], side="right")
                for n in np.unique(many[many > 0]):
                    some = own[c][many == n]
                    scores = np.round(points[rows[:n]] @ asked[some].T, DIGITS)
                    if counted is not None:
                        counted.add(int(scores.size))
                    scores[scores < floors[some] - SLACK] = -np.inf
                    at, query = best_rows(scores, keys.take(pa.array(rows[:n])), top_k)
                    yield pa.RecordBatch.from_arrays([pa.array(some[query], pa.int64()), batch.column(0).take(pa.array(rows[at])), pa.array(scores[at, query])], names=["query", key, "score"])

    return chosen.select(key, "embedding", "away", "cluster").mapInArrow(run, f"query long, {key} {dict(index.vectors.dtypes)[key]}, score double")


def best_of(found: DataFrame, key: str, top_k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def search_block(index: VectorIndex, queries: np.ndarray, top_k: int, counted: Accumulator | None = None) -> DataFrame:
    """(query, key, score, rank) of a block of queries, the rows of a matrix that the caller bounds."""
    near = queries @ index.centres.T
    bound = near + np.linalg.norm(queries, axis=1)[:, None] * index.radii
    started: dict[int, list[int]] = {}
    for q, order in enumerate(np.argsort(-near, axis=1, kind="stable")):
        # as many of the best clusters as give the query a floor
        for i in order[: 1 + np.searchsorted(np.cumsum(index.sizes[order]), top_k)]:
            started.setdefault(index.clusters[i], []).append(q)
    opened = checkpointed(best_of(products(index, queries, started, np.full(len(queries), -np.inf), top_k, counted), index.key, top_k))
    floors = np.full(len(queries), -np.inf)
    for r in opened.filter(F.col("rank") == top_k).select("query", "score").collect():
        floors[r["query"]] = r["score"]
    rest: dict[int, list[int]] = {}
    for i, c in enumerate(index.clusters):
        own = [q for q in np.flatnonzero(bound[:, i] + SLACK >= floors).tolist() if q not in started.get(c, ())]
        if own:
            rest[c] = own
    if not rest:
        return opened
    return best_of(opened.drop("rank").unionByName(products(index, queries, rest, floors, top_k, counted)), index.key, top_k)


def search_vectors(index: VectorIndex, queries: DataFrame, top_k: int, block: int = BLOCK_QUERIES, counted: Accumulator | None = None) -> DataFrame:
    """L4 for every query (query_id, embedding): query_id, key, score and rank, ties by key. Queries are taken in blocks of bounded size."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    spark, kind = index.spark, queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL").toLocalIterator()
    found = None
    while index.clusters and (held := list(islice(asked, block))):
        ids: Sequence = [r["query_id"] for r in held]
        best = search_block(index, np.array([r["embedding"] for r in held], dtype=np.float64), top_k, counted=counted)
        names = F.broadcast(local(spark, f"query long, query_id {kind}", range(len(ids)), ids))
        part = checkpointed(best.join(names, "query").select("query_id", index.key, "score", "rank"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = queries.select("query_id").dtypes[0][1]
        return spark.createDataFrame([], f"query_id {kinds}, {index.key} {dict(index.vectors.dtypes)[index.key] if index.clusters else 'long'}, score double, rank int")
    return found
