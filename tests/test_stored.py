"""Vectors by cluster, token streams in blocks and epochs by permutation, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import retrieval, sampling
from lexmill.operators import vector_index as vi
from lexmill.sources import token_blocks as tb


def clustered(n=600, d=12, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    return [(i, (centres[i % 6] + spread * rng.standard_normal(d)).astype(np.float32).tolist()) for i in range(n)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("away", F.lit(1)).repartition(3)


def triples(frame):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_vector_index_equals_a_scan(spark, tmp_path, spread):
    rows = clustered(spread=spread) + [(9000, None), (9001, [0.0] * 12), (9002, clustered(spread=spread)[0][1]), (9003, [100.0] * 12)]
    frame = vectors(spark, rows)
    index = vi.write_vector_index(frame, f"file://{tmp_path}/v", clusters=8)
    assert index.vectors.count() == len(rows) - 1
    queries = frame.filter("vec_id % 20 = 0 OR vec_id > 8999").select(F.col("vec_id").alias("query_id"), "embedding")
    counted = spark.sparkContext.accumulator(0)
    found = triples(vi.search_vectors(index, queries, 5, counted=counted))
    assert found == triples(retrieval.dense_all(frame, queries, 5))
    assert found == triples(vi.search_vectors(index, queries, 5, block=7))
    whole = queries.filter("embedding IS NOT NULL").count() * (len(rows) - 1)
    assert counted.value < whole * (0.5 if spread < 1 else 1.0)
    assert triples(vi.search_vectors(vi.open_vector_index(spark, index.path), queries, 10**4)) == triples(retrieval.dense_all(frame, queries, 10**4))


def test_vectors_near_their_centre_are_not_multiplied(spark, tmp_path):
    far = [(i, [1.0, 0.01 * i]) for i in range(100)]
    index = vi.write_vector_index(vectors(spark, far), f"file://{tmp_path}/v", clusters=1)
    assert len(index.clusters) == 1
    counted = spark.sparkContext.accumulator(0)
    query = np.array([[0.0, 1.0]])
    got = {r["vec_id"] for r in vi.products(index, query, {index.clusters[0]: [0]}, np.array([0.97]), 3, counted).collect()}
    assert got == {97, 98, 99} and counted.value < 12


def test_copies_of_a_vector_make_few_rows(spark, tmp_path):
    rows = [(i, [1.0, 0.0]) for i in range(500, 0, -1)] + [(900, [0.0, 1.0])]
    frame = vectors(spark, rows).coalesce(1)
    queries = np.array([[1.0, 0.0], [0.5, 0.1]])
    scan = retrieval.dense_batch(frame, queries, 3)
    assert sorted(tuple(r) for r in scan.select("query_id", "vec_id", "rank").collect()) == [(q, i, i) for q in (0, 1) for i in (1, 2, 3)]
    index = vi.write_vector_index(frame, f"file://{tmp_path}/v", clusters=2)
    found = vi.products(index, queries, {c: [0, 1] for c in index.clusters}, np.full(2, -np.inf), 3)
    assert found.count() <= 4 * 2 * 3 and vi.search_block(index, queries, 3).filter("query = 0").orderBy("rank").first()["vec_id"] == 1


def test_best_rows_by_key():
    import pyarrow as pa

    scores = np.array([[1.0, 2.0], [1.0, 0.0], [1.0, 2.0], [0.0, 2.0]])
    for keys, expected in ((pa.array([5, 4, 3, 9]), {(2, 0), (1, 0), (2, 1), (0, 1)}), (pa.array(["b", None, "a", "c"]), {(1, 0), (2, 0), (2, 1), (0, 1)}), (pa.array([{"s": "x", "t": "b"}, {"s": "w", "t": "z"}, {"s": "x", "t": "a"}, {"s": "y", "t": ""}]), {(1, 0), (2, 0), (2, 1), (0, 1)})):
        at, column = retrieval.best_rows(scores, retrieval.keys_of(keys), 2)
        assert set(zip(at.tolist(), column.tolist(), strict=True)) == expected


def test_vector_index_of_odd_tables(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id int, embedding array<float>")
    for i, rows in enumerate(([], [(1, None)], [(1, [1.0, 2.0])] * 4)):
        index = vi.write_vector_index(vectors(spark, rows), f"file://{tmp_path}/v{i}")
        assert vi.search_vectors(index, queries, 3).count() == min(3, len([r for r in rows if r[1]]))
    assert vi.search_vectors(index, queries.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        vi.write_vector_index(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]), f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        vi.search_vectors(index, queries, 0)


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_windows_of_a_stream(spark, tmp_path, block):
    r = random.Random(block)
    rows = [(i, [r.randrange(65536) for _ in range(r.choice([0, 1, 5, 60]))]) for i in range(150)] + [(500, None), (501, [7] * 400)]
    flat = [x for _, ids in rows for x in ids or []]
    frame = spark.createDataFrame(rows, "doc_id long, tokens array<int>").withColumn("block", F.lit("x")).repartition(4)
    stream = tb.write_token_blocks(frame, f"file://{tmp_path}/s", ["doc_id"], block=block)
    assert stream.total == len(flat) and stream.table.count() == -(-len(flat) // block)
    places = [0, 1, len(flat) - 20, len(flat) - 19, len(flat), -1, *(r.randrange(len(flat)) for _ in range(40))]
    found = tb.read_at(stream, spark.createDataFrame(list(enumerate(places)), "n int, position long"), 20).collect()
    assert sorted((x["n"], x["ids"]) for x in found) == [(n, flat[p : p + 20]) for n, p in enumerate(places) if 0 <= p <= len(flat) - 20]


def test_streams_of_odd_tables(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, list(range(i))) for i in range(60)], "doc_id long, tokens array<int>")
    none = tb.write_token_blocks(frame.limit(0), f"file://{tmp_path}/s", ["doc_id"])
    assert none.total == 0 and tb.stream_windows(none, spark.range(3).withColumnRenamed("id", "draw"), 4, 1).count() == 0
    stream = tb.write_token_blocks(frame, f"file://{tmp_path}/s", ["doc_id"], block=16)
    drawn = tb.stream_windows(stream, spark.range(50).withColumnRenamed("id", "draw"), 8, 1).collect()
    flat = [x for i in range(60) for x in range(i)]
    assert len(drawn) == 50 and all(x["x"] == flat[x["start"] : x["start"] + 8] and x["y"] == flat[x["start"] + 1 : x["start"] + 9] for x in drawn)
    monkeypatch.setattr(tb, "NAMED_BLOCKS", 3)
    assert sorted(map(str, tb.stream_windows(stream, spark.range(50).withColumnRenamed("id", "draw"), 8, 1).collect())) == sorted(map(str, drawn))
    with pytest.raises(Exception, match="two bytes"):
        tb.write_token_blocks(spark.createDataFrame([(1, [70000])], "doc_id long, tokens array<int>"), f"file://{tmp_path}/bad", ["doc_id"])
    # a window names its blocks to the scan
    plan = stream.table.filter(F.col("block").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(block), EqualTo(block,3)]" in plan or "In(block" in plan


def test_permuted_epochs(spark):
    for n in (1, 2, 3, 10, 97, 256, 1000):
        rows = spark.range(n).withColumnRenamed("id", "row")
        epochs = [[r["place"] for r in sampling.permuted_epoch(rows, n, 8, e, s).orderBy("row").collect()] for e, s in ((0, 1), (1, 1), (0, 2), (0, 1))]
        assert all(sorted(e) == list(range(n)) for e in epochs) and epochs[0] == epochs[3]
        assert n < 97 or len({tuple(e) for e in epochs}) == 3
        back = rows.select(sampling.permuted(sampling.permuted("row", n, 5, 9), n, 5, 9, back=True).alias("x"), "row").filter("x <> row")
        assert back.count() == 0
    # places look drawn at random: about one fixed point, and neighbours part
    assert sum(i == p for i, p in enumerate(epochs[0])) < 10 and abs(np.corrcoef(range(n), epochs[0])[0, 1]) < 0.1
    assert np.mean(np.abs(np.diff(epochs[0]))) == pytest.approx(n / 3, rel=0.1)


def test_epochs_move_nothing(spark):
    docs = spark.createDataFrame([(f"k{i:03d}", i) for i in range(100)], "key string, value int").repartition(5)
    stored = sampling.numbered(docs, ["key"])
    assert [(r["row"], r["value"]) for r in stored.orderBy("row").collect()] == [(i, i) for i in range(100)]
    epoch = sampling.permuted_epoch(stored, 100, 16, 3, 7)
    assert "Exchange" not in epoch._jdf.queryExecution().executedPlan().toString()
    by_batch = {b: sorted((r["place"], r["key"]) for r in epoch.filter(F.col("batch") == b).collect()) for b in range(7)}
    assert [len(v) for v in by_batch.values()] == [16] * 6 + [4]
    for b in (0, 3, 6, 7):
        assert sorted((r["place"], r["key"]) for r in sampling.epoch_batch(stored, 100, 16, b, 3, 7).collect()) == by_batch.get(b, [])
