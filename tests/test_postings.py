"""The stored index gives what a scan gives, from fewer blocks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import postings as p
from lexmill.operators import retrieval as r

KEYS = ["doc_id", "chunk_idx"]


def corpus(spark, n=400, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i // 3, i % 3, "s", " ".join(rnd.choices(words, weights, k=rnd.randint(0, 40)))) for i in range(n)]
    rows += [(n, 0, "s", None), (n, 1, "s", ""), (n + 1, 0, "s", "rare w0 w0"), (n + 2, 0, "s", "rare w0 w0"), (n + 3, 0, None, "線性注意力 kernel"), (None, 0, "s", "w1 w2"), (n + 4, 0, "s", "w0 " * 5000)]
    return spark.createDataFrame(rows, "doc_id long, chunk_idx int, source string, text string").repartition(4)


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    frame = corpus(spark)
    return frame, p.write_index(frame, f"file://{tmp_path_factory.mktemp('index')}/i", block=16, buckets=8)


def as_rows(frame, extra=()):
    return sorted((*[x[c] for c in extra], x["rank"], str(x["doc_id"]), x["chunk_idx"], x["score"]) for x in frame.collect())


@pytest.mark.parametrize(("query", "k"), [("w0 w1 w2 w0", 3), ("rare w0", 50), ("注意", 1), ("", 3), ("w1 zzz", 400)])
def test_search_equals_a_scan(held, query, k):
    frame, index = held
    assert as_rows(p.search_index(index, query, k)) == as_rows(r.bm25(frame, query, k))


def test_batch_equals_scans(spark, held, monkeypatch):
    frame, index = held
    rnd = random.Random(2)
    queries = [(i, " ".join(rnd.choices([f"w{j}" for j in range(60)] + ["rare"], k=rnd.randint(0, 6)))) for i in range(6)] + [(90, None)]
    table = spark.createDataFrame(queries, "query_id int, text string")
    expected = sorted((q, *row) for q, text in queries if text for row in as_rows(r.bm25(frame, text, 4)))
    assert as_rows(p.search_batch(index, table, 4), ["query_id"]) == expected
    monkeypatch.setattr(p, "BLOCK_TERMS", 9)
    assert as_rows(p.search_batch(index, table, 4), ["query_id"]) == expected


def test_statistics(held):
    frame, index = held
    assert {tuple(x) for x in p.term_frequencies(index).collect()} == {tuple(x) for x in r.term_statistics(frame)[0].collect()}
    n, average = r.term_statistics(frame)[1].first()
    assert index.n == n and index.average == pytest.approx(average)
    sizes = index.postings.selectExpr("max(n)", "max(range)", "min(size(docs) = n)").first()
    assert sizes[0] <= 16 and sizes[2]


def test_bounds_hold_and_leave_ranges_closed(spark, held):
    frame, index = held
    repeats = {"rare": 1, "w0": 1, "w5": 1}
    places = {x["t"]: x["b"] for x in spark.createDataFrame([(t,) for t in repeats], "t string").select("t", p.bucket_of(F.col("t"), 8).alias("b")).collect()}
    asked = p.ask(index, [(0, repeats, places)], "int")
    bound = {x["range"]: x["bound"] for x in p.bounds(index, asked).collect()}
    scores = {}
    for x in p.scored(index, asked, p.bounds(index, asked).select("range"), 10**6, {}).collect():
        scores[x["doc"] // 16] = max(scores.get(x["doc"] // 16, 0), x["score"])
    assert set(scores) == set(bound) and all(s <= bound[k] + 1e-6 for k, s in scores.items()) and len(bound) > 20
    open_ = p.still_open(spark, asked, p.bounds(index, asked), {0: sorted(scores.values())[-2]}, {max(bound, key=bound.get): {0}})
    assert open_.count() < len(bound) / 4
    # the scan reads the folders of the query's terms, and the terms reach the file filters
    plan = p.blocks(index, places)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [" in plan


def test_terms_under_the_floor_bring_no_document_in():
    terms = [(1.0, np.array([1, 2, 3, 4]), np.array([0.2, 0.2, 0.2, 0.2])), (3.0, np.array([2, 9]), np.array([0.5, 0.9]))]
    docs, score = p.best_documents(terms, 1.0, 5)
    assert docs.tolist() == [9, 2] and score.tolist() == pytest.approx([2.7, 1.7])
    copies = [(1.0, np.arange(1000), np.full(1000, 0.5))]
    assert p.best_documents(copies, 0.0, 3)[0].tolist() == [0, 1, 2]
    assert sorted(p.best_documents(terms, 0.0, 5)[0].tolist()) == [1, 2, 3, 4, 9]
    assert p.best_documents(terms, 0.0, 1)[0].tolist() == [9]
    assert p.best_documents(terms, 9.0, 1)[0].tolist() == []


def test_empty_and_replaced_index(spark, tmp_path):
    frame, path = corpus(spark, 30), f"file://{tmp_path}/i"
    empty = p.write_index(frame.limit(0), path)
    assert empty.n == 0 and p.search_index(empty, "w0").count() == 0 and p.term_frequencies(empty).count() == 0
    index = p.write_index(frame, path)
    assert p.open_index(spark, path) == index and p.search_index(index, "w0", 2).count() == 2
    with pytest.raises(ValueError):
        p.search_index(index, "w0", 0)
    with pytest.raises(ValueError):
        p.write_index(frame, path, block=100)
