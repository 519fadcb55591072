"""Tables of queries and answers, and chains of dictionaries, against the operators for one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.convert import Automaton, phrase_converter, phrases_converted
from lexmill.operators import postings, retrieval, verify

WORDS = [f"w{i}" for i in range(30)]


def corpus(spark, n=60, seed=1):
    r, rng = random.Random(seed), np.random.default_rng(seed)
    rows = [(i // 2, i % 2, f"s{i % 7}", " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(30)], k=r.randint(0, 12))), rng.standard_normal(6).tolist()) for i in range(n)]
    rows.append((n, 0, "s1", None, None))
    return spark.createDataFrame(rows, "doc_id long, chunk_idx int, source string, text string, embedding array<double>").repartition(3)


@pytest.mark.parametrize(("mode", "scorer", "least"), [("bm25", None, 1.0), ("vector", None, 1.0), ("hybrid", None, 2.0), ("hybrid", "own", 0.0)])
def test_search_many_equals_search(spark, tmp_path, mode, scorer, least):
    chunks = corpus(spark)
    rng = np.random.default_rng(5)
    scorer = scorer and (lambda pairs: [float(len(set(q.split()) & set((t or "").split()))) for q, t in pairs])
    asked = [(i, text, rng.standard_normal(6).tolist()) for i, text in enumerate(["w0 w1", "w25 w3 w3", "none"])]
    queries = spark.createDataFrame(asked, "query_id int, text string, embedding array<double>")
    vectors = chunks.filter("embedding IS NOT NULL")
    index = postings.write_index(chunks, f"file://{tmp_path}/i") if scorer else None
    options = {"mode": mode, "top_k": 3, "candidates": 8, "scorer": scorer, "least": least}
    expected = []
    for q, text, vector in asked:
        try:
            expected += [(q, x["rank"], x["source"], x["text"], round(x["score"], 6), x["scorer"]) for x in retrieval.search(chunks, text, vectors=vectors, query_vector=vector, **options).collect()]
        except ValueError:
            assert least > 0
    for lexical in (None, *([lambda table, k: postings.search_batch(index, table, k)] if scorer else [])):
        found = retrieval.search_many(chunks, queries, vectors=vectors, lexical=lexical, **options)
        assert sorted((x["query_id"], x["rank"], x["source"], x["text"], round(x["score"], 6), x["scorer"]) for x in found.collect()) == sorted(expected)


def test_search_many_refuses(spark):
    chunks, queries = corpus(spark), spark.createDataFrame([(1, "w0")], "query_id int, text string")
    for bad in ({"mode": "x"}, {"mode": "hybrid"}, {"mode": "vector", "vectors": chunks}, {"top_k": 0}):
        with pytest.raises(ValueError):
            retrieval.search_many(chunks, queries, **bad)
    assert retrieval.search_many(chunks, queries.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_supported_sentences_equal_verified_ones(spark, least):
    r = random.Random(int(least * 10))
    say = lambda n: " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(30)], k=n))
    answers = [(i, ". ".join(say(r.randint(0, 6)) for _ in range(3))) for i in range(40)] + [(90, None), (91, ""), (92, "w0. w0. unknown words here")]
    hits = [(i, say(r.randint(0, 9))) for i in range(50)] + [(98, None), (99, "")]
    a, h = spark.createDataFrame(answers, "answer_id int, answer string"), spark.createDataFrame(hits, "rank int, text string")
    got = sorted(map(tuple, verify.supported_sentences(a, h, least).collect()))
    assert got == sorted(map(tuple, verify.verified_sentences(a, h, least).collect())) and got


def test_supported_sentences_by_query(spark):
    answers = spark.createDataFrame([(1, 0, "red apples grow"), (2, 0, "red apples grow")], "query_id int, answer_id int, answer string")
    hits = spark.createDataFrame([(1, 1, "red apples"), (2, 1, "green pears"), (2, 2, "apples grow here")], "query_id int, rank int, text string")
    got = [(x["query_id"], x["citations"]) for x in verify.supported_sentences(answers, hits, 0.5, ["query_id"]).orderBy("query_id").collect()]
    assert got == [(1, [1]), (2, [2])]
    with pytest.raises(ValueError):
        verify.supported_sentences(answers, hits, 0)


def test_frequent_words_are_not_joined_on(spark):
    """A word in all hits is left out of the prefix, so a sentence meets the hits that hold its rare words."""
    hits = spark.createDataFrame([(i, f"common often r{i}") for i in range(200)], "rank int, text string")
    answers = spark.createDataFrame([(0, "common often r7 r8"), (1, "common often absent words")], "answer_id int, answer string")
    got = {x["answer_id"]: x["citations"] for x in verify.supported_sentences(answers, hits, 0.75).collect()}
    assert got == {0: [7, 8]}


def test_automaton_equals_the_loop():
    r = random.Random(3)
    for _ in range(300):
        table = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))): r.choice(["", "X", "ab", "長"]) for _ in range(r.randint(0, 12))}
        automaton, loop = Automaton(table), phrase_converter(table)
        for _ in range(10):
            text = "".join(r.choice("abcd") for _ in range(r.randint(0, 30)))
            assert automaton.convert(text, table) == loop(text)
    with pytest.raises(ValueError):
        Automaton([""])


def test_chained_dictionaries(spark):
    first, second = {"软件": "軟件", "软": "軟", "里": "裡", "a" * 3000: "long"}, {"軟件": "軟體"}
    texts = [("软件里的软", "軟體裡的軟"), ("a" * 3001, "longa"), ("", ""), (None, None), ("軟件", "軟體")]
    frame = spark.createDataFrame(texts, "text string, expected string")
    assert frame.withColumn("got", phrases_converted("text", first, second)).filter("NOT (got <=> expected)").count() == 0
    assert [x["t"] for x in frame.select(phrases_converted("text").alias("t")).collect()] == [x for x, _ in texts]
    with pytest.raises(ValueError):
        phrases_converted("text", {"": "x"})
    # many phrases of many lengths: the text is read once, whatever their lengths
    table = {"a" * n: "b" for n in range(1, 400)}
    assert Automaton(table).convert("c" + "a" * 1000, table) == phrase_converter(table)("c" + "a" * 1000)
