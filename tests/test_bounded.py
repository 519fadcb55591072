"""What a task holds at once stays bounded, and nothing is worked out twice."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions.udfs import normalize, normalized, slices
from lexmill.operators import encode, postings, retrieval, verify


def test_slices_are_bounded_and_whole():
    texts = ["a" * 10, None, "", "b" * 25, "長" * 5, "c", None]
    parts = [p.to_pylist() for p in slices(pa.array(texts), 3, 20)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 20) for p in parts)
    assert list(slices(pa.array([], pa.string()), 3, 20)) == [] and [len(p) for p in slices(pa.array(["ab"] * 7).slice(2), 2, 99)] == [2, 2, 1]


def test_corpus_is_encoded_once_in_slices(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(["one two three", None, " ", "two two " * 50, *["three one"] * 9])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = encode.train_tokenizer(docs, 300)
    whole = {r["doc_id"]: r["tokens"] for r in encode.encode_corpus(docs, model).collect()}
    monkeypatch.setattr(encode, "SLICE_BYTES", 12)
    made = encode.encode_corpus(docs, model)
    assert {r["doc_id"]: r["tokens"] for r in made.collect()} == whole and set(whole) == {0, 3, *range(4, 13)}
    # the encoder ran in the filter and in the projection before, each with its own worker
    plan = made.selectExpr("doc_id", "size(tokens) AS n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_normalize_takes_slices(spark, monkeypatch):
    monkeypatch.setattr("lexmill.functions.udfs.SLICE", 2)
    texts = ["ﬁne  text", None, "plain", "", "é​ x", "長 文", "２", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", normalize("t").alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == [None if t is None else normalized(t) for t in texts]


@pytest.mark.parametrize("words", [1 << 19, 2])
def test_blocks_are_made_range_by_range(monkeypatch, words):
    monkeypatch.setattr(postings, "SLICE_WORDS", words)
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["doc", "words"])

    first = [(0, ["a", "b", "a"]), (1, None), (2, [])]
    rest = [(3, ["b"]), (4, ["b", "c"]), (9, ["a"]), (8, ["c"])]
    asked = []

    def batches():
        for rows in (first, [], rest):
            asked.append(len(rows))
            yield batch(rows)

    made = [b.to_pylist() for b in postings.term_blocks(batches(), 4)]
    found = [sorted((x["term"] or "", x["range"], tuple(x["docs"]), tuple(x["tfs"]), tuple(x["lengths"])) for x in b) for b in made]
    assert found == [
        [("", 0, (), (), (3, 0, 1)), ("a", 0, (0,), (2,), (3,)), ("b", 0, (0, 3), (1, 1), (3, 1))],
        [("", 1, (), (), (2,)), ("b", 1, (0,), (1,), (2,)), ("c", 1, (0,), (1,), (2,))],
        [("", 2, (), (), (1,)), ("a", 2, (1,), (1,), (1,))],
        [("", 2, (), (), (1,)), ("c", 2, (0,), (1,), (1,))],
    ]


def test_index_moves_no_text_by_range(spark, tmp_path, monkeypatch):
    """Texts were shuffled by range and counted by hash tables over all ranges of a task, whose number Spark chose by bytes."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(i % 9))) for i in range(70)] + [(70, None)], "doc_id long, text string")
    seen, kind = [], type(docs)
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (seen.append(self._jdf.queryExecution().executedPlan().toString()), run(self, *a, **b))[1])
    index = postings.write_index(docs, f"file://{tmp_path}/i", ["doc_id"], block=8, buckets=2)
    assert len(seen) == 1 and "Exchange" not in seen[0] and "Aggregate" not in seen[0]
    expected = {tuple(x) for x in retrieval.term_statistics(docs)[0].collect()}
    assert {tuple(x) for x in postings.term_frequencies(index).collect()} == expected
    # blocks of a range in two parts are searched as one
    twice = index.postings.filter("n > 1").select("term", "range", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("x"), "best", "bucket")
    index.__dict__["postings"] = twice.select("term", "range", F.lit(1).alias("n"), "best", *[F.array(f"x.{c}").alias(c) for c in ("docs", "tfs", "lengths")], "bucket").unionByName(index.postings.filter("n = 1"))
    got = [(x["rank"], x["doc_id"], x["score"]) for x in postings.search_index(index, "w0 w1 w5", 6).orderBy("rank").collect()]
    assert got == [(x["rank"], x["doc_id"], x["score"]) for x in retrieval.bm25(docs, "w0 w1 w5", 6, ["doc_id"]).orderBy("rank").collect()]


def test_batch_moves_the_best_rows_only(spark, monkeypatch):
    """Each pair of a query and a chunk that share a word was a row of a shuffle."""
    rows = [(i, " ".join(f"w{j % (i % 5 + 2)}" for j in range(i % 9))) for i in range(70)] + [(70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(0, "w0 w1 w1"), (1, "w5 w2 zzz"), (2, "zzz"), (3, None), (4, "w3")]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    expected = sorted((q, x["rank"], x["doc_id"], x["score"]) for q, t in asked if t for x in retrieval.bm25(docs, t, 6, ["doc_id"]).collect())
    for terms, part, scored in [(200_000, 8192, 1024), (2, 1, 4), (200_000, 2, 1)]:
        for name, value in {"BLOCK_TERMS": terms, "PART_TERMS": part, "SCORED_ROWS": scored, "SLICE_WORDS": scored}.items():
            monkeypatch.setattr(retrieval, name, value)
        assert sorted((x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in retrieval.bm25_batch(docs, queries, 6, ["doc_id"]).collect()) == expected
    assert retrieval.bm25_batch(docs, queries.limit(0), 6, ["doc_id"]).collect() == []
    best = retrieval.best_scores(docs.coalesce(1), [(0, [{"term": "w0", "times": 1}])], pa.int32(), "int", 2, ["doc_id"])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "WindowGroupLimit" in plan
    assert best.count() == 2


def test_hits_meet_sentences_where_they_are_read(spark, monkeypatch):
    """Every word of every hit was a row of a shuffle, and whole word sets were written and moved to be compared."""
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choices([f"w{i}" for i in range(12)] + ["x"], k=n))
    answers = spark.createDataFrame([(i, ". ".join(say(rnd.randint(0, 5)) for _ in range(3))) for i in range(30)] + [(90, None)], "answer_id int, answer string")
    hits = spark.createDataFrame([(i, say(rnd.randint(0, 9))) for i in range(60)] + [(98, None), (99, "")], "rank int, text string")
    expected = sorted(map(tuple, verify.verified_sentences(answers, hits, 0.6).collect()))
    for terms, pairs in [(200_000, 200_000), (7, 3)]:
        monkeypatch.setattr(verify, "BLOCK_TERMS", terms)
        monkeypatch.setattr(verify, "PAIRS", pairs)
        assert sorted(map(tuple, verify.supported_sentences(answers, hits, 0.6).collect())) == expected
    assert verify.supported_sentences(answers.limit(0), hits, 0.6).collect() == []
    plan = verify.covering(hits, [(0, ["w0", "w1"])], 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
