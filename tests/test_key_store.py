"""Runs of a key store keep together what one run over all rows keeps."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import key_store as ks


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "bucket": F.lit(1), "run": F.lit("y")}).repartition(3)


def test_runs_equal_one_run(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    parts = [[(100 * n + i, r.choice([f"t{r.randrange(60)}", "hot", None, ""])) for i in range(80)] for n in range(3)]
    store = ks.KeyStore(spark, f"file://{tmp_path}/s", buckets=4)
    kept = []
    for n, rows in enumerate(parts):
        if n == 2:
            monkeypatch.setattr(ks, "BROADCAST", 0)
        out = store.keep_new(frame(spark, rows), ks.digest("text"), ["doc_id"], f"r{n}")
        assert out.columns == ["doc_id", "text", "key", "bucket", "run"]
        kept += [(x["doc_id"], x["text"]) for x in out.collect()]
    firsts = {}
    for i, t in (x for p in parts for x in p):
        firsts.setdefault(t, i)
    assert sorted(kept) == sorted((i, t) for t, i in firsts.items())
    assert store.runs() == ["r0", "r1", "r2"]
    # a run that is run again gives the same rows and counts once; a new one with the same rows gives none
    again = store.keep_new(frame(spark, parts[1]), ks.digest("text"), ["doc_id"], "r1")
    assert {x["doc_id"] for x in again.collect()} == {i for i, _ in kept if 100 <= i < 200}
    assert store.keep_new(frame(spark, parts[0] + parts[1]), ks.digest("text"), ["doc_id"], "r3").count() == 0
    assert store.keep_new(frame(spark, []), ks.digest("text"), ["doc_id"], "r4").count() == 0
    assert store.keep_new(frame(spark, [(1, "new"), (2, "hot")]), ks.digest("text"), ["doc_id"], "r5").count() == 1
    for bad in ("", "a/b", "x.partial"):
        with pytest.raises(ValueError):
            store.keep_new(frame(spark, []), ks.digest("text"), ["doc_id"], bad)


def test_filters_miss_nothing_and_doubt_little():
    rng = np.random.default_rng(0)
    held, others = (np.frombuffer(rng.bytes(32 * 5000), dtype=np.uint8).reshape(-1, 32) for _ in range(2))
    f = ks.filter_of(held)
    assert ks.known(held, f).all() and ks.known(others, f).mean() < 0.01
    assert len(ks.filter_of(held[:1])) >= 1 and ks.known(held[:1], ks.filter_of(held[:1])).all()


def test_new_digests_need_no_look_at_stored_ones(spark, tmp_path):
    store = ks.KeyStore(spark, f"file://{tmp_path}/s", buckets=8)
    store.keep_new(frame(spark, [(i, f"old {i}") for i in range(3000)]), ks.digest("text"), ["doc_id"], "a")
    keys = frame(spark, [(i, f"new {i}") for i in range(3000)]).select(ks.digest("text").alias("key"))
    assert store.doubtful(keys, ["a"]).count() < 60
    both = keys.unionByName(frame(spark, [(i, f"old {i}") for i in range(0, 3000, 7)]).select(ks.digest("text").alias("key")))
    assert store.seen(both, ["a"]).count() == len(range(0, 3000, 7))


def test_digests_tell_keys_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), (None, "a"), ("", "a"), (None, None), ("-", None)], "x string, y string")
    assert rows.select(ks.digest("x", "y").alias("d")).distinct().count() == 7
    assert len(rows.select(ks.digest("x").alias("d")).first()["d"]) == 32
