"""What Python workers hold at once is bounded, whatever the length of texts and the number of words."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm import gru, simhash
from lexmill.session import BATCH_BYTES, bound_batches, ship

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], names=["bytes", "n"])

    spark.conf.unset(KEY)
    ship(spark)
    texts = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    out = texts.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r["n"] for r in out) == 1500
    assert max(r["bytes"] for r in out) < BATCH_BYTES + 20_000


def test_a_bound_of_the_session_stays(spark):
    try:
        spark.conf.set(KEY, "1m")
        bound_batches(spark)
        assert spark.conf.get(KEY) == "1m"
        spark.conf.unset(KEY)
        bound_batches(spark)
        assert spark.conf.get(KEY) == str(BATCH_BYTES)
    finally:
        spark.conf.unset(KEY)
        bound_batches(spark)


def test_many_new_words_and_windows_take_little_memory():
    net = gru.Network.start()
    text = " ".join(f"word{i}of{i % 97}many" for i in range(40_000))
    scorer = gru.Scorer(net)
    assert peak_mb(lambda: scorer.scores([text])) < 50
    words = list(scorer.ids)
    table = np.concatenate([net.projected(words[i : i + 500]) for i in range(0, len(words), 500)])
    begin, size, _ = gru.windows_of([len(words)])
    ids = np.minimum(begin[:, None] + np.arange(gru.WINDOW), len(words) - 1)
    assert np.allclose(scorer.window_logits([text])[0], net.run(table, ids, size), atol=1e-5)


def test_shared_counts_in_pieces():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**63, (500, 4096), dtype=np.uint64)
    x, y = np.arange(499), np.arange(1, 500)
    found = []
    assert peak_mb(lambda: found.append(simhash.shared_counts(bits, x, y))) < 16
    assert found[0].tolist() == [int(np.bitwise_count(bits[i] & bits[i + 1]).sum(dtype=np.int64)) for i in range(499)]
    assert simhash.shared_counts(bits, x[:0], y[:0]).tolist() == []
