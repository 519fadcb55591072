"""Toxicity scores from a bidirectional gated recurrent network with attention pooling (operator 4).

The network is trained by one task on a bounded sample of the labelled rows: at most TRAIN_TOXIC toxic and TRAIN_CLEAN other
texts of at most TRAIN_BYTES bytes, those that come first by the MD5 of their id. The driver gets nothing but the network (2 MB). A label holds for a text, not for a window, so training
has two rounds: the windows of the first are chosen by how much likelier their n-grams are in toxic texts, those of the second
by the network itself; the number of steps is the same for any input. Every text is then scored whole, by all its overlapping
windows (WINDOW words, STRIDE apart); its score is that of its most toxic window.

Results for odd input: null and empty texts are scored as one window without words; a null doc_id is not held out; labels other
than 0 and 1 and rows without label aren't learned from; without labels of both kinds all scores are the share of label 1 (0
without labels); repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .gru import GRAM_BUCKETS, WORD_BUCKETS, Network, Scorer, hashed_inputs, windows_of, words_of

TRAIN_TOXIC = 900
TRAIN_CLEAN = 1800
TRAIN_BYTES = 1 << 16
#: Words and n-grams of fewer sampled texts say nothing: their embeddings are zero.
LEAST_TEXTS = 3
STEPS = 350
THRESHOLD = 0.3


def remainder(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(remainder(id_column) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The sample (label_, order_, text_), and the share of label 1 among the rows that may be learned from."""
    known = labels.filter("toxic IN (0, 1)").filter(remainder() != 2).select(F.col("doc_id").alias("id_"), F.col("toxic").cast("int").alias("label_"))
    counts = {r["label_"]: r["count"] for r in known.groupBy("label_").count().collect()}
    total = sum(counts.values())
    texts = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES)).select(F.col("doc_id").alias("id_"), F.col("text").alias("text_"))
    # the ids that come first, with some to spare for texts that are missing, null or long
    order = F.md5(F.col("id_").cast("string"))
    parts = [known.filter(F.col("label_") == y).orderBy(order, "id_").limit(2 * n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    chosen = parts[0].unionByName(parts[1])
    joined = texts.join(F.broadcast(chosen), "id_").select("label_", "text_", order.alias("order_"))
    rows = [joined.filter(F.col("label_") == y).orderBy("order_", "text_").limit(n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    return rows[0].unionByName(rows[1]), (counts.get(1, 0) / total if total else 0.0)


def likelier_grams(listed: list[bytes], texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A score for each listed word: its most telling n-gram, by how much likelier texts (of numbers of words) with label 1 hold it.

    Also the word buckets and the n-gram buckets that at least LEAST_TEXTS texts hold.
    """
    ids = [np.unique(t) for t in texts]
    # in parts, and in two bytes each: the driver holds the n-grams of all words of the sample at once
    hashed = (hashed_inputs(listed[i : i + 20_000]) for i in range(0, len(listed), 20_000))
    parts = [(words_, grams.astype(np.uint16), count) for words_, grams, count in hashed]
    bucket, n = (np.concatenate([p[k] for p in parts] or [np.zeros(0, dtype=np.int64)]) for k in (0, 2))
    gram = np.concatenate([p[1] for p in parts] or [np.zeros(0, dtype=np.uint16)])
    start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    seen, words = np.zeros((2, GRAM_BUCKETS)), np.zeros(WORD_BUCKETS)
    for own, y in zip(ids, labels, strict=True):
        if len(own):
            spans = np.concatenate([gram[a : a + k] for a, k in zip(start[own].tolist(), n[own].tolist(), strict=True)])
            seen[y, np.unique(spans)] += 1
            words[np.unique(bucket[own])] += 1
    ones, zeros = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    odds = np.log((seen[1] + 0.5) / (ones + 1)) - np.log((seen[0] + 0.5) / (zeros + 1))
    telling = np.maximum.reduceat((odds * np.sqrt(seen[1])).astype(np.float32)[gram], start) if listed else np.zeros(0)
    return telling, words >= LEAST_TEXTS, seen.sum(axis=0) >= LEAST_TEXTS


def train(rows: list[tuple[str, int]], share: float, steps: int = STEPS) -> Network | float:
    """A network, or the share of label 1 if there is nothing to tell apart."""
    labels = np.array([y for _, y in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return share
    # words are held as numbers, four bytes each
    vocabulary: dict[bytes, int] = {}
    texts = []
    for t, _ in rows:
        words = words_of(t)
        texts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), dtype=np.int32, count=len(words)))
    begin, size, text = windows_of([len(t) for t in texts])
    flat, listed = np.concatenate(texts), list(vocabulary)
    window = lambda i: [listed[w] for w in flat[begin[i] : begin[i] + size[i]]]
    weight = {1: share / (labels == 1).mean(), 0: (1 - share) / (labels == 0).mean()}
    telling, common_words, common_grams = likelier_grams(listed, texts, labels)
    word_scores = np.append(telling[flat], np.float32(-1e9))
    rank = np.array([word_scores[b : b + max(1, s)].max() for b, s in zip(begin.tolist(), size.tolist(), strict=True)])
    network, rng = Network.start(), np.random.default_rng(5)
    network.keep_only(common_words, common_grams)
    edges = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
    for _ in range(2):
        chosen = []
        for i, y in enumerate(labels.tolist()):
            lo, hi = int(edges[i]), int(edges[i + 1])
            best = lo + int(np.argmax(rank[lo:hi]))
            chosen.append((window(best), y, weight[y]))
            if y == 0:  # a text without label 1 has none in any window
                chosen.append((window(int(rng.integers(lo, hi))), 0, weight[0]))
        network.fit(chosen, steps)
        scorer = Scorer(network, cache=50_000)
        rank = np.concatenate([scorer.window_logits([t for t, _ in rows[i : i + 64]])[0] for i in range(0, len(rows), 64)]).astype(np.float64)
    tops = np.maximum.reduceat(rank, edges[:-1])
    network.scale = logistic(tops, labels, np.array([weight[y] for y in labels.tolist()]))
    return network


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic fit with smoothed targets, by Newton's method."""
    ones, zeros = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    centre, spread = float(x.mean()), float(x.std()) or 1.0
    u = np.stack([(x - centre) / spread, np.ones_like(x)], axis=1)
    v = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(u @ v, -30, 30)))
        g = u.T @ (weight * (p - target)) + 1e-3 * v
        h = (u * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ u + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        v = v - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    slope = max(float(v[0]), 1e-3)
    return slope / spread, float(v[1]) - slope * centre / spread


def score_column(text: str, model: Network | float, spark: SparkSession) -> Column:
    if isinstance(model, float):
        return F.lit(model)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series(np.concatenate([scorer.scores(batch.iloc[i : i + 32].tolist()) for i in range(0, len(batch), 32)] + [np.zeros(0)]))

    return run(text)


def fitted(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network trained on the sample of labelled rows, in a task of its own."""
    sample, share = training_rows(docs, labels)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["label_"], r["order_"], r["text_"]) for b in batches for r in b.to_pylist()), key=lambda r: (-r[0], *r[1:]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(t, y) for y, _, t in rows], share))], pa.binary())], names=["model"])

    made = sample.select("label_", "order_", "text_").repartition(1).mapInArrow(fit, "model binary").first()
    return share if made is None else pickle.loads(made["model"])


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the network, trained on labels, gives a score under threshold."""
    kept = docs.select(F.struct("*").alias("row_"), "text").withColumn("score_", score_column("text", fitted(docs, labels), docs.sparkSession))
    return kept.filter(F.col("score_") < threshold).select(*[F.col(f"row_.{c}") for c in docs.columns])


def op4_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column("text", fitted(docs, table(spark, sf_dir, "labels")), spark).alias("score"))
    return scored.select("*", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
