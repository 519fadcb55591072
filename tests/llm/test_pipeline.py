"""The pipeline: columns, decisions, and each stage against a plainer reading of its rule."""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import registry, simhash
from lexmill.llm.gru import words_of
from test_ops import brute_mix, brute_tiles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_and_decisions(stages):
    docs = stages[0]
    for s in stages[1:5]:
        assert s.columns == docs.columns
    rows = [set(map(tuple, s.collect())) for s in stages[:5]]
    assert all(later <= earlier for earlier, later in zip(rows, rows[1:], strict=False))


def test_no_equal_texts_and_no_leaks_stay(stages, spark):
    kept = [r["text"] for r in stages[3].collect()]
    assert max(Counter(kept).values()) == 1
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not [t for t in kept if any(i in t for i in items)]
    before = [r["text"] for r in stages[2].collect()]
    clean = [t for t in before if not any(" ".join(i.split()[:5]).lower() in t.lower() for i in items)]
    assert set(clean) <= set(kept)


def test_near_dedup_equals_brute_force(stages):
    rows = [(r["doc_id"], set(simhash.shingle_hashes(r["text"], 5).tolist())) for r in stages[1].collect()]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        classes[find(i)].append(d)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(map(min, classes.values()))


def test_decontamination_equals_brute_force(stages, spark):
    items = [[w.decode() for w in words_of(r["text"])] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    seeds = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    kept = []
    for r in stages[2].collect():
        text = [w.decode() for w in words_of(r["text"])]
        near = [i for i in items if i and seeds(text, min(5, len(i))) & seeds(i, min(5, len(i)))]
        if not any(2 * sum(n for *_, n in brute_tiles(text, i, min(5, len(i)))) >= len(i) for i in near):
            kept.append(r["doc_id"])
    assert sorted(kept) == sorted(r["doc_id"] for r in stages[3].collect())


def test_mixing_equals_brute_force(stages):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages[3].collect()]
    expected = sum(n // size for (_, _, size, _, _, n), _ in brute_mix(rows).items() if size)
    assert stages[4].count() == expected
    made = Counter(r["doc_id"] for r in stages[4].collect())
    assert max(made.values()) <= 3


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns: no stage fails, drops columns or makes rows up."""
    texts = [(i, f"text {i} " + "some words that are here " * (i % 5), f"s{i % 3}") for i in range(40)]
    rows = [*texts, (100, None, "s1"), (101, "", None), (None, "null id", "s1"), (None, None, None), (102, "long " * 60_000, "s2"), (103, "twice", "s0"), (103, "twice", "s0"), (104, " \n\t ", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs = docs.select("*", *[F.lit(f"x{c}").alias(c) for c in ("lang", "size", "weight", "row_", "shard", "slot", "score", "place", "group", "vertex", "point", "key", "found_")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "sharding":
            assert out.count() == len(rows) and "weight" in out.columns
            continue
        assert out.columns == docs.columns, name
        held = Counter((r["doc_id"], r["text"]) for r in out.collect())
        allowed = Counter((d, t) for d, t, _ in rows)
        assert all(n <= allowed[k] * (3 if name == "mixing" else 1) for k, n in held.items()), name
        if name == "decontamination":  # what the network makes of texts without words, learned from 87 labels, is not fixed
            assert held[102, "long " * 60_000] == 1 and held[100, None] == 1


def test_shards(stages):
    counts = [r["count"] for r in stages[5].groupBy("shard").count().collect()]
    assert sum(counts) == stages[4].count() and max(counts) - min(counts) <= 1
    assert stages[5].groupBy("shard", "slot").count().filter("count > 1").count() == 0


def test_stages_take_no_rows(spark, stages):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), DATA).count() == 0, name


def rows(frame):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) else v

    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_every_operator_is_registered(spark):
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in registry.QUERIES)] == []
    held = registry.QUERIES["op4_gated_recurrent"](spark, DATA).agg(F.min("score"), F.max("score")).first()
    assert 0 <= held[0] <= held[1] <= 1
