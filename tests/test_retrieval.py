from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import retrieval as r
from lexmill.operators import verify as v
from lexmill.functions.text import UNSUPPORTED

CHUNKS = [("lsm.md", "Linear State Mixer 是一種線性注意力機制，使用 chunkwise kernel 處理長序列。"), ("other.md", "SentencePiece 用於將中文文字編碼成 subword token。")]
QUERY = "Linear State Mixer 的 chunkwise kernel 是什麼？"


def chunks(spark, rows=CHUNKS):
    return spark.createDataFrame([(i, 0, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, chunk_idx int, source string, text string")


def hits(spark, rows):
    return spark.createDataFrame([(i, s, t, 1.0) for i, (s, t) in enumerate(rows, 1)], "rank int, source string, text string, score double")


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "answer_id int, answer string")


def test_the_relevant_chunk_comes_first(spark):
    found = r.bm25(chunks(spark), QUERY).collect()
    assert found[0]["source"] == "lsm.md" and found[0]["rank"] == 1
    ranked = r.bm25(chunks(spark), QUERY)
    assert "來源：lsm.md" in v.render_context(ranked)
    assert "[1]" in v.cited_sections(ranked, QUERY).first()["answer"]


def test_bm25_matches_the_formula(spark):
    texts = ["a1 b2 b2 c3", "b2 d4", "a1 a1 e5 e5 e5", "", "f6"]
    query = "b2 a1 b2"
    docs = [Counter(t.split()) for t in texts]
    average = sum(map(sum, (d.values() for d in docs))) / len(docs)

    def score(d):
        s = 0.0
        for q in query.split():
            df, f = sum(q in x for x in docs), d[q]
            s += math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(d.values()) / average)) if f else 0
        return round(s, 6)

    expected = sorted(((score(d), -i) for i, d in enumerate(docs) if score(d) > 0), reverse=True)
    frame = chunks(spark, [("s", t) for t in texts])
    assert [(x["score"], -x["doc_id"]) for x in r.bm25(frame, query, None).orderBy("rank").collect()] == expected
    batch = r.bm25_batch(frame, spark.createDataFrame([(7, query)], "query_id int, text string"), 10)
    assert [(x["score"], -x["doc_id"]) for x in batch.orderBy("rank").collect()] == expected


def test_bm25_edges(spark):
    assert r.bm25(chunks(spark).limit(0), "a1").count() == 0
    assert r.bm25(chunks(spark), "nothing_here").count() == 0
    assert r.bm25(chunks(spark), "!!").count() == 0
    ties = r.bm25(chunks(spark, [("x", "a1 b2"), ("y", "a1 b2")]), "a1", 2).orderBy("rank").collect()
    assert [x["source"] for x in ties] == ["x", "y"]
    with pytest.raises(ValueError):
        r.bm25(chunks(spark), "a1", 0)


def test_dense_and_fusion(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((50, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    best = np.argsort(-(points @ points[3]))[:5].tolist()
    assert [x["vec_id"] for x in r.dense(frame, points[3], 5).orderBy("rank").collect()] == best
    batch = r.dense_batch(frame, points[:4], 5).filter("query_id = 3").orderBy("rank").collect()
    assert [x["vec_id"] for x in batch] == best
    shared = ("lsm.md", "LSM uses recurrent state.")
    fused = r.fuse([hits(spark, [shared, ("other.md", "Other text.")]), hits(spark, [shared])]).orderBy("rank").collect()
    assert fused[0]["source"] == "lsm.md" and fused[0]["score"] == pytest.approx(2 / 61)


def test_mean_pool(spark):
    frame = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert frame.select(r.mean_pool(F.col("v"), F.col("m")).alias("x")).first()["x"] == pytest.approx([0.6, 0.8])


def test_search_modes(spark):
    with pytest.raises(ValueError, match="evidence"):
        r.search(chunks(spark), QUERY, least=1e9)
    found = r.search(chunks(spark), QUERY, top_k=1, least=0)
    assert [x["source"] for x in found.collect()] == ["lsm.md"]
    vectors = chunks(spark).withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double")))
    assert r.search(chunks(spark), QUERY, "hybrid", 2, vectors=vectors, query_vector=[0.0, 1.0], least=0).count() == 2
    reranked = r.search(chunks(spark), QUERY, top_k=2, least=0, scorer=lambda pairs: [-len(t) for _, t in pairs])
    assert reranked.first()["scorer"] == "rerank"


def test_conflicts(spark):
    rows = [("a.md", "LSM 的 context 長度為 128 tokens。"), ("b.md", "LSM 的 context 長度為 256 tokens。"), ("b.md", "LSM 的 context 長度為 512 tokens。")]
    found = {(x["left_source"], x["right_source"], x["right_claim"]) for x in v.source_conflicts(hits(spark, rows)).collect()}
    assert found == {("a.md", "b.md", rows[1][1]), ("a.md", "b.md", rows[2][1])}
    assert v.apply_policy(v.source_conflicts(hits(spark, rows)), "warn")
    with pytest.raises(ValueError, match="disagree"):
        v.apply_policy(v.source_conflicts(hits(spark, rows)), "refuse")


def test_verified_answers(spark):
    h = hits(spark, [("lsm.md", "LSM 使用 recurrent state 處理長序列。")])
    found = v.verified_answers(answers(spark, "LSM 使用 recurrent state 處理長序列。LSM 的作者住在台北。", ""), h).orderBy("answer_id").collect()
    assert found[0]["verified"] == "LSM 使用 recurrent state 處理長序列。 [1]"
    assert found[1]["verified"] == UNSUPPORTED
    with pytest.raises(ValueError):
        v.verified_sentences(answers(spark, "a"), h, 0)


@pytest.mark.parametrize(("query", "has", "branch"), [("LSM 為何適合長序列？", "recurrent state", "evidence"), ("LSM 的作者是誰？", "資料不足", "refused")])
def test_reliable_answers(spark, query, has, branch):
    h = hits(spark, [("lsm.md", "LSM 使用 recurrent state，因此適合長序列。")])
    found = v.reliable_answers(answers(spark, "參考資料未提供這項資訊，因此不知道。"), h, query, 200).first()
    assert has in found["text"] and found["branch"] == branch


def test_context_picks_a_sentence(spark):
    h = hits(spark, [("lsm.md", "LSM 會處理輸入 token。LSM 維護 recurrent state，因此適合長序列。")])
    assert "recurrent state" in v.render_context(h, "LSM 為何適合長序列？", 60)
    assert v.render_context(h, None, 5) == ""


def test_web_context(spark):
    shown = v.render_web_context([("T", "u", "s" * 400), ("T2", "u2", "x")], 60)
    assert shown.startswith("[網路 1] T\nURL: u\n摘要：sss") and "網路 2" not in shown


def test_context_equals_a_plain_reading(spark):
    rows = [("a.md", "First one here. Second has alpha beta. Third follows it! "), ("b", "no marks at all " * 6), ("c", "Alpha. Beta alpha. \u3000"), ("d", "x")]
    split = lambda t: [x.strip() for x in re.split(r"(?<=[。！？.!?])\s*", t) if x.strip()]
    words = lambda t: set(re.findall(r"[a-z0-9][a-z0-9_.+-]*", t.lower()))

    def plain(query, most):
        out, left = [], most
        for i, (source, text) in enumerate(rows, 1):
            head = f"[{i}] 來源：{source}\n"
            room = left - len(head)
            if room <= 0:
                break
            s = split(text)
            if query and len(text) > room and s:
                k = max(range(len(s)), key=lambda j: (len(words(query) & words(s[j])), -j))
                chosen = [s[k]]
                if k and len(" ".join([s[k - 1], *chosen])) <= room:
                    chosen = [s[k - 1], *chosen]
                if k + 1 < len(s) and len(" ".join([*chosen, s[k + 1]])) <= room:
                    chosen.append(s[k + 1])
                text = " ".join(chosen)
            body = text[:room].rstrip()
            out.append(head + body)
            left = room - len(body)
        return "\n\n".join(out)

    for query in (None, "alpha beta", "third", "nothing that is there", "!!"):
        for most in (1, 12, 20, 35, 60, 90, 150, 400):
            assert v.render_context(hits(spark, rows), query, most) == plain(query, most), (query, most)


def test_answer_modes(spark):
    h = hits(spark, [("lsm.md", "LSM 使用 recurrent state 處理長序列。")])
    made, query = answers(spark, "LSM 使用 recurrent state 處理長序列。LSM 的作者住在台北。"), "LSM recurrent state"
    text = lambda mode, **more: v.answer(mode, h, query, **more)[0].first()["text"]
    assert text("generate", generated=made).endswith("台北。")
    assert text("verified", generated=made) == text("reliable", generated=made) == "LSM 使用 recurrent state 處理長序列。 [1]"
    assert text("cited") == "[1] 來源：lsm.md\nLSM 使用 recurrent state 處理長序列。 [1]"
    web = spark.createDataFrame([(1, "T", "u", "s")], "rank int, title string, url string, snippet string")
    assert text("extractive", web=web) == "[1] 來源：lsm.md\nLSM 使用 recurrent state 處理長序列。\n\n[網路 1] T\nURL: u\n摘要：s"
    with pytest.raises(ValueError):
        v.answer("verified", h, query)
    disagree = hits(spark, [("a.md", "LSM 的 context 長度為 128 tokens。"), ("b.md", "LSM 的 context 長度為 256 tokens。")])
    assert len(v.answer("cited", disagree, query)[1]) == 1
    with pytest.raises(ValueError, match="disagree"):
        v.answer("cited", disagree, query, policy="refuse")


def test_rerank_keeps_the_order_of_ties(spark):
    h = hits(spark, [("z", "z"), ("a", "a"), ("m", "m")])
    assert [x["source"] for x in r.rerank(h, "q", lambda pairs: [1.0 if t == "m" else 0.5 for _, t in pairs]).orderBy("rank").collect()] == ["m", "z", "a"]


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(4)}", " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(1, 6))) + f" {rng.randrange(3)}.") for _ in range(30)]
    from lexmill.functions.text import content_terms

    held = [(s, t, set(x)) for (s, t), x in zip(rows, (y["x"] for y in hits(spark, rows).orderBy("rank").select(content_terms("text").alias("x")).collect()), strict=True)]
    number = lambda t: re.findall(r"\d+", t)
    expected = Counter((a[0], b[0], a[1], b[1]) for i, a in enumerate(held) for b in held[i + 1 :] if a[0] != b[0] and number(a[1]) != number(b[1]) and len(a[2] & b[2]) >= 3)
    assert Counter(tuple(x) for x in v.source_conflicts(hits(spark, rows)).collect()) == expected and expected


def test_dense_all_answers_every_query_in_blocks(spark):
    points = np.random.default_rng(5).normal(size=(90, 6))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    queries = frame.filter("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding")  # 30 queries in blocks of 7
    found = {(x["query_id"], x["rank"]): x["vec_id"] for x in r.dense_all(frame, queries, 4, block=7).collect()}
    scores = np.round(points @ points.T, 6)
    assert found == {(q, k + 1): v for q in range(0, 90, 3) for k, v in enumerate(sorted(range(90), key=lambda v, q=q: (-scores[q, v], v))[:4])}
    assert r.dense_all(frame, queries.limit(0), 4).count() == 0


def test_equal_rounded_scores_are_ranked_by_id(spark):
    frame = spark.createDataFrame([(1, [0.50000001]), (2, [0.50000002]), (3, [0.1])], "vec_id long, embedding array<double>").coalesce(1)
    assert [x["vec_id"] for x in r.dense_batch(frame, np.array([[1.0]]), 1).collect()] == [1]
