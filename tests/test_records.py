from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import REFUSAL
from lexmill.functions.udfs import message_fingerprint
from lexmill.operators import chat, clean, encode, grounded, quota, sampling, schedule
from lexmill.operators.retrieval import build_chunks
from lexmill.plans.queries import word_lengths
from lexmill.plans.workflows import Workflow, content_digest, counters, run_chat, run_corpus, run_grounded
from lexmill.operators.clean import CleanOptions
from lexmill.sources import manifests, readers, sinks, web

MESSAGES = "array<struct<role: string, content: string>>"


def conversation(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def qa(spark, prompt, response, article="42"):
    rows = [(article, "q", conversation(("user", prompt), ("assistant", response)))]
    return spark.createDataFrame(rows, f"article_id string, qid string, messages {MESSAGES}")


def test_normalize_conversations(spark):
    rows = [
        (1, conversation(("user", " hi "), ("assistant", "yo"))),
        (2, conversation(("user", "hi"))),
        (3, conversation(("user", "hi"), ("robot", "x"), ("assistant", None))),
        (4, conversation(("assistant", "a"), ("user", "b"))),
        (5, None),
    ]
    found = chat.normalize_conversations(spark.createDataFrame(rows, f"id int, messages {MESSAGES}")).collect()
    assert [(r["id"], r["messages"][0]["content"]) for r in found] == [(1, "hi")]


def test_normalize_alpaca(spark):
    rows = [("do", " x ", "out"), ("do", None, "out"), ("do", "", None), ("do", "", " ")]
    found = chat.normalize_alpaca(spark.createDataFrame(rows, "instruction string, input string, output string")).collect()
    assert [[m["content"] for m in r["messages"]] for r in found] == [["do\n\nx", "out"], ["do", "out"]]


def test_masking_and_shift(spark):
    rows = spark.createDataFrame([(conversation(("user", "aa bbb"), ("assistant", "c dddd")),), (conversation(("user", "a"),),)], f"messages {MESSAGES}")
    found = chat.pad(chat.encode_conversations(rows, word_lengths, 9, eos=3), 9).collect()
    assert len(found) == 1
    assert found[0]["input_ids"] == [8, 2, 3, 13, 1, 4, 3, 0, 0]
    assert found[0]["labels"] == [-100, -100, -100, -100, 1, 4, 3, -100, -100]
    assert chat.encode_conversations(rows, word_lengths, 6).count() == 0
    x, y = chat.next_token("i", "l")
    shifted = spark.createDataFrame([([11, 12, 13, 14], [-100, -100, 13, 14])], "i array<int>, l array<int>").select(x.alias("x"), y.alias("y")).first()
    assert shifted["x"] == [11, 12, 13] and shifted["y"] == [-100, 13, 14]


def test_largest_remainder():
    assert quota.largest_remainder([0.5, 0.3, 0.2], 10) == [5, 3, 2]
    assert quota.largest_remainder([1, 1, 1], 10) == [4, 3, 3]
    assert quota.largest_remainder([None], 7) == [7]
    with pytest.raises(ValueError):
        quota.largest_remainder([1, 0], 5)


def test_quota_and_conversation_limits(spark):
    rows = [(i, f"s{i % 3}", f"k{i % 5}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, key string")
    taken = quota.take_quotas(frame, {"s0": 2, "s1": 0}).collect()
    assert sorted(r["doc_id"] for r in taken) == [0, 3]
    first, second = frame.filter("doc_id < 10"), frame.filter("doc_id >= 10")
    # what the first source's limit leaves out may come from the second
    found = quota.collect_conversations([(first, 2), (second, None)], 4, "key", "doc_id").collect()
    assert [(r["source_idx"], r["key"]) for r in found] == [(0, "k0"), (0, "k1"), (1, "k2"), (1, "k3")]
    assert quota.collect_conversations([(first, 0)], 4, "key", "doc_id").count() == 0


def test_qa_records(spark):
    good = grounded.normalize_qa(qa(spark, "文章：LSM 使用 recurrent state。\n問題：LSM 使用什麼？", '{"answer": "recurrent state", "answerable": true}')).first()
    assert [m["content"] for m in good["messages"]][1:] == ["LSM 使用什麼？", "recurrent state [1]"]
    assert "DRCD/42\nLSM" in good["messages"][0]["content"] and good["kind"] == "drcd_answerable"
    refusal = grounded.normalize_qa(qa(spark, "文章：x。\n問題：y", '{"answer": "", "answerable": false}', None)).first()
    assert refusal["messages"][2]["content"] == REFUSAL and "DRCD/q" in refusal["messages"][0]["content"]
    two = grounded.normalize_qa(qa(spark, "文章：a\n問題：b\n問題：c", '{"answer": "a", "answerable": true}')).first()
    assert two["messages"][1]["content"] == "c"
    for bad in ("{", '{"answer": "a", "answerable": 1}', '{"answer": 1, "answerable": true}', "[]", '"x"', "null"):
        assert grounded.normalize_qa(qa(spark, "文章：a\n問題：b", bad)).count() == 0


def test_qa_limit_and_counters(spark):
    rows = spark.createDataFrame([(i, "a", f"q{i}", conversation(("user", f"文章：x{i}\n問題：y"), ("assistant", '{"answer": "x", "answerable": true}' if i % 3 else "{"))) for i in range(10)], f"row_idx long, article_id string, qid string, messages {MESSAGES}")
    made, counted = grounded.qa_records(rows, 4)
    assert [r["qid"] for r in made.collect()] == ["q1", "q2", "q4", "q5"] and counted == {"read": 10, "valid": 6, "skipped": 4, "taken": 4}
    with pytest.raises(ValueError):
        grounded.qa_records(rows.filter("row_idx = 0"), 4)


def test_repeated_and_null_ids_lose_and_double_nothing(spark):
    text = "a text that is long enough to stay here"
    rows = [(None, text), (2, text), (2, text), (None, text), (5, text + " more"), (5, text + " more"), (None, None), (7, "short"), (None, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    options = CleanOptions(min_cjk_ratio=0.0)
    assert sorted((r["doc_id"], r["text"]) for r in clean.clean_corpus(frame, options).collect()) == [(2, text), (5, text + " more")]
    assert {r["outcome"]: r["count"] for r in clean.outcomes(frame, options).groupBy("outcome").count().collect()} == {"accepted": 2, "duplicate": 4, "too_short": 2}
    keyed = frame.filter("text IS NOT NULL")
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in clean.first_of_equal(keyed, "text", ["doc_id"]).collect()) == [(2, text), (5, text + " more"), (7, "short")]
    only_null = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert clean.clean_corpus(only_null, options).count() == 1
    assert quota.collect_conversations([(keyed, None)], 10, "text", "doc_id").count() == 3 == quota.merge_records([keyed, keyed], "text", "doc_id").count()


def test_answer_window(spark):
    prompt = f"文章：{'前' * 100}正確答案{'後' * 100}\n問題：答案是什麼？"
    found = grounded.normalize_qa(qa(spark, prompt, '{"answer": "正確答案", "answerable": true}'), 40).first()
    context = found["messages"][0]["content"].partition("DRCD/42\n")[2]
    assert "正確答案" in context and len(context) == 40


def test_synthesis(spark):
    chunks = spark.createDataFrame([(0, "lsm.md", 0, "# LSM\nLSM 使用 recurrent state 與 chunkwise kernel。")], "doc_id long, source string, chunk_idx int, text string")
    found = grounded.synthesize(chunks, grounded.SynthesisOptions(examples_per_chunk=7)).orderBy("idx").collect()
    assert len(found) == 9
    assert "參考資料" in found[0]["messages"][0]["content"] and "LSM" in found[0]["messages"][1]["content"]
    assert found[0]["messages"][2]["content"] == "LSM 使用 recurrent state 與 chunkwise kernel。 [1]"
    assert found[6]["kind"] == "rag_fact" and found[6]["messages"][2]["content"].endswith("[1]")
    assert [r["kind"] for r in found[7:]] == ["rag_refusal"] * 2
    assert grounded.synthesize(chunks.withColumn("text", F.lit("# only"))).count() == 0


def test_neighbours_wrap(spark):
    chunks = spark.createDataFrame([(i, "s", 0, f"t{i}") for i in range(5)], "doc_id long, source string, chunk_idx int, text string")
    found = grounded.with_neighbours(chunks, 3, ["doc_id", "chunk_idx"]).orderBy("doc_id").collect()
    assert [[x["text"] for x in r["selected"]] for r in found] == [[f"t{(i + k) % 5}" for k in range(3)] for i in range(5)]


def test_sampling(spark):
    logits = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 2.0])], "vec_id int, embedding array<double>")
    assert {r["token"] for r in sampling.sampling_filter(logits, top_k=1).collect()} == {2, 3}  # ties stay
    assert {r["token"] for r in sampling.sampling_filter(logits, top_p=0.1).collect()} == {2}
    held = sampling.sampling_filter(logits, top_k=1, history=F.array(F.lit(2)), penalty=4.0)
    assert {r["token"] for r in held.collect()} == {3}
    tokens = spark.createDataFrame([(1, list(range(10))), (2, [1, 2, 3])], "doc_id int, tokens array<int>")
    found = sampling.packed_windows(tokens, 3).collect()
    assert [(r["x"], r["y"]) for r in found] == [([0, 1, 2], [1, 2, 3]), ([3, 4, 5], [4, 5, 6])]
    again = [sampling.random_windows(tokens, 3, 4, 9).select("draw", "start").collect() for _ in range(2)]
    assert again[0] == again[1] and all(0 <= r["start"] < 6 for r in again[0])
    kept = spark.range(20000).select(F.col("id").alias("vec_id"), F.explode(F.array(F.struct(F.lit(2).alias("token"), F.lit(0.25).alias("p")), F.struct(F.lit(5).alias("token"), F.lit(0.75).alias("p"))))).select("vec_id", "col.*")
    draws = sampling.drawn_tokens(kept, 3)
    assert draws.count() == 20000 and abs(draws.filter("token = 5").count() / 20000 - 0.75) < 0.02
    choice = sampling.weighted_choice(spark.range(20000).withColumnRenamed("id", "draw"), [1, 3], 5)
    assert abs(choice.filter("source_idx = 1").count() / 20000 - 0.75) < 0.02
    batches = sampling.epoch_batches(spark.range(10).withColumnRenamed("id", "doc_id"), 4, 0, 1).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in batches] == [(0, 4), (1, 4), (2, 2)]


def test_schedules(spark):
    frame = spark.createDataFrame([(0,), (50,), (100,), (1000,)], "s long")
    rates = [r[0] for r in frame.select(schedule.pretrain_rate("s", 1000, 100, 1.0)).collect()]
    assert rates == pytest.approx([0.0, 0.5, 1.0, 0.1])
    assert schedule.pretrain_steps(100, 0, 3, 2, 5) == 4
    assert schedule.tuning_steps(10, 3, 2, 2, 0.1) == (4, 1)


def test_web_parsing(spark):
    payload = lambda x: spark.createDataFrame([(json.dumps(x),)], "payload string")
    assert [tuple(r) for r in web.web_hits(payload({"web": {"results": [{"title": " a ", "url": "u", "description": "d"}, {"title": 3, "url": "u", "description": "d"}]}})).collect()] == [("a", "u", "d")]
    assert web.web_hits(payload({"web": []})).count() == 0
    pages = web.wiki_hits(payload({"pages": [{"title": "A B", "excerpt": "<span>x</span> y"}, {"title": "C", "excerpt": None, "description": "d"}, {"title": "D"}]})).collect()
    assert [tuple(r) for r in pages] == [("Wikipedia: A B", "https://zh.wikipedia.org/wiki/A_B", "x y"), ("Wikipedia: C", "https://zh.wikipedia.org/wiki/C", "d")]
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T\n t</title><id>http://x</id><summary> s </summary></entry></feed>'
    assert [tuple(r) for r in web.atom_hits(spark.createDataFrame([(feed,)], "payload string")).collect()] == [("arXiv: T t", "http://x", "s")]

    def get(url):
        if "arxiv" in url:
            raise OSError("down")
        return json.dumps({"pages": [{"title": str(i), "excerpt": "x"} for i in range(5)]})

    assert web.search_free(spark, "q", get, 3).count() == 3


def test_manifests(tmp_path, monkeypatch):
    assert manifests.text_sources([{"dataset": "d"}])[0].text_column == "text"
    for bad in ([], [{}], [{"dataset": "d", "limit": 0}], [{"dataset": "d", "limit": True}], "x"):
        with pytest.raises(ValueError):
            manifests.text_sources(bad)
    with pytest.raises(ValueError):
        manifests.chat_sources([{"dataset": "d", "format": "x"}])
    (tmp_path / "mix.json").write_text('[{"path": "a", "weight": 1}, {"path": "b", "weight": 3}]')
    assert manifests.training_mix(str(tmp_path / "mix.json")) == [(str(tmp_path / "a"), 0.25), (str(tmp_path / "b"), 0.75)]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert manifests.json_config(str(tmp_path / "c.json"), ["a"]) == {"a": 1}
    with pytest.raises(ValueError):
        manifests.json_config(str(tmp_path / "c.json"), ["b"])
    assert manifests.overlay({"a": 1, "b": 2}, {"b": 3}, {"a": None, "b": 4}) == {"a": 1, "b": 4}
    (tmp_path / ".env").write_text("# c\nLX_A=1\nLX_B='two'\nnonsense\n")
    monkeypatch.setenv("LX_A", "kept")
    monkeypatch.delenv("LX_B", raising=False)
    assert manifests.load_env(str(tmp_path / ".env")) == {"LX_B": "two"}
    monkeypatch.delenv("LX_B")


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A\nalpha text")
    (tmp_path / "in" / "sub" / "b.TXT").write_text("beta")
    (tmp_path / "in" / "c.png").write_text("no")
    folder = readers.read_folder(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "b.mD").write_text("gamma")
    assert [r["source"] for r in folder.orderBy("doc_id").collect()] == ["a.md", "sub/b.TXT"]
    assert [r["source"] for r in readers.read_folder(spark, str(tmp_path / "in")).orderBy("doc_id").collect()] == ["a.md", "b.mD", "sub/b.TXT"]
    (tmp_path / "in" / "b.mD").unlink()
    chunks = build_chunks(folder.withColumn("doc_id", F.xxhash64("source")))
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    assert readers.read_chunks(spark, str(tmp_path / "chunks")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_chunks(chunks.limit(0), str(tmp_path / "none"))
    (tmp_path / "i.json").write_text(json.dumps({"version": 1, "chunks": [{"source": "s", "text": "t"}]}))
    assert readers.import_chunks(spark, str(tmp_path / "i.json")).first()["text"] == "t"
    (tmp_path / "j.json").write_text(json.dumps({"version": 2, "chunks": []}))
    with pytest.raises(ValueError):
        readers.import_chunks(spark, str(tmp_path / "j.json"))
    spark.createDataFrame([("a  b",), ("",), (None,), ("c",)], "body string").write.parquet(str(tmp_path / "t.parquet"))
    sources = manifests.text_sources([{"dataset": str(tmp_path / "t.parquet"), "text_column": "body", "limit": 1}, {"dataset": str(tmp_path / "t.parquet"), "text_column": "body"}])
    assert [(r["source_idx"], r["text"]) for r in readers.read_sources(spark, sources).orderBy("source_idx", "row_idx").collect()] == [(0, "a b"), (1, "a b"), (1, "c")]
    records = spark.createDataFrame([(conversation(("user", "é")), "s", "k", None)], f"messages {MESSAGES}, source string, kind string, qid string")
    sinks.write_records(records, str(tmp_path / "r"))
    assert readers.read_records(spark, str(tmp_path / "r")).first()["messages"][0]["content"] == "é"
    stream = sinks.token_stream(spark.createDataFrame([([1, 258],)], "tokens array<int>")).first()
    assert bytes(stream["data"]) == b"\x01\x00\x02\x01"
    ids = [[5, 258, 3], [3], [0x0300, 0x0A0D, 0, 0xFFFE, 3], [0x4103, 0x0003 << 8, 3]]
    for name, some in (("one", ids), ("two", ids[:2])):
        sinks.write_token_stream(spark.createDataFrame([(x,) for x in some], "tokens array<int>").coalesce(1), str(tmp_path / name))
    import numpy as np

    (part,) = (tmp_path / "one").glob("part-*")
    assert np.fromfile(part, dtype="<u2").tolist() == [i for x in ids for i in x]
    assert [r["tokens"] for r in readers.read_token_stream(spark, str(tmp_path / "one")).orderBy("doc_idx").collect()] == ids
    (tmp_path / "m.json").write_text('[{"path": "one", "weight": 1}, {"path": "two", "weight": 3}]')
    mix = readers.read_token_mix(spark, str(tmp_path / "m.json")).collect()
    assert {(r["source_idx"], r["share"]) for r in mix} == {(0, 0.25), (1, 0.75)} and len(mix) == 6
    with pytest.raises(Exception, match="two bytes"):
        sinks.write_token_stream(spark.createDataFrame([([1, 2],)], "tokens array<int>"), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="no .md"):
        readers.read_folder(spark, str(tmp_path / "t.parquet"))
    vectors = spark.createDataFrame([("s", "t", [1.0, 2.0], "m")], "source string, text string, embedding array<double>, model string")
    sinks.write_vectors(vectors, str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v"), "m").count() == 1
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path / "v"), "other")


def test_fingerprint(spark):
    import hashlib

    messages = conversation(("user", "é"), ("assistant", "b"))
    frame = spark.createDataFrame([(messages,)], f"messages {MESSAGES}")
    expected = hashlib.blake2b(json.dumps(messages, ensure_ascii=False, sort_keys=True).encode(), digest_size=16).hexdigest()
    assert frame.select(message_fingerprint("messages")).first()[0] == expected


def test_workflows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = run_corpus(spark, docs, str(tmp_path / "corpus"), CleanOptions(min_cjk_ratio=0.0), 0.2, 600)
    assert {r["split"] for r in made.select("split").distinct().collect()} == {"train", "valid"}
    assert made.filter("element_at(tokens, -1) <> 3").count() == 0
    flow = Workflow(spark, str(tmp_path / "corpus"))
    again = run_corpus(spark, docs.orderBy(F.desc("doc_id")), flow.folder, CleanOptions(min_cjk_ratio=0.0), 0.2, 600, flow=flow)
    assert again.count() == made.count() and flow.ran == []  # resumed: the same rows in another order
    flow = Workflow(spark, flow.folder)
    assert run_corpus(spark, docs.limit(90), flow.folder, CleanOptions(min_cjk_ratio=0.0), 0.2, 600, flow=flow).count() < made.count()
    assert flow.ran == ["clean", "split", "tokenizer", "tokens"]
    with pytest.raises(ValueError):
        run_corpus(spark, docs, str(tmp_path / "other"))  # no CJK text passes the default rule
    model = encode.train_tokenizer(docs, 600)
    talks = chat.conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    examples = run_chat(spark, [(manifests.ChatSource("c", format="conversations", messages_column="messages"), talks)], str(tmp_path / "chat"), model)
    assert examples.count() > 0 and examples.filter("size(input_ids) <> 512 OR size(labels) <> 512").count() == 0
    assert readers.read_examples(spark, str(tmp_path / "chat" / "examples"), 512, 10**6).count() == examples.count()
    chunks = build_chunks(docs.limit(5))
    merged = run_grounded(spark, str(tmp_path / "grounded"), model, qa(spark, "文章：a\n問題：b", '{"answer": "a", "answerable": true}'), chunks, max_length=4096)
    assert {"drcd_answerable", "rag_summary", "rag_refusal"} <= {r["kind"] for r in merged.select("kind").distinct().collect()}
    with pytest.raises(ValueError):
        run_grounded(spark, str(tmp_path / "none"), model)
    counted = counters(docs, made, "tokens").first()
    assert counted["read"] == docs.count() and counted["accepted"] + counted["skipped"] == counted["read"] and counted["tokens"] > counted["accepted"]
    other = run_corpus(spark, docs, str(tmp_path / "corpus"), CleanOptions(min_cjk_ratio=0.0, min_chars=60), 0.2, 600)
    assert other.count() < made.count()  # other options, so not the old tables


def test_streaming_keeps_the_first(spark, tmp_path):
    from lexmill.streaming.clean_stream import clean_stream, event_windows

    text = "a text that is long enough to stay here"
    rows = spark.createDataFrame([(1, text), (2, text), (3, "short"), (4, text + " more")], "doc_id long, text string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = clean_stream(stream, CleanOptions(min_cjk_ratio=0.0)).writeStream.format("memory").queryName("cleaned").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["text"] for r in spark.table("cleaned").collect()) == [text, text + " more"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_windows(events).agg(F.sum("n_events")).first()[0] == events.count()


def test_converters_and_command_line(spark, tmp_path, capsys):
    from lexmill import __main__ as cli
    from lexmill.functions.convert import opencc_converter, phrase_converter
    from lexmill.functions.udfs import converted

    convert = phrase_converter({"软件": "軟體", "软": "軟", "国": "國"})
    frame = spark.createDataFrame([("软件和软国x",), (None,), ("",)], "text string")
    assert [r[0] for r in frame.select(converted("text", convert)).collect()] == ["軟體和軟國x", None, ""]
    with pytest.raises(ValueError):
        opencc_converter("s2x")
    docs = "/root/testdata/sf0.001/documents.parquet"
    cli.main(["clean", docs, str(tmp_path / "clean"), "--min-cjk-ratio", "0", "--report", str(tmp_path / "r.json")])
    report = json.loads(capsys.readouterr().out)
    assert report["counts"]["accepted_documents"] == spark.read.parquet(str(tmp_path / "clean")).count()
    assert json.loads((tmp_path / "r.json").read_text()) == report
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("The state mixer uses a recurrent state. Nothing else is here.")
    cli.main(["index", str(tmp_path / "notes"), str(tmp_path / "chunks")])
    cli.main(["ask", str(tmp_path / "chunks"), "recurrent state mixer", "--least", "0"])
    assert "[1] 來源：a.md\nThe state mixer uses a recurrent state. [1]" in capsys.readouterr().out
    cli.main(["records", str(tmp_path / "chunks"), str(tmp_path / "records")])
    cli.main(["encode", docs, str(tmp_path / "stream"), "--vocabulary", "600"])
    assert readers.read_token_stream(spark, str(tmp_path / "stream")).count() == json.loads(capsys.readouterr().out.splitlines()[-1])["accepted"]


def test_more_commands(spark, tmp_path, capsys):
    from lexmill import __main__ as cli

    said = lambda *args: (cli.main([str(a) for a in args]), capsys.readouterr().out.strip())[1]
    rows = [(0, 0, "a.md", "The state mixer uses a recurrent state. Nothing else is here."), (1, 0, "b.md", "Bread needs flour and water."), (2, 0, "b.md", "Bread needs flour and water.")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_idx int, source string, text string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    assert said("postings", tmp_path / "chunks", tmp_path / "index") == "3 chunks"
    query = "recurrent state mixer"
    plain = said("ask", tmp_path / "chunks", query, "--least", 0)
    assert said("ask", tmp_path / "index", query, "--index", "--least", 0) == plain and "[1] 來源：a.md" in plain
    shown = said("ask", tmp_path / "index", query, "--index", "--least", 0, "--show-sources", "--output", tmp_path / "said.txt")
    assert shown.startswith("[1] a.md (") and (tmp_path / "said.txt").read_text().startswith(f"{query}\n[1]")
    answer = "The state mixer uses a recurrent state. Cheese is made of moonlight."
    verified = said("ask", tmp_path / "chunks", query, "--least", 0, "--mode", "verified", "--answer", answer)
    assert verified == "The state mixer uses a recurrent state. [1]"
    assert said("ask", tmp_path / "chunks", query, "--least", 0, "--mode", "reliable", "--answer", "不知道") == plain
    assert said("ask", tmp_path / "chunks", query, "--least", 0, "--mode", "generate", "--answer", answer) == answer
    for bad in (["--mode", "verified"], ["--least", 99]):
        with pytest.raises(ValueError):
            cli.main(["ask", str(tmp_path / "index"), query, "--index", *map(str, bad)])
    assert said("dedup", tmp_path / "chunks", tmp_path / "new", tmp_path / "store", "one") == "2 documents"
    assert said("dedup", tmp_path / "chunks", tmp_path / "newer", tmp_path / "store", "two") == "0 documents"
    (tmp_path / "d.json").write_text(json.dumps({"flour": "meal"}))
    assert said("convert", tmp_path / "chunks", tmp_path / "converted", tmp_path / "d.json") == "3 documents"
    assert spark.read.parquet(str(tmp_path / "converted")).filter("text LIKE '%meal%'").count() == 2
    assert said("vectors", "/root/testdata/sf0.001/embeddings.parquet", tmp_path / "v", "--clusters", 5) == "500 vectors in 5 clusters"
    chat.conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).write.parquet(str(tmp_path / "talks.parquet"))
    (tmp_path / "m.json").write_text(json.dumps([{"dataset": str(tmp_path / "talks.parquet"), "format": "conversations", "messages_column": "messages", "limit": 5}]))
    assert said("chat", tmp_path / "m.json", tmp_path / "records") == "5 conversations"
    qa(spark, "文章：a\n問題：b", '{"answer": "a", "answerable": true}').write.parquet(str(tmp_path / "qa"))
    said("qa", tmp_path / "qa", tmp_path / "grounded")
    assert spark.read.json(str(tmp_path / "grounded")).first()["kind"] == "drcd_answerable"


def test_search_web_and_answers(spark, tmp_path):
    asked = []

    def get(url):
        asked.append(url)
        return json.dumps({"web": {"results": [{"title": str(i), "url": "u", "description": "d"} for i in range(5)]}})

    assert web.search_web(spark, "a b", get, 2).count() == 2 and "q=a+b" in asked[0]
    with pytest.raises(ValueError):
        web.search_web(spark, " ", get)
    with pytest.raises(OSError):
        web.fetch("http://127.0.0.1:9/none", seconds=1)
    sinks.write_answer("p", "a", str(tmp_path / "x" / "out.txt"))
    assert (tmp_path / "x" / "out.txt").read_text() == "pa\n"


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from lexmill.session import checkpoint_folder

    made = []
    context = SimpleNamespace(getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
    assert checkpoint_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: "hdfs://x"))) == "hdfs://x"


def test_content_digests(spark):
    rows = [(1, "a", None, [None, "x"], {"k": 1}), (2, None, "a", ["x", None], None), (2, None, "a", ["x", None], None)]
    schema = "n int, s string, t string, xs array<string>, m map<string,int>"
    frame = spark.createDataFrame(rows, schema)
    same = content_digest(frame)
    assert content_digest(spark.createDataFrame(rows[::-1], schema).repartition(3)) == same
    for other in (rows[:2], rows[:1] + [(2, "a", None, ["x", None], None)] * 2, [(1, "a", None, ["x", None], {"k": 1}), *rows[1:]], [(1, "a", None, [None, "x"], {"k": 2}), *rows[1:]]):
        assert content_digest(spark.createDataFrame(other, schema)) != same
    assert content_digest(frame.withColumnRenamed("n", "n2")) != same
    assert content_digest(frame.limit(0)) != same


def test_stages_rerun_what_depends_on_a_change(spark, tmp_path):
    def go(a, b, add):
        flow = Workflow(spark, str(tmp_path / "flow"))
        flow.given("a", spark.range(a))
        flow.given("b", spark.range(b))
        x = flow.stage("x", lambda: spark.range(a), needs=["a"])
        y = flow.stage("y", lambda: spark.range(b).withColumn("v", F.lit(add)), add, needs=["b"])
        return flow.stage("z", lambda: x.crossJoin(F.broadcast(y.select("v"))), needs=["x", "y"]).count(), flow.ran

    assert go(3, 2, 1) == (6, ["x", "y", "z"])
    assert go(3, 2, 1) == (6, [])
    assert go(3, 4, 1) == (12, ["y", "z"])
    assert go(3, 4, 5) == (12, ["y", "z"])
    assert go(3, 2, 1) == (6, [])  # the first tables are still there
