from __future__ import annotations

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.functions import text as t
from lexmill.functions.udfs import chunks_of, converted, normalize, normalized, translated
from lexmill.operators.clean import CleanOptions, outcomes, reject_reason, report

ALPHABET = "ab Z9.!?_-+\n\t\r\x0b\x1c\x1f\x85\xa0　​\x00。！？、中文字龍ſKİ😀é,1234 #"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def column_values(spark, texts, make):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["x"] for r in frame.select("i", make("text").alias("x")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    return ["", " ", "\n", *("".join(r.choice(ALPHABET) for _ in range(r.randint(1, 60))) for _ in range(400))]


def test_normalize_literals(spark):
    assert column_values(spark, ["  臺灣\x00\n 語言　模型  ", " a\x00b \t c "], normalize) == ["臺灣 語言 模型", "ab c"]


def test_normalize_matches_the_rule(spark, texts):
    def rule(s):
        s = unicodedata.normalize("NFKC", s)
        s = "".join(" " if c.isspace() else "" if unicodedata.category(c).startswith("C") else c for c in s)
        return re.sub(" +", " ", s).strip()

    assert column_values(spark, texts, normalize) == [rule(s) for s in texts]
    assert [normalized(s) for s in texts] == [rule(s) for s in texts]


def test_tokens_match_the_rule(spark, texts):
    def rule(s):
        low = s.lower()
        out = re.findall(r"[a-z0-9][a-z0-9_.+-]*", low, re.I)
        for run in re.findall(r"[㐀-鿿]+", low):
            out += list(run) + [run[i : i + 2] for i in range(len(run) - 1)]
        return sorted(out)

    assert [sorted(x) for x in column_values(spark, texts, t.tokens)] == [rule(s) for s in texts]


def test_sentences_match_the_rule(spark, texts):
    rule = lambda s: [x.strip() for x in re.split(r"(?<=[。！？.!?])\s*", s) if x.strip()]
    assert column_values(spark, texts, t.sentences) == [rule(s) for s in texts]
    assert column_values(spark, ["It is 3.14 now."], t.sentences) == [["It is 3.", "14 now."]]


@pytest.mark.parametrize("limit", [1, 7, 20])
def test_truncate_matches_the_rule(spark, texts, limit):
    def rule(s):
        s = s.strip()
        if len(s) <= limit:
            return s
        at = max(s.rfind(m, 0, limit) for m in "。\n.")
        return s[: at + 1 if at >= limit // 2 else limit].rstrip()

    assert column_values(spark, texts, lambda c: t.truncate(c, limit)) == [rule(s) for s in texts]


def test_prose_matches_the_rule(spark, texts):
    rule = lambda s: " ".join(x.strip().lstrip("- ") for x in s.splitlines() if x.strip() and not x.lstrip().startswith("#")).strip()
    assert column_values(spark, texts, lambda c: t.prose(c, 10_000)) == [rule(s) for s in texts]


def test_runs(spark):
    assert column_values(spark, ["x" * 16, "x" * 17, "😀" * 17, "ab" * 20], lambda c: t.has_run(c, 16)) == [False, True, True, False]


def test_numbers(spark):
    found = column_values(spark, ["長度為 128 tokens。", "為128", "3.5% and 7GB", "2024年的", "2024年。"], t.numbers)
    assert found == [["128"], [], ["3.5", "7GB"], [], ["2024年"]]


def test_duration(spark):
    frame = spark.createDataFrame([(0.5,), (1.5,), (3661.0,), (-4.0,)], "s double")
    assert [r[0] for r in frame.select(t.duration("s")).collect()] == ["0:00:00", "0:00:02", "1:01:01", "0:00:00"]


def test_prompts(spark):
    assert one(spark, t.chat_prompt("p", "s"), p=" hi ", s=" be ") == "<|system|>\nbe\n<|user|>\nhi\n<|assistant|>\n"
    assert one(spark, t.chat_prompt("p"), p="hi") == "<|user|>\nhi\n<|assistant|>\n"
    assert one(spark, t.grounding_prompt("r"), r=" [1] x ").endswith("參考資料：\n[1] x")


def test_topic(spark):
    assert one(spark, t.topic("a", "b"), a="\n## LSM ##\nx", b="x.md") == "LSM ##"
    assert one(spark, t.topic("a", "b"), a="#\n", b="docs/my_file.md") == "my file"
    assert one(spark, t.topic("a", "b"), a="", b="") == "參考資料中的主題"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n。", max_size=80), st.integers(1, 20), st.integers(0, 19))
def test_chunks_cover_the_text(text, size, overlap):
    if overlap >= size:
        return
    chunks = chunks_of(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    squeezed = re.sub(r"\s", "", text)
    assert set(squeezed) <= set("".join(chunks)) and (bool(chunks) == bool(squeezed))


def test_chunk_edges():
    assert chunks_of("", 5, 1) == [] == chunks_of("\n\n\n", 5, 1)
    assert chunks_of("abcdefgh", 4, 0) == ["abcd", "efgh"]
    assert chunks_of("abc.efgh", 4, 0) == ["abc.", "efgh"]
    assert chunks_of("ab.defgh", 4, 0) == ["ab.d", "efgh"]  # the mark isn't beyond the half


def test_injected_functions(spark):
    assert column_values(spark, ["a", None], lambda c: converted(c, str.upper)) == ["A", None]
    assert column_values(spark, ["a", "b"], lambda c: translated(c, lambda xs: [" x " if x == "a" else "" for x in xs])) == ["x", "b"]
    with pytest.raises(Exception, match="translations"):
        column_values(spark, ["a"], lambda c: translated(c, lambda xs: []))


def test_reject_reasons(spark):
    options = CleanOptions(20, 100, 0.15, 0.3, 16)
    texts = ["太短", "x" * 30, "中" * 17 + "文內容足夠長", "這是一段內容完整的繁體中文文件，用於測試語料清理流程是否保留正常資料。", "中" * 101, "中文內容 https://example.com/abcdefg 中文字字字"]
    frame = spark.createDataFrame([(x,) for x in texts], "text string")
    found = [r[0] for r in frame.select(reject_reason("text", options)).collect()]
    assert found == ["too_short", "not_chinese_enough", "repeated_characters", None, "too_long", "url_heavy"]


def test_outcomes_keep_the_first_and_count(spark):
    text = "a text that is long enough to stay"
    frame = spark.createDataFrame([(3, text), (1, f" {text}\n"), (2, "short"), (4, None)], "doc_id long, text string")
    judged = outcomes(frame, CleanOptions(min_cjk_ratio=0.0))
    assert {r["doc_id"]: r["outcome"] for r in judged.collect()} == {1: "accepted", 2: "too_short", 3: "duplicate"}
    r = report(judged).first()
    assert r["counts"] == {"accepted_documents": 1, "duplicate": 1, "input_documents": 3, "too_short": 1}
    assert r["accepted_characters"] == len(text) == r["average_accepted_characters"]
    empty = report(outcomes(frame.limit(0))).first()
    assert empty["accepted_characters"] == 0


def test_options_are_checked():
    for bad in ({"min_chars": 0}, {"max_chars": 5}, {"min_cjk_ratio": 1.1}, {"max_url_ratio": -1}, {"max_repeated_char": 1}):
        with pytest.raises(ValueError):
            CleanOptions(**bad)
