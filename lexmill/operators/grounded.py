"""Grounded records from question-answer rows and from chunks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REFUSAL, column, computed, facts, grounding_prompt, let, prose, rstrip, strip, topic, truncate
from ..session import checkpointed

# Question templates; {} stands for the topic.
SUMMARY_QUESTIONS = (
    "請根據參考資料，簡要說明「{}」。",
    "請只依據參考資料回答：「{}」的重點是什麼？",
    "根據參考資料，請以繁體中文整理「{}」的關鍵資訊。",
    "請根據參考資料解釋「{}」的技術設計，不要加入資料外的推測。",
    "若只能使用參考資料，應如何回答「{}」？",
    "請將參考資料中關於「{}」的內容改寫成簡潔說明。",
)
FACT_QUESTIONS = (
    "請指出參考資料中一項關於「{}」可驗證的事實。",
    "根據參考資料，「{}」如何運作？請只回答資料明示的內容。",
    "參考資料提到「{}」的哪個特性？",
    "請用一句話整理參考資料對「{}」的描述。",
)
REFUSAL_QUESTIONS = (
    "參考資料沒有提供的資訊是什麼？請不要猜測。",
    "請列出參考資料未記載的硬體價格與規格。",
    "如果參考資料不足以回答，應如何回覆？",
)
# Marks of the parts of a question-answer prompt, and the source that its records name.
CONTEXT_MARK, QUESTION_MARK = "文章：", "\n問題："
QA_SOURCE = "steven0226/drcd-zhtw-extractive-qa-sft"


def first_content(messages: Column | str, role: str) -> Column:
    """Stripped content of the first message of a role that has content, or null."""
    return strip(F.get(F.filter(column(messages), lambda m: (m["role"] == role) & m["content"].isNotNull()), F.lit(0))["content"])


def prompt_parts(prompt: Column) -> tuple[Column, Column]:
    """Context and question of a prompt, split at its last question line; null if it isn't of that form."""
    question = F.when(F.startswith(prompt, F.lit(CONTEXT_MARK)) & F.contains(prompt, F.lit(QUESTION_MARK)), F.substring_index(prompt, QUESTION_MARK, -1))
    before = let(question, lambda q: F.substring(prompt, F.lit(len(CONTEXT_MARK) + 1), F.length(prompt) - F.length(q) - len(QUESTION_MARK + CONTEXT_MARK)))
    return strip(before), strip(question)


def evidence_window(context: Column, answer: Column, limit: int) -> Column:
    """At most `limit` characters around the answer's first place, or the start of the context without one."""
    at = F.when(answer != "", F.position(answer, context)).otherwise(0) - 1
    stop = F.least(F.length(context), F.greatest(at - limit // 2, F.lit(0)) + limit)
    around = strip(F.substring(context, F.greatest(stop - limit, F.lit(0)) + 1, F.lit(limit)))
    return F.when(F.length(context) <= limit, context).when(at < 0, rstrip(F.substring(context, 1, limit))).otherwise(around)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def normalize_qa(rows: DataFrame, max_context_chars: int = 320, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (messages, article_id, qid) as grounded records (messages, source, kind, qid, and the columns in keep); rows that don't
    parse are dropped."""
    if max_context_chars <= 0:
        raise ValueError("max_context_chars must be positive")
    read = computed(rows.select(*keep, "article_id", "qid", "messages"), prompt=first_content("messages", "user"), response=first_content("messages", "assistant")).drop("messages")
    target = F.try_parse_json("response")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(target, path, "variant"))
    context, question = prompt_parts(F.col("prompt"))
    parsed = computed(
        read,
        context=context,
        question=question,
        # 0, 1 and "true" are no booleans, and numbers no strings
        answerable=F.when(kind("$.answerable") == "BOOLEAN", F.try_variant_get(target, "$.answerable", "boolean")),
        answer=F.when(kind("$.answer") == "STRING", strip(F.try_variant_get(target, "$.answer", "string"))),
    )
    parsed = parsed.filter("context <> '' AND question <> '' AND answerable IS NOT NULL AND answer IS NOT NULL")
    evidence = evidence_window(F.col("context"), F.when(F.col("answerable"), F.col("answer")).otherwise(""), max_context_chars)
    references = F.concat(F.lit("[1] 來源：DRCD/"), F.coalesce(F.col("article_id"), F.col("qid"), F.lit("drcd")), F.lit("\n"), evidence)
    completion = F.when(F.col("answerable") & (F.col("answer") != ""), F.concat("answer", F.lit(" [1]"))).otherwise(F.lit(REFUSAL))
    return parsed.select(
        F.array(message("system", grounding_prompt(references)), message("user", F.col("question")), message("assistant", completion)).alias("messages"),
        F.lit(QA_SOURCE).alias("source"),
        F.when(F.col("answerable"), "drcd_answerable").otherwise("drcd_refusal").alias("kind"),
        "qid",
        *keep,
    )


def qa_records(rows: DataFrame, limit: int, order: str = "row_idx", max_context_chars: int = 320) -> tuple[DataFrame, dict[str, int]]:
    """The first `limit` rows that parse, as records, and how many were read, valid, skipped and taken; an error if none is valid."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    made = checkpointed(normalize_qa(rows, max_context_chars, [order]))
    read, valid = rows.count(), made.count()
    if not valid:
        raise ValueError("no question-answer row is valid")
    return made.orderBy(order).limit(limit).drop(order), {"read": read, "valid": valid, "skipped": read - valid, "taken": min(limit, valid)}


@dataclass(frozen=True)
class SynthesisOptions:
    examples_per_chunk: int = 6
    context_chars: int = 180
    answer_chars: int = 180
    refusal_ratio: float = 0.25
    context_chunks: int = 1

    def __post_init__(self) -> None:
        if min(self.examples_per_chunk, self.context_chars, self.answer_chars, self.context_chunks) <= 0:
            raise ValueError("sizes must be positive")
        if not 0 <= self.refusal_ratio < 1:
            raise ValueError("refusal_ratio must be at least 0 and under 1")

    @property
    def refusals(self) -> int:
        return round(self.examples_per_chunk * self.refusal_ratio / max(1 - self.refusal_ratio, 1e-6))


def with_neighbours(chunks: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds selected, each chunk with the n - 1 that follow it in order, the first following the last.

    Chunks are numbered by range: a range's rows in order, after the rows of the ranges before it; each chunk is then sent to
    the n places that it is needed at.
    """
    spark = chunks.sparkSession
    if n == 1:
        return chunks.withColumn("selected", F.array(F.struct("source", "text")))
    ranged = chunks.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("number_", F.monotonically_increasing_id()).withColumn("range_", F.shiftright("number_", 33)))
    counts = ranged.groupBy("range_").count()
    starts = counts.select("range_", (F.sum("count").over(Window.orderBy("range_")) - F.col("count")).alias("start_"), F.sum("count").over(Window.partitionBy(F.lit(1))).alias("all_"))
    placed = ranged.join(F.broadcast(starts), "range_").withColumn("place_", F.col("start_") + F.col("number_").bitwiseAND((1 << 33) - 1))
    sent = placed.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at_"), "place_", "all_", "source", "text").select(F.pmod(F.col("place_") - F.col("at_"), "all_").alias("place_"), F.struct("at_", "source", "text").alias("part"))
    gathered = sent.groupBy("place_").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: F.struct(p["source"].alias("source"), p["text"].alias("text"))).alias("selected"))
    return placed.join(gathered, "place_").select(*chunks.columns, "selected")


def synthesize(chunks: DataFrame, options: SynthesisOptions = SynthesisOptions(), order: tuple[str, ...] = ("doc_id", "chunk_idx")) -> DataFrame:
    """Records (order columns, idx, messages, source, kind) of chunks; a chunk with an empty context or answer gives none."""
    n = options.context_chunks
    budget, short = max(1, options.context_chars // n), max(1, options.answer_chars // n)
    chosen = with_neighbours(chunks, n, list(order))
    read = chosen.withColumn("contexts", F.transform("selected", lambda c: F.struct(c["source"].alias("source"), truncate(c["text"], budget).alias("text"))))
    read = read.withColumn("answers", F.transform("contexts", lambda c: prose(c["text"], short)))
    usable = read.filter(F.forall("contexts", lambda c: c["text"] != "") & F.forall("answers", lambda a: a != ""))
    references = F.array_join(F.transform("contexts", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] 來源："), c["source"], F.lit("\n"), c["text"])), "\n\n")
    full = F.array_join(F.transform("answers", lambda a, i: F.concat(a, F.lit(" ["), (i + 1).cast("string"), F.lit("]"))), " ")
    found = facts(F.get("contexts", F.lit(0))["text"], options.answer_chars)
    base = usable.select(*order, "source", grounding_prompt(references).alias("system"), topic("text", "source").alias("topic"), full.alias("full"), found.alias("facts"), F.get("answers", F.lit(0)).alias("first"))
    base = base.withColumn("facts", F.when(F.size("facts") > 0, F.col("facts")).otherwise(F.array("first")))
    named = lambda template: F.concat(F.lit(template.partition("{}")[0]), F.col("topic"), F.lit(template.partition("{}")[2]))
    examples = []
    for i in range(options.examples_per_chunk):
        if i < len(SUMMARY_QUESTIONS):
            examples.append((i, named(SUMMARY_QUESTIONS[i]), F.col("full"), "rag_summary"))
        else:
            k = i - len(SUMMARY_QUESTIONS)
            fact = F.get("facts", F.lit(k) % F.size("facts"))
            examples.append((i, named(FACT_QUESTIONS[k % len(FACT_QUESTIONS)]), F.concat(fact, F.lit(" [1]")), "rag_fact"))
    for i in range(options.refusals):
        examples.append((options.examples_per_chunk + i, F.lit(REFUSAL_QUESTIONS[i % len(REFUSAL_QUESTIONS)]), F.lit(REFUSAL), "rag_refusal"))
    each = F.array(*[F.struct(F.lit(i).alias("idx"), q.alias("question"), a.alias("answer"), F.lit(kind).alias("kind")) for i, q, a, kind in examples])
    out = base.select(*order, "source", "system", F.inline(each))
    return out.select(*order, "idx", F.array(message("system", F.col("system")), message("user", F.col("question")), message("assistant", F.col("answer"))).alias("messages"), "source", "kind")
