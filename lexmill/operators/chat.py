"""Chat records: normalised messages, fingerprints, answer-masked encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column, strip

ROLES = ("system", "user", "assistant")
#: The label of tokens that aren't learned.
IGNORE = -100


def keep_known(messages: Column) -> Column:
    """Messages of known roles with stripped, non-empty content; a null content counts as empty."""
    clean = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    return F.filter(clean, lambda m: m["role"].isin(*ROLES) & (m["content"] != ""))


def valid(messages: Column) -> Column:
    """two or more messages, the last one the assistant's."""
    return (F.size(messages) >= 2) & (F.get(messages, F.size(messages) - 1)["role"] == "assistant")


def normalize_conversations(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """P24 for conversations: rows whose messages are valid once normalised."""
    return rows.withColumn(messages, keep_known(F.col(messages))).filter(valid(F.col(messages)))


def normalize_alpaca(rows: DataFrame, instruction: str = "instruction", extra: str = "input", output: str = "output") -> DataFrame:
    """P24 for instruction, input and output columns: adds messages, keeps valid rows."""
    more = strip(F.coalesce(F.col(extra), F.lit("")))
    user = F.concat(strip(instruction), F.when(more != "", F.concat(F.lit("\n\n"), more)).otherwise(""))
    pair = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(output).alias("content")))
    read = rows.filter(F.col(instruction).isNotNull() & F.col(output).isNotNull()).withColumn("messages", keep_known(pair))
    return read.filter(valid(F.col("messages")))


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation from a table of turns, in their order. A conversation's turns are one group by nature."""
    gathered = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
    return gathered.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def conversation_digest(messages: str = "messages") -> Column:
    """A key that equal conversations share, from built-ins; message_fingerprint (P25) is the exact hash."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e"), 256)


def render(messages: Column) -> Column:
    """The role template of whole conversations."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")


def tokenizer_ids(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """Ids of the texts of an array by an injected tokenizer, in Arrow batches."""

    @F.pandas_udf("array<array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[encode(t) for t in texts] for texts in batch], dtype=object)

    return run


def assemble(prefixes: Column, contents: Column, messages: Column, eos: int) -> tuple[Column, Column]:
    """E3 from the ids of each message's prefix and content: input ids, and labels of which only answers and their ends are learned."""
    parts = F.zip_with(prefixes, contents, lambda p, c: F.struct(p.alias("p"), c.alias("c")))
    each = F.zip_with(parts, messages, lambda x, m: F.struct(x["p"].alias("p"), x["c"].alias("c"), (m["role"] == "assistant").alias("learned")))
    end = F.array(F.lit(eos))
    none = F.array().cast("array<int>")
    hide = lambda ids: F.transform(ids, lambda _: F.lit(IGNORE))
    ids = F.flatten(F.transform(each, lambda x: F.concat(x["p"], x["c"], F.when(x["learned"], end).otherwise(none))))
    labels = F.flatten(F.transform(each, lambda x: F.concat(hide(x["p"]), F.when(x["learned"], F.concat(x["c"], end)).otherwise(hide(x["c"])))))
    return ids, labels


def encode_conversations(rows: DataFrame, ids: Callable[[Column], Column], max_length: int = 512, eos: int = 3, messages: str = "messages") -> DataFrame:
    """Adds input_ids and labels; rows over max_length or without anything to learn are dropped, never cut.

    ids maps an array of texts to an array of ids, as tokenizer_ids() does.
    """
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    prefixes = ids(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"))))
    contents = ids(F.transform(messages, lambda m: m["content"]))
    read = rows.withColumns({"p_": prefixes, "c_": contents})
    input_ids, labels = assemble(F.col("p_"), F.col("c_"), F.col(messages), eos)
    encoded = read.withColumns({"input_ids": input_ids, "labels": labels}).drop("p_", "c_")
    return encoded.filter((F.size("input_ids") <= max_length) & F.exists("labels", lambda x: x != IGNORE))


def pad(rows: DataFrame, max_length: int, pad_id: int = 0) -> DataFrame:
    """input_ids and labels of fixed length."""
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), max_length - F.size(c)))
    return rows.withColumns({"input_ids": fill("input_ids", pad_id), "labels": fill("labels", IGNORE)})


def next_token(ids: Column | str, labels: Column | str) -> tuple[Column, Column]:
    """Inputs without the last token, labels without the first."""
    a, b = column(ids), column(labels)
    return F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(2), F.size(b) - 1)
