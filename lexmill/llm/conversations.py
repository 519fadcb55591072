"""Conversation structure repair (operator 12): the cheapest edits after which the roles follow the grammar (s?(ua)+)?.

Each conversation is one forward Viterbi pass over four grammar states (nothing yet, after system, after user, after assistant).
A state carries its least (cost, audit string). A row's layer has keep, re-role and delete transitions; it is closed by insert
transitions, of which two in a row are enough to get from any state to any other. Two audits of one state and layer that cost the same differ at
some letter, as a longer one has dearer inserts, so the least stays least whatever follows. The audit fixes the repaired rows.

Rows meet by conversation in one shuffle, sorted by turn, and pass through the task as a stream, of which the conversation at hand
is held: it becomes one row of the result (audit and messages), so it isn't divided. The letters that all states agree on are set
aside, which keeps the work linear for long ones.

Results for odd input: a null conv_id is a conversation of its own; null turns come first, equal turns go by role and text; null
roles and texts are taken as one space; roles are compared by their first character, so a role that isn't system, user or assistant
is re-roled or deleted; repeated rows are duplicates; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row leads, by its role's first character and the state before it.
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Costs of re-roling, deleting and inserting a row, and of keeping one that is truncated.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows after which the audits' common beginning is set aside.
SETTLE = 256
WORD_CHARACTER = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = ("su", "ua", "au")
#: Characters of messages in a batch of results.
BATCH_CHARACTERS = 4_000_000

Best = list["tuple[int, str] | None"]


def spoken(state: int) -> int:
    """The state after a user's or assistant's row that fits here."""
    return ASSISTANT if state == USER else USER


def offer(best: Best, state: int, cost: int, audit: str) -> None:
    if best[state] is None or (cost, audit) < best[state]:
        best[state] = (cost, audit)


def closed(best: Best) -> Best:
    """The layer with up to two inserts after each state."""
    for _ in range(2):
        for state, entry in enumerate(list(best)):
            if entry:
                offer(best, spoken(state), entry[0] + INSERT, entry[1] + "I")
    return best


def advance(best: Best, initial: str, fault: str) -> Best:
    """The layer after a row."""
    after: Best = [None] * 4
    extra = TRUNCATED if fault == "truncated" else 0
    for state, entry in enumerate(best):
        if entry is None:
            continue
        cost, audit = entry
        offer(after, state, cost + DELETE, audit + "D")
        if fault in ("", "truncated"):
            to = KEEPS.get(initial, {}).get(state)
            if to is not None:
                offer(after, to, cost + extra, audit + "K")
            offer(after, spoken(state), cost + REROLE + extra, audit + "R")
    return closed(after)


def settled(best: Best) -> tuple[str, Best]:
    """The beginning that all audits share, and the layer without it; states that can't win any more are left out.

    What follows a start or system state can follow an assistant's row as well, but for a system row, which is deleted there.
    """
    done = best[ASSISTANT]
    if done:
        for state, least in ((START, done[0] + DELETE), (SYSTEM, done[0])):
            if best[state] and best[state][0] > least:
                best[state] = None
    shared = commonprefix([entry[1] for entry in best if entry])
    return shared, [entry and (entry[0], entry[1][len(shared) :]) for entry in best]


def repair_audit(rows: Sequence[tuple[str, str]]) -> tuple[int, str]:
    """Least cost and its first audit, for rows (initial of the role, fault)."""
    parts: list[str] = []
    best = closed([(0, ""), None, None, None])
    for i, (initial, fault) in enumerate(rows, 1):
        best = advance(best, initial, fault)
        if i % SETTLE == 0:
            shared, best = settled(best)
            parts.append(shared)
    cost, audit = min(best[s] for s in (START, ASSISTANT) if best[s])
    return cost, "".join(parts) + audit


def replay(rows: Sequence[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits of an audit."""
    out, state, rest = [], START, iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit != "K":
            state = spoken(state)
            role = "assistant" if state == ASSISTANT else "user"
        else:
            state = KEEPS[role[:1]][state]
        out.append((role, text))
    return out


def faults(rows: Sequence[tuple[str, str]]) -> list[str]:
    """The first fault of each row (role, text): blank, duplicate, truncated or none."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        last = row[1].rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if row in seen else "truncated" if last not in ".!?" else "")
        seen.add(row)
    return out


def repaired(rows: Sequence[tuple[int | None, str, str]]) -> dict:
    """Counts, cost, audit and messages of a conversation's rows (turn, role, text), which are in order."""
    turns = [t for t, _, _ in rows if t is not None]
    said = [(role, text) for _, role, text in rows]
    found = faults(said)
    initials = [role[:1] for role, _ in said]
    cost, audit = repair_audit(list(zip(initials, found, strict=True)))
    counts = {kind: found.count(kind) for kind in ("blank", "duplicate", "truncated")}
    gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "messages": [{"role": r, "text": t} for r, t in replay(said, audit)]}


def repair(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and messages (role, text) of each conversation.

    copies: how often a row stands at its place; with 0 it only names its conversation.
    """
    kind = conversations.schema["conv_id"].dataType
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *said, (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple[object, list]]:
            held, current, begun = [], None, False
            for batch in batches:
                for conv, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if begun and conv != current:
                        yield current, held
                        held = []
                    current, begun = conv, True
                    held.extend([(turn, role, text)] * n)
            if begun:
                yield current, held

        out, size = [], 0
        for conv, held in whole():
            row = repaired(held)
            out.append({"conv_id": conv, **row})
            size += 100 + sum(len(m["text"]) for m in row["messages"])
            if size > BATCH_CHARACTERS:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    message = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("messages", pa.list_(message))])
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, {', '.join(f'{n} long' for n in numbers)}, audit string, messages array<struct<role: string, text: string>>")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by a checksum of conv_id and turn, and how often each stands: 0 is dropped, 1 loses its text, 2 its stops, 3 is repeated, 4 becomes the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    text = F.when(F.col("damage_") == 1, "").when(F.col("damage_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("damage_"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("damage_") == 4, "user").otherwise(F.col("role"))})
    return rows, F.when(F.col("damage_") == 0, 0).when(F.col("damage_") == 3, 2).otherwise(1)


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair(*damaged(table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return fixed.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("messages")
