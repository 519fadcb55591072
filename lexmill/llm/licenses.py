"""License scans by an exact set-similarity join of text blocks with license templates (operator 9, DataFrame functions only).

Blocks are overlapping windows of a text, SLACK times as many words as the template has, with line ends as separators, so that a notice
may wrap and scattered words of a long line are none. A template is found in a window that holds at least THRESHOLD of its distinct
words, and all of its own words (OWN), without which a notice is another license's: those of two licenses may share all words but one.

Tokens are ordered by the number of texts that hold them, rarest first. A window that holds `needed` of a template's words holds one of
the template's size - needed + 1 rarest (its prefix), and the rarest one that it holds comes before all others in the order. So each place
of a prefix word in a text is a candidate, of which only words that come later in the order and stand near enough count:
* length filter: texts that don't hold `needed` words of any template are left out before any place is looked at;
* positional filter: the prefix word itself and the words after it, in the order and within the window's width, must be `needed` or more.
What passes is verified by counting in each window. Words that no template has can't be shared, so texts are cut to the templates'
vocabulary as they are read and nothing but counts and candidates is shuffled.

Beside the method's labels, places of the base phrases are counted word by word. Results for odd input: null text counts as
empty (no words, no labels); null or repeated ids and rows are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, table, text_or_empty

#: Separators and words, once A-Z are lower-cased; WORD_ANY_CASE counts the same words before.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words of a window, as a multiple of the template's: what holds THRESHOLD of it may have a quarter of other words.
SLACK = 1.25
# The base phrases with their labels, and notices that licenses ask to be used.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
# Words without which a notice isn't the label's. A template needs those that it has itself.
OWN = {"mit": ("mit",), "apache": ("apache",), "gpl": ("gnu",), "lgpl": ("lesser",), "cc-by-nc": ("nc",), "cc-by-sa": ("sa",), "cc-by": ("creative", "commons"), "mpl": ("mozilla",)}


def template_tokens(text: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATOR, text.lower()) if w})


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def own_words(label: str, text: str) -> list[str]:
    return [w for w in OWN.get(label, ()) if w in template_tokens(text)]


def phrase_places(spaced: Column, phrase: str) -> tuple[Column, Column, Column, Column]:
    """Number of places, words before the first, and words before the last, of a phrase in ' w w w '; and the condition."""
    parts = F.split(spaced, f"(?<= ){phrase}(?= )")
    words = lambda part: F.length(part) - F.length(F.replace(part, F.lit(" "))) - 1
    n = F.size(parts) - 1
    before_last = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(0), lambda acc, part: acc + words(part)) + (n - 1) * len(phrase.split())
    return n, words(F.get(parts, F.lit(0))), before_last, n > 0


def base_scan(text: Column) -> Column:
    """struct(n_base, first_word, last_word, base_labels array) of a text's base phrases."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), lower_ascii(text), F.lit(" ")), SEPARATOR, " ")
    places = [(*phrase_places(spaced, p), label) for p, label in PHRASES]
    n = sum((x[0] for x in places), F.lit(0))
    first = F.array_min(F.array(*[F.when(x[3], x[1]) for x in places]))
    last = F.array_max(F.array(*[F.when(x[3], x[2]) for x in places]))
    labels = F.array_compact(F.array(*[F.when(x[3], F.lit(x[4])) for x in places]))
    found = F.struct(n.cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), labels.alias("base_labels"))
    none = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base_labels"))
    # every phrase ends in this word; the others' texts need no more than this search
    return F.when(text.rlike("(?i)license"), found).otherwise(none)


def labelled(slim: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of slim (row, doc_id, n_words, base) with the labels of hits (row, found, contained)."""
    joined = slim.select("row", "doc_id", "n_words", "base").join(hits, "row", "left")
    labels = F.array_sort(F.array_union("base.base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.size("base.base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("contained", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "base.n_base", "base.first_word", "base.last_word", F.array_sort("base.base_labels").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def window_words(text: str) -> int:
    """Words of a template's windows."""
    return math.ceil(SLACK * sum(1 for w in re.split(SEPARATOR, text.lower()) if w))


def scan_windows(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id") -> DataFrame:
    """Return doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score for every row of docs."""
    spark = docs.sparkSession
    sets = [template_tokens(t) for _, t in templates]
    vocabulary = sorted(set().union(*sets))
    known = F.array(*[F.lit(w) for w in vocabulary])
    text = text_or_empty("text")
    split = lambda t: F.split(lower_ascii(t), SEPARATOR)  # noqa: E731  may begin with an empty word, which moves all places alike
    own = [own_words(label, t) for label, t in templates]
    has = lambda words, all_of: reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in all_of], F.lit(True))
    enough = lambda words: reduce(lambda a, b: a | b, [has(words, o) & (F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in s]))) >= needed(len(s), threshold)) for s, o in zip(sets, own, strict=True)])
    # a text may begin or end with a separator, which makes an empty word there
    counted = lambda parts: F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")).cast("int")
    read = F.get(F.transform(F.array(split(text)), lambda parts: F.struct(counted(parts).cast("long").alias("n_words"), F.array_intersect(parts, known).alias("held"))), F.lit(0))
    slim = checkpointed(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("doc_id"),
            text.alias("text"),
            read.alias("read"),
        ).select(
            "row",
            "doc_id",
            "read.n_words",
            base_scan(F.col("text")).alias("base"),
            F.col("read.held").alias("held"),
            # words with their places, of texts only that hold enough of a template anywhere
            F.when(enough(F.col("read.held")), F.filter(F.transform(split(F.col("text")), lambda w, i: F.struct(i.alias("at"), w.alias("token"))), lambda s: F.array_contains(known, s["token"]))).alias("words"),
        )
    )
    counts = {r["token"]: r["count"] for r in slim.select(F.explode("held").alias("token")).groupBy("token").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    entry, widest = [], max(window_words(t) for _, t in templates)
    for (label, t), s, o in zip(templates, sets, own, strict=True):
        n, ordered = needed(len(s), threshold), sorted(s, key=rank.__getitem__)
        entry += [(label, w, len(s), ordered[at:], o, n, window_words(t)) for at, w in enumerate(ordered[: len(s) - n + 1])]
    prefix_table = spark.createDataFrame(entry, "label string, token string, size int, from_here array<string>, own array<string>, needed int, width int")
    in_prefix = F.array(*[F.lit(w) for w in sorted({e[1] for e in entry})])
    # places of prefix words, each with the words that a window can hold together with it
    near = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(in_prefix, F.get("words", i)["token"])),
        lambda i: F.struct(F.get("words", i)["at"].alias("at"), F.get("words", i)["token"].alias("token"), F.slice("words", F.greatest(i - widest + 2, F.lit(1)), widest + F.least(i + 1, F.lit(widest)) - 1).alias("span")),
    )
    places = slim.filter(F.size("words") > 0).select("row", F.explode(near).alias("place")).select("row", "place.*")
    # a window's rarest word is before its others in the order: only words from this one on count, at the template's width
    inside = lambda s: F.array_contains(F.col("from_here"), s["token"]) & (F.abs(s["at"] - F.col("at")) < F.col("width"))
    tokens = lambda span: F.array_distinct(F.transform(span, lambda s: s["token"]))
    candidates = (
        places.join(F.broadcast(prefix_table), "token")  # the templates' size is fixed
        .withColumn("span", F.filter("span", inside))
        .filter(F.size(tokens("span")) >= F.col("needed"))
    )
    in_window = lambda s: tokens(F.filter("span", lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + F.col("width"))))
    windows = F.filter(F.transform("span", in_window), lambda w: F.size(F.array_except(F.col("own"), w)) == 0)
    shared = candidates.withColumn("shared", F.array_max(F.transform(windows, lambda w: F.size(w))))
    hits = shared.filter("shared >= needed").groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("contained"))
    return labelled(slim, hits)


def op9_prefix_join_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_windows(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def oracle_op9(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """Brute force: every window of words of every text against every template, and phrase places by word lists."""
    rows = ", ".join(f"({i}, '{label}', {template_tokens(t)!r}, {own_words(label, t)!r}::VARCHAR[], {needed(len(template_tokens(t)), threshold)}, {window_words(t)})" for i, (label, t) in enumerate(templates))
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    return rf"""
WITH t(id, label, toks, own, need, width) AS (VALUES {rows}),
p(ws, label) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT row, doc_id, low, list_filter(regexp_split_to_array(low, '{SEPARATOR}'), lambda x: x <> '') AS ws FROM d),
places AS (SELECT row, p.label, i - 1 AS start FROM w, unnest(range(1, len(w.ws) + 1)) u(i), p WHERE w.low LIKE '%license%' AND w.ws[i : i + len(p.ws) - 1] = p.ws),
base AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list_distinct(list(label))) AS bl FROM places GROUP BY row),
able AS (SELECT row, ws, id, t.label, toks, own, need, width FROM w, t WHERE len(list_intersect(ws, toks)) >= need),
m AS (SELECT row, label, need, len(toks) AS size, max(len(list_intersect(ws[i : i + width - 1], toks))) AS shared FROM able, unnest(range(1, len(ws) + 1)) u(i) WHERE list_has_all(ws[i : i + width - 1], own) GROUP BY row, id, label, need, len(toks)),
hits AS (SELECT row, list_distinct(list(label)) AS found, max(shared / size::DOUBLE) AS c FROM m WHERE shared >= need GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(bl, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(found, [])))), ',') AS labels,
       CASE WHEN bl IS NOT NULL THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (row) LEFT JOIN hits USING (row)
"""
