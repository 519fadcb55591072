"""Converters (P7): functions from text to text that workers can load, for udfs.converted, and chains of dictionaries as a column."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@cache
def _opencc(config: str):
    try:
        import opencc
    except ImportError as e:
        raise ImportError("this converter needs the opencc package; phrase_converter takes a dictionary instead") from e
    return opencc.OpenCC(config)


def opencc_converter(config: str = "s2twp") -> Callable[[str], str]:
    """Simplified to traditional characters by the dictionaries of opencc (s2t, s2tw or s2twp), loaded once in each worker."""
    if config not in ("s2t", "s2tw", "s2twp"):
        raise ValueError(f"unknown dictionaries {config}")
    return lambda text: _opencc(config).convert(text)


def phrase_converter(table: Mapping[str, str]) -> Callable[[str], str]:
    """Each longest phrase of a dictionary, from left to right, becomes what the dictionary says; all else stays."""
    if "" in table:
        raise ValueError("an empty phrase can't be converted")
    lengths = sorted({len(k) for k in table}, reverse=True)
    heads = {k[0] for k in table}

    def convert(text: str) -> str:
        out, at = [], 0
        while at < len(text):
            size = next((n for n in lengths if text[at : at + n] in table), 0) if text[at] in heads else 0
            out.append(table[text[at : at + size]] if size else text[at])
            at += size or 1
        return "".join(out)

    return convert


class Automaton:
    """Aho-Corasick automaton of a dictionary's phrases: every phrase at every place in one pass over a text."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.fail: list[int] = [0]
        #: Lengths of the phrases that end in a state, the longest first.
        self.ends: list[tuple[int, ...]] = [()]
        for phrase in phrases:
            if not phrase:
                raise ValueError("an empty phrase can't be converted")
            state = 0
            for c in phrase:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append(())
                state = self.next[state][c]
            self.ends[state] = (len(phrase),)
        level = deque(self.next[0].values())
        while level:
            state = level.popleft()
            for c, to in self.next[state].items():
                level.append(to)
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                self.ends[to] += self.ends[self.fail[to]]

    def longest_from(self, text: str) -> dict[int, int]:
        """Where phrases begin in a text, and the length of the longest one from there."""
        state, found = 0, {}
        for end, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            for n in self.ends[state]:
                found[end - n] = n  # ends come in order, so a longer one replaces a shorter
        return found

    def convert(self, text: str, table: Mapping[str, str]) -> str:
        """Each longest phrase, from left to right, becomes what the table says; all else stays."""
        out, at = [], 0
        for begin, n in sorted(self.longest_from(text).items()):
            if begin >= at:
                out += [text[at:begin], table[text[begin : begin + n]]]
                at = begin + n
        return "".join([*out, text[at:]])


def phrases_converted(text: Column | str, *tables: Mapping[str, str]) -> Column:
    """The text after each of a chain of dictionaries, whose phrases may have any length; longest phrases first, from left to right.

    The dictionaries are sent to each machine once, and each worker builds an automaton of each. A text is read once for each dictionary.
    """
    for table in tables:
        if "" in table:
            raise ValueError("an empty phrase can't be converted")
    shared = SparkSession.active().sparkContext.broadcast([dict(t) for t in tables])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chain = [(Automaton(t), t) for t in shared.value]

        def whole(value: str) -> str:
            for automaton, table in chain:
                value = automaton.convert(value, table)
            return value

        for batch in batches:
            yield batch.map(whole, na_action="ignore")

    return run(F.col(text) if isinstance(text, str) else text)
