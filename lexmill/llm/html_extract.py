"""Main text of web pages by a conditional random field over DOM leaf blocks (operator 6).

A page is parsed into leaf blocks: runs of text that no block-level tag divides. Each has features of its ancestors (tags, words of
their class, id and role) and of its text (length, share of links, marks, words that notices and footers are written in). A linear-chain conditional random field, trained on labelled pages (page_samples.py) when a query is built, labels
the chain of a page's blocks by Viterbi; blocks with label 1 are the article.

Results for odd input: null and empty html, and pages without text, give an empty text and 0; null or repeated ids and rows are
pages like any other; a head whose end tag is missing ends where its content does; broken markup is read on as far as it goes (a tag that the page's end cuts off is dropped); an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .crf import Chain, train
from .page_samples import labelled_pages

TRAINING_PAGES = 900
# Classes of tags, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
UNSEEN = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select head".split())
#: Start tags that may stand in a head; any other ends it, as text does.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = frozenset("script style title textarea iframe".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ()}
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))",
    re.S,
)
NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*[\"']?true", re.I)
TELLING = frozenset("cookies cookie copyright rights reserved privacy terms subscribe newsletter comments comment reply advertisement sponsored sign login share javascript consent".split())

#: Marks that may stand at a word.
MARKS = ".,:;!?()"


@dataclass
class Block:
    text: str
    start: int  # where in the page its first character stands
    ancestors: tuple[str, ...]  # features of the open tags
    linked: int  # characters inside links


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of a page in page order, with character references decoded and white space made single spaces."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    active: Counter[str] = Counter()
    parts: list[str] = []
    state = {"start": 0, "linked": 0, "unseen": 0, "links": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            parent = next((f"in:{n}" for n, _ in reversed(stack) if n not in INLINE), "in:")
            found.append(Block(text, state["start"], (parent, *active), state["linked"]))
        parts.clear()
        state["linked"] = 0

    def pop(count: int) -> None:
        for _ in range(count):
            name, features = stack.pop()
            state["unseen"] -= name in UNSEEN
            state["links"] -= name == "a"
            for f in features:
                active[f] -= 1
                if not active[f]:
                    del active[f]

    def close(name: str, within: tuple[str, ...] | None = None) -> None:
        """Close the innermost open `name`; an inline one only inside its block, a sibling only inside its list."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                pop(len(stack) - i)
                return
            if stack[i][0] in within if within is not None else name in INLINE and stack[i][0] not in INLINE:
                return

    def leave_head() -> None:
        while any(n == "head" for n, _ in stack):
            close("head")

    def text_run(raw: str, at: int) -> None:
        if stack and stack[-1][0] == "head" and raw.strip():
            leave_head()
        if raw and not state["unseen"]:
            clean = html.unescape(raw) if "&" in raw else raw
            if not parts:
                state["start"] = at + len(raw) - len(raw.lstrip())
            parts.append(clean)
            if state["links"]:
                state["linked"] += len(clean)

    at = 0
    while (m := TAG.search(page, at)) is not None:
        text_run(page[at : m.start()], at)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in INLINE and name != "br" and name != "wbr":
            flush()
        if m["end"]:
            close(name)
            continue
        if name == "body" or name not in IN_HEAD and stack and stack[-1][0] == "head":
            leave_head()
        if name == "br":
            parts.append(" ") if parts else None
        if name in VOID or m["rest"].endswith("/>") and name not in INLINE and name not in UNSEEN and name in ("path", "circle", "use"):
            continue
        if name in CLOSES_PARAGRAPH:
            close("p", ("article", "section", "main", "div", "td", "li", "aside", "body", "table", "blockquote", "button"))
        if name in SIBLINGS:
            close(name, SIBLINGS[name] or ("article", "section", "main", "div", "td", "li", "body"))
        rest = m["rest"]
        features = [f"tag:{name}"]
        if len(rest) > 3:
            features += {f"name:{w}" for v in NAMING.findall(rest) for w in re.findall(r"[a-z]{2,}", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v).lower())}
            if HIDDEN.search(rest):
                features.append("hidden")
        stack.append((name, tuple(features)))
        active.update(features)
        state["unseen"] += name in UNSEEN
        state["links"] += name == "a"
        if name in RAW:  # text up to the end tag, whatever it looks like
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    rest = page[at:]
    text_run(rest, at)
    flush()
    return found


def bucket(x: float, edges: tuple[float, ...]) -> int:
    return bisect_right(edges, x)


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Feature sets of a page's blocks."""
    out, before = [], frozenset[str]()
    for b in blocks:
        words = b.text.count(" ") + 1
        # all words of the block, however long it is
        own = TELLING.intersection([w.strip(MARKS) for w in b.text.lower().split(" ")])
        out.append(
            [
                *b.ancestors,
                # what has been opened and what is left since the block before
                *(f"opened:{f}" for f in b.ancestors if f not in before and f.startswith(("tag:", "name:"))),
                *(f"left:{f}" for f in before.difference(b.ancestors) if f.startswith(("tag:", "name:"))),
                f"words:{bucket(words, (2, 4, 8, 16, 40, 100))}",
                f"linked:{bucket(b.linked / len(b.text), (0.01, 0.3, 0.8))}",
                f"end:{b.text[-1] if b.text[-1] in '.!?:' else 'a'}",
                f"marks:{bucket(sum(map(b.text.count, '.,!?')), (1, 2, 5))}",
                *(f"says:{w}" for w in own),
                f"telling:{bucket(len(own) / words, (0.004, 0.02, 0.1))}",
                *(["sign:©"] if "©" in b.text else []),
            ]
        )
        before = frozenset(b.ancestors)
    return out


def training_sequences(pages: int = TRAINING_PAGES, seed: int = 3) -> list[tuple[list[list[str]], list[int]]]:
    out = []
    for pieces in labelled_pages(pages, seed):
        head = "<!DOCTYPE html><html><head><title>x</title></head><body>"
        starts, at = [], len(head)
        for piece, _ in pieces:
            starts.append(at)
            at += len(piece)
        blocks = leaf_blocks(head + "".join(p for p, _ in pieces) + "</body></html>")
        labels = [pieces[bisect_right(starts, b.start) - 1][1] or 0 for b in blocks]
        if blocks:
            out.append((features_of(blocks), labels))
    return out


_trained: dict[int, Chain] = {}


def extractor(pages: int = TRAINING_PAGES) -> Chain:
    """The chain trained on the labelled pages; trained once in a process, always the same."""
    if pages not in _trained:
        _trained[pages] = train(training_sequences(pages))
    return _trained[pages]


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "")
    labels = chain.decode([chain.unary(f) for f in features_of(blocks)])
    return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, chain: Chain | None = None, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Return the columns in keep, text and n_chars for every row of pages."""
    model = pages.sparkSession.sparkContext.broadcast(chain or extractor())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, model.value) for p in batch], dtype=object)

    found = pages.select(*keep, run(F.col(html_column)).alias("text"))
    return found.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))


def op6_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
