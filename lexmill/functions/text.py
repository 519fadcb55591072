
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 29 characters that count as white space.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Ends of lines, \r\n counting as one.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
#: The tokeniser's own range; it differs from CJK.
CJK_RUN = r"[\x{3400}-\x{9FFF}]+"
WORD = r"[a-z0-9][a-z0-9_.+-]*"
URL = r"(?i)(?:https?://|www\.)[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SENTENCE_END = r"(?<=[。！？.!?])" + SPACE + "*"
NUMBER = r"(?iU)\b\d+(?:[.,]\d+)?(?:%|億|萬|年|GB|MB|tokens?)?\b"


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.btrim(column(text), F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each worked out once for a row however often it is used below: Spark doesn't copy expressions across this."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def collapse_space(text: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(column(text), f"{SPACE}+", " "))


def is_ascii(text: Column | str) -> Column:
    return F.octet_length(column(text)) == F.length(column(text))


def normalize_ascii(text: Column | str) -> Column:
    """P2 for ASCII text, where NFKC changes nothing: spaces for white space, no other controls, no runs of spaces."""
    t = column(text)
    spaced = F.trim(F.regexp_replace(t, r"[\t-\r\x1c- ]+", " "))
    # controls are rare, and only where some go can runs of spaces come about
    return F.when(t.rlike(r"[\x00-\x08\x0e-\x1b\x7f]"), F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[\x00-\x08\x0e-\x1b\x7f]", ""), " +", " "))).otherwise(spaced)


def cjk_ratio(text: Column | str) -> Column:
    """Share of CJK characters; 0 for empty text."""
    t = column(text)
    return F.when(~is_ascii(t), F.length(F.regexp_replace(t, CJK.replace("[", "[^", 1) + "+", "")) / F.length(t)).otherwise(F.lit(0.0))


def url_ratio(text: Column | str) -> Column:
    """P5: share of characters inside urls; 0 for empty text."""
    t = column(text)
    low = F.lower(t)
    some = F.contains(low, F.lit("http")) | F.contains(low, F.lit("www."))
    inside = F.aggregate(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), F.lit(0), lambda n, u: n + F.length(u))
    return F.when(some, inside / F.length(t)).otherwise(F.lit(0.0))


def has_run(text: Column | str, longest: int) -> Column:
    """Some character stands over `longest` times in a row."""
    return column(text).rlike(rf"(?s)(.)\1{{{longest}}}")


def tokens(text: Column | str) -> Column:
    """Lower-case identifiers, and characters and pairs of characters of each CJK run; repeats stay."""
    low = F.lower(column(text))
    pairs = lambda run: F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    runs = F.transform(F.regexp_extract_all(low, F.lit(CJK_RUN), F.lit(0)), lambda run: F.concat(F.filter(F.split(run, ""), lambda c: c != ""), pairs(run)))
    return F.concat(F.regexp_extract_all(low, F.lit(f"(?iu){WORD}"), F.lit(0)), F.flatten(runs))


def content_terms(text: Column | str) -> Column:
    """P10: distinct tokens of two or more characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 2))


def sentences(text: Column | str) -> Column:
    """Pieces after each sentence mark, stripped, without empty ones."""
    return F.filter(F.transform(F.split(column(text), SENTENCE_END), strip), lambda s: s != "")


def numbers(text: Column | str) -> Column:
    """Numbers with their units."""
    return F.regexp_extract_all(column(text), F.lit(NUMBER), F.lit(0))


def lines(text: Column | str) -> Column:
    return F.split(column(text), LINE_END)


def last_index(text: Column, mark: str) -> Column:
    """0-based place of the last `mark` (one character), or -1."""
    back = F.locate(mark, F.reverse(text))
    return F.when(back > 0, F.length(text) - back).otherwise(F.lit(-1))


def truncate(text: Column | str, limit: int) -> Column:
    """At most `limit` characters, cut after the last full stop or line end if that is in the second half."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, limit)
        at = F.greatest(*[last_index(head, m) for m in "。\n."])
        return F.when(F.length(t) <= limit, t).otherwise(rstrip(F.substring(head, F.lit(1), F.when(at >= limit // 2, at + 1).otherwise(F.lit(limit)))))

    return let(strip(text), cut)


def prose(text: Column | str, limit: int) -> Column:
    """Lines without headings and list marks, joined by spaces, truncated."""
    kept = F.filter(F.transform(lines(text), strip), lambda line: (line != "") & ~F.startswith(line, F.lit("#")))
    return truncate(F.array_join(F.transform(kept, lambda line: F.regexp_replace(line, "^[- ]+", "")), " "), limit)


def topic(text: Column | str, source: Column | str) -> Column:
    """The first line that isn't empty without its marks, or the source's name, or a default."""
    headings = F.filter(F.transform(lines(text), lambda line: strip(F.regexp_replace(strip(line), "^#+", ""))), lambda h: h != "")
    name = F.regexp_extract(column(source), r"([^/]*)/*\z", 1)
    stem = F.replace(F.when(name.rlike(r"^.+\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name), F.lit("_"), F.lit(" "))
    return F.coalesce(F.substring(F.get(headings, F.lit(0)), 1, 80), F.when(stem != "", stem), F.lit("參考資料中的主題"))


def facts(text: Column | str, limit: int) -> Column:
    """Sentences of the prose, each truncated, without empty ones."""
    parts = F.split(F.translate(prose(text, 4 * limit), "！？", "。。"), "。")
    return F.filter(F.transform(F.filter(parts, lambda s: strip(s) != ""), lambda s: truncate(s, limit)), lambda s: s != "")


def strip_tags(html: Column | str) -> Column:
    """P22."""
    return F.regexp_replace(column(html), "<[^>]+>", "")


def duration(seconds: Column | str) -> Column:
    """H:MM:SS, seconds rounded half to even, not below 0."""
    s = F.greatest(F.bround(column(seconds)).cast("long"), F.lit(0))
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def grounding_prompt(references: Column | str) -> Column:
    """P20."""
    return F.concat(F.lit(GROUNDING + "\n\n參考資料：\n"), strip(references))


def chat_prompt(prompt: Column | str, system: Column | str | None = None) -> Column:
    """The role template up to the assistant's turn; the system part only if there is one."""
    head = F.lit(None).cast("string") if system is None else F.when(column(system) != "", F.concat(F.lit("<|system|>\n"), strip(system)))
    return F.concat_ws("\n", head, F.concat(F.lit("<|user|>\n"), strip(prompt)), F.lit("<|assistant|>\n"))


# Texts that records, prompts and answers are made of.
GROUNDING = "請以繁體中文回答；英文專有名詞可保留。僅根據下列參考資料回答；每個事實後以 [來源編號] 標示依據。資料不足時請明確回答不知道，不要補充未提供的事實。"
REFUSAL = "參考資料未提供這項資訊，因此不知道。"
UNSUPPORTED = "資料不足，無法根據目前來源可靠回答。"
