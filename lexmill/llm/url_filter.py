r"""URL filters by link-graph propagation (operator 3, DataFrame functions only).

Rules (host/path, allow or block) decide the urls that they fit; of several the longest does. The other urls are judged by
their host. A host with more allowed than blocked pages is a trusted seed, one with at least half of its pages blocked a
blocked seed. Trust follows the links between hosts (personalised PageRank from the trusted seeds), distrust follows them
backwards (whoever links to a blocked host shares in it). Scores are in units of a seed without links: score = seed + DAMPING *
what arrives. A host is blocked if its distrust is at least BLOCK_FROM and above its trust.

Only what a round has added moves on in the next, and rounds go on until all of it together is under TOLERANCE. A round passes on at most
DAMPING of what it gets, so no score of any host can rise by DAMPING / (1 - DAMPING) * TOLERANCE more: far below the digits that scores are
rounded to before they are compared. There is no bound on the number of rounds: it grows with the logarithm of the number of seeds.

Links are counted by pair of hosts before they move, so a hub costs a row for each neighbour; a hub of over HUB neighbours is
divided in parts, each of which meets its score by itself; messages to a host are added up before the shuffle; each round is checkpointed.

Results for odd input: a null url, or one without ://, has empty host and path and no rule (verdict allow unless its empty host
is judged otherwise); null html has no links; null or repeated ids and rows are judged like any other; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, few, lower_ascii, table

# The rules asked for.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
DAMPING = 0.85
#: Sum over all hosts of what a round adds, below which no more rounds follow; and digits of a score.
TOLERANCE = 1e-9
DIGITS = 6
#: Neighbours of a host that one part of it has.
HUB = 20_000
#: Rounds between two looks at what they add.
FOLD = 8
BLOCK_FROM = 0.1
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""[^A-Za-z0-9_][hH][rR][eE][fF][\t\n\f\r ]*=[\t\n\f\r ]*["']?[\t\n\f\r ]*((?:[hH][tT][tT][pP][sS]?:)?//[^"'\t\n\f\r <>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)


def longest_rule(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits host and path (of equally long ones the first by code point), or null."""
    ordered = sorted((r for r, _ in rules), key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in ordered], F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    absolute = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    pairs = links.select("source", host_of(absolute).alias("target")).filter("source <> target AND source <> '' AND target <> ''")
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def moving(links: DataFrame, sender: str, receiver: str, way: str, damping: float, hub: int) -> tuple[DataFrame, DataFrame]:
    """The ways (host, part, to, share) on which scores leave each sender, and the hubs (host, parts)."""
    sent = checkpointed(links.groupBy(sender).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("neighbours")))
    hubs = checkpointed(sent.filter(F.col("neighbours") > hub).select(F.col(sender).alias("host"), F.ceil(F.col("neighbours") / hub).cast("int").alias("parts")))
    wide = links.select(F.col(sender).alias("host"), F.col(receiver).alias("to"), "n").join(few(hubs, hubs.count()), "host", "left")
    placed = wide.select("host", F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "to", "n")
    totals = in_parts(sent.select(F.col(sender).alias("host"), "all"), few(hubs, hubs.count()))
    ways = placed.join(totals, ["host", "part"]).select("host", "part", "to", (F.lit(damping) * F.col("n") / F.col("all")).alias("share"), F.lit(way).alias("way"))
    return ways, hubs.withColumn("way", F.lit(way))


def in_parts(rows: DataFrame, hubs: DataFrame, on: Sequence[str] = ("host",)) -> DataFrame:
    """rows with a part: one row for each part of a hub, part 0 of any other host."""
    joined = rows.join(hubs, list(on), "left")
    return joined.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def propagate(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, hub: int = HUB) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches, from links (source, target, n) and seeds (host, trusted, blocked)."""
    start = checkpointed(seeds.select("host", F.inline(F.array(F.struct(F.lit("along").alias("way"), F.col("trusted").cast("double").alias("score")), F.struct(F.lit("back").alias("way"), F.col("blocked").cast("double").alias("score"))))).filter("score > 0"))
    links = checkpointed(links)
    total, added = start, start
    if not (links.isEmpty() or start.isEmpty()):
        along, hubs_along = moving(links, "source", "target", "along", damping, hub)
        back, hubs_back = moving(links, "target", "source", "back", damping, hub)
        ways, hubs = checkpointed(along.unionByName(back)), checkpointed(hubs_along.unionByName(hubs_back))
        n = hubs.count()
        placed = (lambda df: in_parts(df, few(hubs, n), ("host", "way"))) if n else (lambda df: df.withColumn("part", F.lit(0)))
        while True:
            for _ in range(FOLD):
                sent = ways.join(placed(added), ["host", "way", "part"]).select(F.col("to").alias("host"), "way", (F.col("share") * F.col("score")).alias("score"))
                added = checkpointed(sent.groupBy("host", "way").agg(F.sum("score").alias("score")))
                total = total.unionByName(added)
            if (added.agg(F.sum("score")).first()[0] or 0.0) < tolerance:
                break
            total = checkpointed(total.groupBy("host", "way").agg(F.sum("score").alias("score")))
    score = lambda way: F.round(F.coalesce(F.sum(F.when(F.col("way") == way, F.col("score"))), F.lit(0.0)), DIGITS)
    return total.groupBy("host").agg(score("along").alias("trust"), score("back").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, block_from: float = BLOCK_FROM, id_column: str = "page_id") -> DataFrame:
    """Return page_id, host, path, rule, verdict, trust and distrust for every row of pages."""
    kinds = F.create_map(*[F.lit(x) for r in rules for x in r])
    ruled = pages.select(F.col(id_column).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", longest_rule(rules))
    ruled = ruled.withColumn("by_rule", kinds[F.col("rule")])
    counts = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    seeds = counts.select("host", (F.col("allowed") > F.col("blocked")).cast("int").alias("trusted"), ((2 * F.col("blocked") >= F.col("n")) & (F.col("blocked") > F.col("allowed"))).cast("int").alias("blocked"))
    scores = checkpointed(propagate(host_links(pages), checkpointed(seeds)))
    found = ruled.join(few(scores, scores.count()), "host", "left").fillna(0.0, ["trust", "distrust"])
    by_host = F.when((F.col("distrust") >= block_from) & (F.col("distrust") > F.col("trust")), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")


def op3_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle_op3(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The longest of all rules that fit, and what each round adds by recursion; 400 rounds leave less than TOLERANCE of any number of seeds."""
    values = ", ".join("('{0}', '{1}', '{2}', '/{3}')".format(r, kind, *r.split("/", 1)) for r, kind in rules)
    host = lambda url: f"translate(coalesce(regexp_extract({url}, '{URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE rules(rule, kind, rule_host, rule_path) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS row, page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
f AS (SELECT row, rule, kind FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC, rule) = 1),
j AS (SELECT u.row, page_id, host, path, rule, kind FROM u LEFT JOIN f ON u.row = f.row),
c AS (SELECT host, count(*) AS n, count_if(kind = 'allow') AS a, count_if(kind = 'block') AS b FROM j GROUP BY host),
seeds AS (SELECT host, 'along' AS way, 1.0::DOUBLE AS score FROM c WHERE a > b UNION ALL SELECT host, 'back', 1.0::DOUBLE FROM c WHERE 2 * b >= n AND b > a),
raw AS (SELECT host AS source, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM u),
pairs AS (SELECT source, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS target FROM raw),
l AS (SELECT source, target, count(*) AS n FROM pairs WHERE source <> target AND source <> '' AND target <> '' GROUP BY ALL),
ways AS (SELECT source AS host, target AS goal, 'along' AS way, {DAMPING} * n / sum(n) OVER (PARTITION BY source) AS share FROM l
         UNION ALL SELECT target, source, 'back', {DAMPING} * n / sum(n) OVER (PARTITION BY target) FROM l),
r(host, way, score, i) AS (SELECT host, way, score, 0 FROM seeds
  UNION ALL SELECT goal, way, sum(share * score)::DOUBLE, any_value(i) + 1 FROM r JOIN ways USING (host, way) WHERE i < 400 GROUP BY goal, way),
s AS (SELECT host, round(coalesce(sum(score) FILTER (way = 'along'), 0.0), {DIGITS}) AS trust, round(coalesce(sum(score) FILTER (way = 'back'), 0.0), {DIGITS}) AS distrust FROM r GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(kind, CASE WHEN distrust >= {BLOCK_FROM} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM j LEFT JOIN s ON j.host = s.host
"""
