"""Mixing sources to target weights by weighted fair queueing (operator 10, DataFrame functions only).

Each source sends its shuffled documents in turn, again and again for at most `max_epochs` rounds. A copy's virtual finish
time is the number of words its source has sent by then, divided by the source's weight. All copies are range-sorted by finish
time and the sorted sequence is cut where its words reach the total budget.

A source, or one repeated row, may hold any share of the rows: rows are range-sorted by source, place in the shuffle and row number, and
a running total is that of the ranges before plus that inside the range, so no task sees a whole source or all copies of a row; the
budget cut needs the running total of one range only.

Results for odd input: null text counts 0 words, null source is a source of its own (last in order), null and repeated doc_ids
are rows like any other (equal rows follow each other, and each has a finish time of its own), an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, few, shuffle_partitions, table, word_count

#: Ranges for each shuffle partition, so that partitions which get ranges by hash are near equal.
RANGES = 2
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add weight and target to (skey, source, source_size).

    A target is weight times the common level, but at most max_epochs times the source's size; the level is such that the
    targets add up to the total size. Sorted by the level at which they reach their limit, the sources before the k-th are at
    their limit, and the level that the rest shares is right for the first k that it doesn't bring beyond its own limit.
    """
    order = Window.orderBy("skey")
    full = Window.orderBy("full_at", "skey")
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("limit").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy(F.lit(1))))
        .withColumn("level_k", (F.col("budget") - F.col("before")) / F.col("sharing"))
        .withColumn("level", F.max(F.when(F.col("level_k") <= F.col("full_at"), F.col("level_k"))).over(Window.partitionBy(F.lit(1))))
        .withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("limit").cast("double")))
        .select("skey", "source", "source_size", "weight", "target", "budget")
    )


def keyed(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Add skey (orders sources by code point, null last) and place (a document's key in its source's shuffle)."""
    return docs.select(
        "*",
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("skey"),
        F.md5(F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.col("text"))).alias("place"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_column: str = "doc_id") -> DataFrame:
    """Return doc_id, source, size, source_size, target, copies, taken, skey and place for every row of docs."""
    # written once, so that a row keeps its number
    slim = checkpointed(
        keyed(docs.select(F.col(id_column).alias("doc_id"), "source", "text")).select("doc_id", "source", "skey", "place", word_count("text").alias("size")).withColumn("row", F.monotonically_increasing_id())
    )
    sizes = slim.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ranged = checkpointed(slim.repartitionByRange(RANGES * shuffle_partitions(docs.sparkSession), "skey", "place", "row").withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range, and one more for each source
    bases = ranged.groupBy("skey", "range").agg(F.sum("size").alias("range_size")).select("skey", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("range", "skey").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = checkpointed(
        ranged.withColumn("sent", inside)
        .join(bases, ["range", "skey"])
        .join(targets(sizes, weights, max_epochs).drop("source"), "skey")
        .select("doc_id", "source", "skey", "place", "row", "size", "source_size", "weight", "target", "budget", (F.col("base") + F.col("sent")).alias("sent"))
    )
    copies = (
        rows.filter("size > 0 AND target > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
        .select(finish(F.col("epoch")).alias("finish"), "skey", "epoch", "place", "row", "size", "budget")
    )
    cut = last_within_budget(copies)
    if cut is None:
        return rows.select("doc_id", "source", "size", "source_size", "target", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"), "skey", "place")
    at = F.struct(*[F.lit(cut[c]).alias(c) for c in ORDER])
    sent_copies = sum((F.when(F.struct(finish(F.lit(e)).alias("finish"), "skey", F.lit(e).alias("epoch"), "place", "row") <= at, 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    n = F.when((F.col("size") > 0) & (F.col("target") > 0), sent_copies).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"), "skey", "place")


#: The order of copies: by finish time, and a fixed order among equal ones.
ORDER = ("finish", "skey", "epoch", "place", "row")


def finish(epoch: Column) -> Column:
    """Virtual finish time of a copy: words sent by its source until then, divided by the weight."""
    return (F.col("sent") + epoch * F.col("source_size")) / F.col("weight")


def last_within_budget(copies: DataFrame):
    """The last copy, in order of finish time, up to which the words of all copies stay within the budget; None: no such copy.

    The copies are range-sorted; the totals of the ranges name the one range in which the budget ends, and only that range
    is added up row by row.
    """
    order = list(ORDER)
    ranged = checkpointed(copies.repartitionByRange(shuffle_partitions(copies.sparkSession), *order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.sum("size").alias("range_size"), F.max("budget").alias("budget"))
    starts = totals.withColumn("start", F.coalesce(F.sum("range_size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = starts.filter("start <= budget").orderBy(F.desc("range")).first()  # one row
    if last is None:
        return None
    here = Window.orderBy(*order)
    inside = ranged.filter(F.col("range") == last["range"]).withColumn("total", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(last["start"]))
    found = inside.filter(F.col("total") <= last["budget"]).orderBy(*[F.desc(c) for c in order]).first()
    if found is None:  # the budget ends with the range before
        found = ranged.filter(F.col("range") < last["range"]).orderBy(*[F.desc(c) for c in order]).first()
    return found


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the columns of docs.

    Rows equal in doc_id, text and source share what the mix takes of them as evenly as can be.
    """
    plan = checkpointed(mix(docs, weights, max_epochs).groupBy("skey", "place").agg(F.sum("copies").alias("copies_"), F.count(F.lit(1)).alias("rows_")))
    rows = keyed(docs.select(F.struct("*").alias("row_"), "doc_id", "source", "text")).select("row_", "skey", "place")
    repeated = plan.filter("rows_ > 1")
    n, columns = repeated.count(), [F.col(f"row_.{c}") for c in docs.columns]
    single = rows if not n else rows.join(few(repeated.select("skey", "place"), n), ["skey", "place"], "left_anti")
    taken = single.join(plan.filter("rows_ = 1 AND copies_ > 0").select("skey", "place", "copies_"), ["skey", "place"])
    if n:
        # equal rows are numbered by the part of the table that they were read from, so that no task sees all of them
        many = checkpointed(rows.withColumn("id_", F.monotonically_increasing_id()).join(few(repeated.filter("copies_ > 0"), n), ["skey", "place"]).withColumn("part_", F.shiftright("id_", 33)))
        parts = many.groupBy("skey", "place", "part_").count()
        earlier = Window.partitionBy("skey", "place").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("skey", "place", "part_", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base_"))
        number = F.row_number().over(Window.partitionBy("skey", "place", "part_").orderBy("id_")) + F.col("base_")
        share = (F.floor(F.col("copies_") / F.col("rows_")) + F.when(number <= F.col("copies_") % F.col("rows_"), 1).otherwise(0)).cast("int")
        numbered = many.join(parts, ["skey", "place", "part_"]).select("skey", "place", "row_", share.alias("copies_"))
        taken = taken.unionByName(numbered.filter("copies_ > 0"))
    return taken.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_").cast("long")))).select(*columns)


def op10_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), text)) AS place, row_number() OVER () AS row
  FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS weight, 3 * source_size AS lim,
              sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, lim / weight AS full_at FROM s1),
s3 AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY full_at, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (ORDER BY full_at, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_k FROM s2),
s4 AS (SELECT *, max(CASE WHEN level_k <= full_at THEN level_k END) OVER () AS lvl FROM s3),
t AS (SELECT skey, source_size, weight, budget::BIGINT AS budget, least(weight * lvl, lim::DOUBLE) AS target FROM s4),
r AS (SELECT d.*, source_size, weight, budget, target,
             (sum(size) OVER (PARTITION BY skey ORDER BY place, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS sent
      FROM d JOIN t USING (skey)),
c AS (SELECT r.*, epoch, (sent + epoch * source_size)::DOUBLE / weight AS finish
      FROM r, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0 AND target > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, epoch, place, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c),
cut AS (SELECT finish, skey, epoch, place, row FROM q WHERE total <= budget ORDER BY total DESC LIMIT 1),
n AS (SELECT c.row, count(*) AS copies FROM c, cut
      WHERE (c.finish, c.skey, c.epoch, c.place, c.row) <= (cut.finish, cut.skey, cut.epoch, cut.place, cut.row) GROUP BY c.row)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken
FROM r LEFT JOIN n USING (row)
"""
