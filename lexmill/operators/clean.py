"""Cleaning: normalise, reject, keep the first of equal texts, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cjk_ratio, has_run, url_ratio
from ..functions.udfs import normalize
from ..session import checkpointed


@dataclass(frozen=True)
class CleanOptions:
    min_chars: int = 20
    max_chars: int = 20000
    min_cjk_ratio: float = 0.15
    max_url_ratio: float = 0.30
    max_repeated_char: int = 16
    dedupe: bool = True

    def __post_init__(self) -> None:
        if self.min_chars <= 0 or self.max_chars < self.min_chars:
            raise ValueError("min_chars must be positive and max_chars at least min_chars")
        if not (0 <= self.min_cjk_ratio <= 1 and 0 <= self.max_url_ratio <= 1):
            raise ValueError("ratios must be from 0 to 1")
        if self.max_repeated_char < 2:
            raise ValueError("max_repeated_char must be at least 2")


def reject_reason(text: str, options: CleanOptions) -> Column:
    """the first rule that a text breaks, or null."""
    t = F.col(text)
    return (
        F.when(F.length(t) < options.min_chars, "too_short")
        .when(F.length(t) > options.max_chars, "too_long")
        .when(cjk_ratio(t) < options.min_cjk_ratio, "not_chinese_enough")
        .when(url_ratio(t) > options.max_url_ratio, "url_heavy")
        .when(has_run(t, options.max_repeated_char), "repeated_characters")
    )


def first_of_equal(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A3: of the rows with equal key, the first in order stays, whole and once; rows equal in key and order are told apart by their
    place in the table. Null keys are equal, and a null in the order comes last.

    The first row of each key is found before the shuffle in each task, so a key that a third of all rows share moves a row for each task.
    """
    rows = docs.select(F.struct("*").alias("row_"), F.col(key).alias("key_"), F.monotonically_increasing_id().alias("number_"))
    first = F.min_by("row_", F.struct(*[F.struct(F.col("row_")[c].isNull(), F.col("row_")[c]) for c in order], "number_"))
    return rows.groupBy("key_").agg(first.alias("row_")).select(*[F.col("row_")[c].alias(c) for c in docs.columns])


def judged(docs: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:
    """docs with text normalised, digest and reason_ (of rejection, or null). Null texts are left out."""
    read = docs.filter(F.col("text").isNotNull()).withColumn("text", normalize("text"))
    return read.withColumn("reason_", reject_reason("text", options)).withColumn("digest", F.sha2("text", 256))


def outcomes(docs: DataFrame, options: CleanOptions = CleanOptions(), order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of docs without their texts, with digest, n_chars and outcome (a reject reason, duplicate or accepted).

    Texts are judged once, and what is left of them is written before it is used twice. Of equal texts the first in order is accepted, a null
    in the order being last; rows equal in that too are told apart by their number.
    """
    slim = judged(docs, options).withColumn("n_chars", F.length("text")).drop("text")
    if not options.dedupe:
        return slim.withColumn("outcome", F.coalesce("reason_", F.lit("accepted"))).drop("reason_")
    slim = checkpointed(slim.withColumn("row_", F.monotonically_increasing_id()))
    least = F.min(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order], F.col("row_").alias("first_row_")))
    firsts = slim.filter("reason_ IS NULL").groupBy("digest").agg(least.alias("first_")).select(F.col("first_.first_row_").alias("row_"), F.lit(True).alias("wins_"))
    outcome = F.coalesce("reason_", F.when(F.col("wins_"), "accepted").otherwise("duplicate"))
    return slim.join(firsts, "row_", "left").withColumn("outcome", outcome).drop("row_", "reason_", "wins_")


def clean_corpus(docs: DataFrame, options: CleanOptions = CleanOptions(), order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The accepted rows, with their normalised texts and digest."""
    read = judged(docs, options)
    if not options.dedupe:
        return read.filter("reason_ IS NULL").drop("reason_")
    # a filter on the reason would be pushed down and repeat the normalisation in each of its terms: rejected rows are one group
    first = first_of_equal(read.withColumn("key_text_", F.when(F.col("reason_").isNull(), F.col("digest"))), "key_text_", list(order))
    return first.filter("key_text_ IS NOT NULL").drop("reason_", "key_text_")


def report(judged: DataFrame) -> DataFrame:
    """A1, A2: one row with counts (of outcomes that occur, sorted), accepted_characters and average_accepted_characters."""
    accepted = F.col("outcome") == "accepted"
    sums = judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(accepted, F.col("n_chars")).otherwise(0)).alias("chars"))
    name = F.when(accepted, "accepted_documents").otherwise(F.col("outcome"))
    all_counts = F.array_append(F.collect_list(F.struct(name.alias("name"), F.col("n"))), F.struct(F.lit("input_documents").alias("name"), F.sum("n").alias("n")))
    taken = F.sum(F.when(accepted, F.col("n")))
    return sums.agg(
        F.map_from_entries(F.array_sort(all_counts)).alias("counts"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("accepted_characters"),
        F.coalesce(F.sum("chars") / taken, F.lit(0.0)).alias("average_accepted_characters"),
    )
