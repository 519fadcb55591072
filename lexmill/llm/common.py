"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, checkpointed, written

__all__ = ["checkpoint_folder", "checkpointed", "few", "lower_ascii", "shuffle_partitions", "table", "text_or_empty", "word_count", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column | str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A table of at most so many rows of some 100 bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 400_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df, whose number of rows has been counted, if it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
