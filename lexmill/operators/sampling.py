"""Windows of token streams, weighted choice, epochs and the sampling filter."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def uniform(seed: int, *keys: str) -> Column:
    """A number from 0 to under 1 that depends on nothing but the seed and the keys: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def packed_windows(rows: DataFrame, length: int, tokens: str = "tokens", stride: int | None = None) -> DataFrame:
    """Inputs and next-token targets at every stride of each row's tokens (G5 with fixed starts); rows not longer than length + 1 give none."""
    if length <= 0:
        raise ValueError("length must be positive")
    step = stride or length
    last = F.size(tokens) - length - 1
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1, F.lit(step)))
    cut = rows.withColumn("start", F.explode(starts))
    return cut.withColumns({"x": F.slice(tokens, F.col("start") + 1, length), "y": F.slice(tokens, F.col("start") + 2, length)})


def random_windows(rows: DataFrame, length: int, per_row: int, seed: int, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Windows with starts that are uniform and depend on nothing but seed, row key and draw."""
    last = F.size(tokens) - length - 1
    draw = uniform(seed, key, "draw")
    drawn = rows.filter(last > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    placed = drawn.withColumn("start", F.floor(draw * last).cast("int"))
    return placed.withColumns({"x": F.slice(tokens, F.col("start") + 1, length), "y": F.slice(tokens, F.col("start") + 2, length)})


def weighted_choice(draws: DataFrame, weights: Sequence[float], seed: int, key: str = "draw") -> DataFrame:
    """A source for each draw, by weight; depends on seed and key only."""
    total = sum(weights)
    u = uniform(seed, key)
    choice: Column = F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        choice = F.when(u < sum(weights[: i + 1]) / total, F.lit(i)).otherwise(choice)
    return draws.withColumn("source_idx", choice)


def epoch_batches(rows: DataFrame, batch: int, epoch: int, seed: int, key: str = "doc_id") -> DataFrame:
    """The rows of an epoch in shuffled order as numbered batches, by a range sort on a hash of key, seed and epoch."""
    shuffled = rows.withColumn("order_", F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key).cast("string"))))
    ranged = shuffled.repartitionByRange("order_", key).sortWithinPartitions("order_", key).withColumn("number_", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("range_", F.shiftright("number_", 33)))
    counts = ranged.groupBy("range_").count().withColumn("start_", F.sum("count").over(Window.orderBy("range_")) - F.col("count")).drop("count")
    place = F.col("start_") + F.col("number_").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(counts), "range_").withColumn("batch", F.floor(place / batch)).drop("order_", "number_", "range_", "start_")


def numbered(rows: DataFrame, order: Sequence[str], number: str = "row") -> DataFrame:
    """rows with gapless numbers from 0 in an order; written once, so that epochs needn't sort."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number_", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("range_", F.shiftright("number_", 33)))
    counts = ranged.groupBy("range_").count().withColumn("start_", F.sum("count").over(Window.orderBy("range_")) - F.col("count")).drop("count")
    placed = ranged.join(F.broadcast(counts), "range_")  # one row a range
    return checkpointed(placed.withColumn(number, F.col("start_") + F.col("number_").bitwiseAND((1 << 33) - 1)).drop("number_", "range_", "start_"))


#: Rounds of the keyed permutation.
SHUFFLE_ROUNDS = 64


def permuted(number: Column | str, n: int, epoch: int, seed: int, back: bool = False, rounds: int = SHUFFLE_ROUNDS) -> Column:
    """The place of a number in a permutation of 0 to n - 1 that seed and epoch key; with back, the number at a place.

    Swap-or-not shuffle (Hoang, Morris and Rogaway 2012): in each round a number and its partner, key - number modulo n, change places or not,
    as a hash of the larger one says. Each round undoes itself, so the way back takes the rounds in reverse.
    """
    place = F.col(number) if isinstance(number, str) else number
    if n <= 0:
        return place
    name = f"{seed}:{epoch}"
    keys = [int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:13], 16) % n for i in range(rounds)]
    each = [F.struct(F.lit(k).cast("long").alias("key"), F.lit(f"{name}:{i}:").alias("name")) for i, k in enumerate(keys)]

    def swapped(x: Column, r: Column) -> Column:
        partner = F.pmod(r["key"] - x, F.lit(n).cast("long"))
        return F.when(F.substring(F.md5(F.concat(r["name"], F.greatest(x, partner).cast("string"))), 1, 1) < "8", partner).otherwise(x)

    return F.aggregate(F.array(*(each[::-1] if back else each)), place.cast("long"), swapped)


def permuted_epoch(rows: DataFrame, n: int, batch: int, epoch: int, seed: int, number: str = "row") -> DataFrame:
    """G8 for numbered rows: place and batch of each row in an epoch. Nothing is moved or sorted, and no state is kept between epochs."""
    return rows.withColumn("place", permuted(number, n, epoch, seed)).withColumn("batch", F.floor(F.col("place") / batch))


def epoch_batch(rows: DataFrame, n: int, batch: int, wanted: int, epoch: int, seed: int, number: str = "row") -> DataFrame:
    """The rows of one batch of an epoch, with place: their numbers are worked out backwards and reach the scan as literals, so training can go on
    anywhere in an epoch."""
    places = range(wanted * batch, min((wanted + 1) * batch, n))
    if not places:
        return rows.limit(0).withColumn("place", F.lit(0).cast("long"))
    spark = rows.sparkSession
    numbers = {r["number"]: r["id"] for r in spark.range(places.start, places.stop).withColumn("number", permuted("id", n, epoch, seed, back=True)).collect()}
    return rows.filter(F.col(number).isin(sorted(numbers))).withColumn("place", permuted(number, n, epoch, seed))


def sampling_filter(rows: DataFrame, key: str = "vec_id", logits: str = "embedding", temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0, history: Column | None = None, penalty: float = 1.0) -> DataFrame:
    """(key, token, p) of the tokens that stay: temperature, repetition penalty, top k with ties, nucleus. A row's logits are one group by nature."""
    if penalty < 1.0:
        raise ValueError("penalty must be at least 1")
    each = rows.select(key, *([history.alias("history")] if history is not None else []), F.posexplode(logits).alias("token", "logit"))
    each = each.withColumn("logit", F.col("logit").cast("double") / temperature)
    if history is not None and penalty > 1.0:
        seen = F.array_contains("history", F.col("token"))
        each = each.withColumn("logit", F.when(seen, F.when(F.col("logit") < 0, F.col("logit") * penalty).otherwise(F.col("logit") / penalty)).otherwise(F.col("logit"))).drop("history")
    by = Window.partitionBy(key)
    if top_k:
        each = each.withColumn("rank_", F.rank().over(by.orderBy(F.desc("logit")))).filter(F.col("rank_") <= top_k).drop("rank_")
    soft = lambda df: df.withColumn("e_", F.exp(F.col("logit") - F.max("logit").over(by))).withColumn("p", F.col("e_") / F.sum("e_").over(by)).drop("e_")
    each = soft(each)
    if top_p < 1.0:
        before = F.coalesce(F.sum("p").over(by.orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        each = soft(each.withColumn("before_", before).filter(F.round("before_", 12) < top_p).drop("before_", "p"))
    return each.select(key, "token", F.round("p", 9).alias("p"))


def drawn_tokens(kept: DataFrame, seed: int, key: str = "vec_id") -> DataFrame:
    """One token for each key, drawn by the probabilities that sampling_filter leaves; depends on seed and key only."""
    by = Window.partitionBy(key)
    summed = kept.withColumns({"until_": F.sum("p").over(by.orderBy("token")), "all_": F.sum("p").over(by)})
    return summed.filter(F.col("until_") > uniform(seed, key) * F.col("all_")).groupBy(key).agg(F.min("token").alias("token"))
