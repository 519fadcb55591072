"""Benchmark decontamination by greedy string tiling (operator 1).

Words are runs of letters and digits with A-Z lower-cased. Seeds are the Karp-Rabin hashes of SEED successive words of a
benchmark item (of all its words if it has fewer); a text is joined with the items whose seeds it holds. Seeds that follow
each other in text and item make maximal matches. Tiling marks the longest match, cuts what it covers off the other matches,
puts back what is left of them if it is at least a seed long, and goes on with the longest, until none is left. No word of text or item is
marked twice, and the order of passages doesn't matter. An item leaks into a text if tiles cover at least COVERAGE of its words.

A benchmark of at most BLOCK_WORDS words (they are counted first) is broadcast, and each text is tiled where it is read. A larger one is
never gathered: its seeds meet those of the texts in a shuffled join, from which a Bloom filter of fixed size keeps the seeds that no
item has; shared seeds are added up by text and item, and only pairs that could reach the coverage are tiled. A seed that stands in many
places costs a number of matches, not all its pairs of places: a match is found at its first word only.

Results for odd input: null and empty texts hold nothing; null items and items without words leak nowhere; null or repeated ids
and rows are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, few, table
from .gru import words_of

SEED = 5
COVERAGE = 0.5
#: Most words of a benchmark that is broadcast: a few tens of MB.
BLOCK_WORDS = 500_000
#: Pairs of places of shared seeds that are looked at together.
PLACES = 1 << 20
#: Bits of the Bloom filter of a large benchmark's seeds, as a power of 2: 16 MB, whatever the benchmark's size.
BLOOM = 27
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each run of `length` ids."""
    n = max(0, len(ids) - length + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out = out * _BASE + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return out


@dataclass
class Seeds:
    """All seeds of one length: sorted hashes, and the item and place of each."""

    length: int
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray


@dataclass
class Benchmark:
    item_ids: list[int | None]
    words: list[np.ndarray]
    flat: np.ndarray  # the words of all items, one after another
    starts: np.ndarray  # where each item starts in it
    sizes: np.ndarray
    vocabulary: dict[bytes, int]
    seeds: list[Seeds]

    @staticmethod
    def of(items: list[tuple[int | None, list[bytes]]]) -> Benchmark:
        vocabulary: dict[bytes, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], dtype=np.int64) for _, ws in items]
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(min(SEED, len(w)), []).append(i)
        seeds = []
        for length, own in sorted(by_length.items()):
            hashes = [window_hashes(words[i], length) for i in own]
            item = np.repeat(own, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            seeds.append(Seeds(length, flat[order], item[order], place[order]))
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        return Benchmark([i for i, _ in items], words, np.concatenate([*words, np.zeros(0, dtype=np.int64)]), np.cumsum(sizes) - sizes, sizes, vocabulary, seeds)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts (-1: no item has it), one -1 before, between and after texts, and where each text starts."""
        known = _Vocabulary(self.vocabulary)
        lists = [words_of(t) for t in texts]
        parts = [np.fromiter(map(known.__getitem__, x), dtype=np.int64, count=len(x)) for x in lists]
        gap = np.array([-1], dtype=np.int64)
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        return np.concatenate([gap, *(x for p in parts for x in (p, gap))]), np.cumsum(sizes) - sizes + 1

    def matches(self, ids: np.ndarray) -> np.ndarray:
        """(place in ids, item, place in item, words) of all maximal matches of at least a seed."""
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        found = []
        for seeds in self.seeds:
            k = seeds.length
            free = np.flatnonzero(unknown[k:] == unknown[: max(0, len(unknown) - k)])
            hashes = np.zeros(len(free), dtype=np.uint64)
            for i in range(k):
                hashes = hashes * _BASE + ids[free + i].astype(np.uint64) + np.uint64(1)
            low = np.searchsorted(seeds.hashes, hashes, side="left")
            count = np.searchsorted(seeds.hashes, hashes, side="right") - low
            held = np.flatnonzero(count)
            cuts = np.searchsorted(np.cumsum(count[held]), np.arange(PLACES, int(count.sum()) + PLACES, PLACES), side="right")
            for part in np.split(held, np.unique(cuts)):
                n = count[part]
                at = np.repeat(free[part], n)
                seed = np.repeat(low[part], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                item, place = seeds.item[seed], seeds.place[seed]
                g = self.starts[item] + place
                # of the places of a match, only its first; equal hashes of different words are none
                new = np.flatnonzero((place == 0) | (ids[at - 1] != self.flat[g - 1]))
                new = new[(ids[at[new, None] + np.arange(k)] == self.flat[g[new, None] + np.arange(k)]).all(axis=1)]
                at, item, place, g = at[new], item[new], place[new], g[new]
                size, grows = np.full(len(at), k), np.arange(len(at))
                while len(grows := grows[place[grows] + size[grows] < self.sizes[item[grows]]]):
                    grows = grows[ids[at[grows] + size[grows]] == self.flat[g[grows] + size[grows]]]
                    size[grows] += 1
                found.append(np.stack([at, item, place, size], axis=1))
        return np.concatenate([*found, np.zeros((0, 4), dtype=np.int64)])

    def leaks(self, texts: list[str | None], coverage: float) -> list[list[tuple[int, int, int]]]:
        """For each text: (item, covered words, tiles) of the items that leak into it."""
        ids, starts = self.ids(texts)
        found = self.matches(ids)
        text = np.searchsorted(starts, found[:, 0], side="right") - 1
        order = np.lexsort((found[:, 1], text))
        found, text = found[order], text[order]
        edges = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (found[1:, 1] != found[:-1, 1]), [True]])) if len(found) else [0]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, b in zip(edges, edges[1:], strict=False):
            own, item = found[a:b], int(found[a, 1])
            n = len(self.words[item])
            least = coverage * n
            reach = np.zeros(n + 1, dtype=np.int64)
            np.add.at(reach, own[:, 2], 1)
            np.add.at(reach, own[:, 2] + own[:, 3], -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < least:  # not even all matches together cover enough
                continue
            tiles = greedy([(t, i, size) for t, _, i, size in own.tolist()], n, min(SEED, n))
            covered = sum(n for _, _, n in tiles)
            if covered >= least:
                out[int(text[a])].append((item, covered, len(tiles)))
        return out


def tile(text: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, words), longest first; of equally long ones the first in the text, then in the item."""
    matches: list[tuple[int, int, int]] = []
    diagonal: dict[int, tuple[int, int]] = {}  # of each diagonal: start in the item and end of the match that is growing
    for t, i in sorted(set(hits)):
        if not np.array_equal(text[t : t + seed], item[i : i + seed]):
            continue  # equal hashes of different words
        d = t - i
        if d in diagonal and diagonal[d][1] == i + seed - 1:
            diagonal[d] = (diagonal[d][0], i + seed)
        else:
            if d in diagonal:
                a, b = diagonal[d]
                matches.append((a + d, a, b - a))
            diagonal[d] = (i, i + seed)
    matches += [(a + d, a, b - a) for d, (a, b) in diagonal.items()]
    return greedy(matches, len(item), seed)


def greedy(matches: list[tuple[int, int, int]], words: int, seed: int) -> list[tuple[int, int, int]]:
    """Tiles of maximal matches (start in text, start in item of `words` words, words), as tile() returns them."""
    heap = [(-n, t, i) for t, i, n in matches]
    heapq.heapify(heap)
    first = min((t for t, _, _ in matches), default=0)
    used_text = np.zeros(max((t + n for t, _, n in matches), default=0) - first, dtype=bool)
    used_item = np.zeros(words, dtype=bool)
    left, tiles = words, []
    while heap and left >= seed:
        n, t, i = heapq.heappop(heap)
        n, t = -n, t - first
        taken = used_item[i : i + n] | used_text[t : t + n]
        if taken.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for a, b in edges.reshape(-1, 2).tolist():
                if b - a >= seed:
                    heapq.heappush(heap, (a - b, first + t + a, i + a))
            continue
        tiles.append((t + first, i, n))
        used_text[t : t + n] = used_item[i : i + n] = True
        left -= n
    return tiles


def words_column(text: str):
    """The number of words of each text, as the tiling counts them."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(words_of(t)) for t in batch], dtype="int64")

    return run(text)


def small_benchmark(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Benchmark | None:
    """The items (item_id, text) that have words, or None if there are more than block_words words."""
    if (benchmark.select(words_column("text").alias("n")).agg(F.sum("n")).first()[0] or 0) > block_words:
        return None
    rows = ((r["item_id"], words_of(r["text"])) for r in benchmark.select("item_id", "text").toLocalIterator())
    return Benchmark.of([(i, words) for i, words in rows if words])


LEAKS = "array<struct<item_id: long, item_words: int, covered_words: int, tiles: int>>"


def described(block: Benchmark, found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"item_id": block.item_ids[j], "item_words": len(block.words[j]), "covered_words": n, "tiles": k} for j, n, k in sorted(found)]


def leak_column(text: str, block: Benchmark, coverage: float, spark: SparkSession) -> Column:
    """Array of the items of a block that leak into a text."""
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(LEAKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in batches:
            out = []
            for i in range(0, len(batch), 256):
                out += [described(known, found) for found in known.leaks(batch.iloc[i : i + 256].tolist(), coverage)]
            yield pd.Series(out, dtype=object)

    return run(text)


def bloom_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    shift = np.uint64(64 - bits)
    return (hashes * _BASE) >> shift, ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift


def seed_rows(texts: DataFrame, lengths: Sequence[int] | None, bits: int = BLOOM, bloom: np.ndarray | None = None) -> DataFrame:
    """(key, hash, reach, word, mask) of the distinct seeds of each text (key, text).

    lengths: None if the texts are items, which have seeds of one length; else the lengths of all items' seeds. reach: how many words of the
    text the seed covers at most. With a Bloom filter, only seeds that it may hold; without one, rows have their two bits of it.
    """
    spark = texts.sparkSession
    shared = None if bloom is None else spark.sparkContext.broadcast(bloom)  # of fixed size
    kind = dict(texts.dtypes)["key"]
    names = ["key", "hash", "reach", "word", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), ([], [], [])
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = words_of(text)
                    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
                    for k in [min(SEED, len(words))] if lengths is None else lengths:
                        if not 0 < k <= len(words):
                            continue
                        # the length is part of the hash: a short item's seed is no part of a longer one's
                        hashes, times = np.unique(window_hashes(ids, k) * _BASE + np.uint64(k), return_counts=True)
                        if shared is not None:
                            one, two = bloom_places(hashes, bits)
                            held = (shared.value[one >> np.uint64(6)] >> (one & np.uint64(63))) & (shared.value[two >> np.uint64(6)] >> (two & np.uint64(63))) & np.uint64(1) == 1
                            hashes, times = hashes[held], times[held]
                        for held, x in zip(rows, (np.full(len(hashes), i), hashes, times * k), strict=True):
                            held.append(x)
                if not rows[0]:
                    continue
                i, hashes, reach = (np.concatenate(x) for x in rows)
                one, two = bloom_places(hashes, bits)
                each = [np.stack([(x >> np.uint64(6)).view(np.int64) for x in (one, two)], axis=1), np.stack([(np.uint64(1) << (x & np.uint64(63))).view(np.int64) for x in (one, two)], axis=1)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 2), pa.array(x.ravel())) for x in each]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(hashes.view(np.int64)), pa.array(reach), *lists], names=names)

    return texts.select("key", "text").mapInArrow(run, f"key {kind}, hash long, reach long, word array<long>, mask array<long>")


def bloom_filter(seeds: DataFrame, bits: int = BLOOM) -> np.ndarray:
    """The Bloom filter of all seeds: its words are put together by key, so the driver gets 2**bits / 64 rows at most."""
    filled = seeds.select(F.inline(F.arrays_zip("word", "mask"))).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[filled["word"].to_numpy(dtype=np.int64)] = filled["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def text_key() -> Column:
    """Names a text."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def shuffled_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, bits: int = BLOOM) -> DataFrame:
    """(key, found): of the texts with leaks, named by text_key(), the items that leak into them; for a benchmark of any size."""
    items = checkpointed(benchmark.select("item_id", "text", words_column("text").alias("words")).filter("words > 0").withColumn("key", F.monotonically_increasing_id()))
    seeds = checkpointed(seed_rows(items, None, bits))
    lengths = sorted(r[0] for r in items.select(F.least("words", F.lit(SEED))).distinct().collect())  # at most SEED
    texts = docs.select(text_key().alias("key"), "text")
    held = seed_rows(texts, lengths, bits, bloom_filter(seeds, bits)).select("key", "hash")
    # what all shared seeds together may cover is a bound of what tiles cover
    shared = held.join(seeds.select(F.col("key").alias("item"), "hash", "reach"), "hash").groupBy("key", "item").agg(F.sum("reach").alias("reach"))
    wanted = items.select(F.col("key").alias("item"), "item_id", F.col("text").alias("item_text"), "words")
    pairs = checkpointed(shared.join(wanted, "item").filter(F.col("reach") >= F.lit(coverage) * F.col("words")).select("key", "item_id", "item_text"))
    keys = checkpointed(pairs.select("key").distinct())
    again = texts.join(few(keys, keys.count()), "key").groupBy("key").agg(F.first("text").alias("text"))
    gathered = pairs.groupBy("key").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = Benchmark.of([(x["item_id"], words_of(x["item_text"])) for x in asked])
                for row in described(block, block.leaks([text], coverage)[0]):
                    yield pa.RecordBatch.from_pylist([{"key": key, **row}], schema=pa.schema([("key", pa.string()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered_words", pa.int32()), ("tiles", pa.int32())]))

    tiled = again.join(gathered, "key").select("key", "text", "items").mapInArrow(run, "key string, item_id long, item_words int, covered_words int, tiles int")
    return checkpointed(tiled.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item_id", "item_words", "covered_words", "tiles"))).alias("found")))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, id_column: str = "doc_id") -> DataFrame:
    """Return doc_id, item_id, item_words, covered_words, tiles and coverage of every text and item that leaks into it."""
    block = small_benchmark(benchmark, block_words)
    if block is not None:
        found = docs.select(F.col(id_column).alias("doc_id"), leak_column("text", block, coverage, docs.sparkSession).alias("found"))
    else:
        leaking = shuffled_leaks(docs, benchmark, coverage)
        found = docs.select(F.col(id_column).alias("doc_id"), text_key().alias("key")).join(few(leaking, leaking.count()), "key")
    return found.select("doc_id", F.inline("found")).withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs into whose text no item leaks."""
    block, rows = small_benchmark(benchmark, block_words), docs.select(F.struct("*").alias("row_"), "text")
    if block is not None:
        kept = rows.withColumn("found_", leak_column("text", block, coverage, docs.sparkSession)).filter(F.size("found_") == 0)
    else:
        leaking = shuffled_leaks(docs, benchmark, coverage)
        kept = rows.withColumn("key", text_key()).join(few(leaking.select("key"), leaking.count()), "key", "left_anti")
    return kept.select(*[F.col(f"row_.{c}") for c in docs.columns])


def op1_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
