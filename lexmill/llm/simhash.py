"""SimHash near-duplicates by pivot distance tables (operator 7).

A fingerprint has one or more words of 64 bits. Bit j is 1 if bit j is set in over half of the shingles' hashes. Two
fingerprints are linked if at most `radius` bits differ; documents reachable by links form a component.

Search. Every distinct fingerprint has a table of its Hamming distances to PIVOTS random reference fingerprints, worked out once and
carried with it. By the triangle inequality linked fingerprints differ by at most r in each distance, so the table is used twice:
* Keys. A distance, cut into cells of CELL >= 2 r, gives two grids, one moved by r; linked fingerprints share a cell in one of the two.
  A key has the cells of the first one to three pivots and a choice of blocks of the fingerprint's own bits: of `blocks` disjoint blocks
  all but r are equal in linked fingerprints, and each choice of `blocks` - r is one key. (A block of bits is itself a table of distances, to
  the words with one bit set, but that is how it is read here: as bits.) Keys are complete: no link is lost. They grow longer with the
  number of fingerprints, so that a group of equal keys doesn't grow with the table.
* Discarding. A pair in a group is discarded by the largest difference of its two tables; survivors are verified bit by bit.

Near copies at a given similarity (`similarity`): five-word shingles, each distinct one voting once into 512 bits, propose links; no
complete set of keys is small there, so keys are runs of scattered bits, as many as give each pair at that similarity a chance of RECALL,
and as long as the number of fingerprints asks for. At that radius distances to random pivots discard nothing; the one distance that does
is that to the empty set, the number of shingles. Proposed links make clusters; inside a cluster the whole shingle sets are compared
and a link holds if their Jaccard similarity is `similarity` or more. Each cluster's sets move once.

A group or cluster sends out a spanning forest of its links, never all pairs. A group of over GROUP members, or a cluster of over CLUSTER
members or CLUSTER_BYTES, is split in parts; each pair of parts is a group of its own, so every pair is still compared, by many tasks.

Results for odd input: null and empty texts have fingerprint zero and are linked like any other; null doc_ids never name a
component unless it has no other; repeated rows are rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, few, shuffle_partitions, table
from .components import connected_components

SEED = 42
#: Distinct fingerprints in a group that one task compares, and bytes of shingle sets in a part of a cluster.
GROUP = 4096
CLUSTER_BYTES = 1 << 25
PIVOTS = 8
#: Members from which on a cluster's sets are held as bits, if those take no more bytes; and members of a part of a large cluster.
LARGE, BITS_BYTES, CLUSTER = 32, 1 << 26, 1024
#: Bytes of such bits of the pairs that are counted at once.
PAIRS_BYTES = 1 << 22
#: Members of a large cluster that every part of it is compared with.
REPRESENTATIVES = 8
#: Width of a cell of a pivot's distance.
CELL = 8
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class Fingerprints:
    """shingle: words in a shingle; words: 64-bit words of a fingerprint; radius: most bits that linked ones differ in (in the first
    SENT_WORDS words if links are verified); similarity: if given, distinct shingles vote once and links are verified on the shingle
    sets (Jaccard of this or more)."""

    shingle: int = 3
    words: int = 1
    radius: int = 3
    similarity: float | None = None


CONTRACT = Fingerprints()
#: Words of a wide fingerprint that go with its keys. Of their bits, random fingerprints differ in 96 with a scatter of 7, texts at a
#: similarity of 0.8 in 29 with a scatter of 5 (sets of 4 and 5 shingles in 36): a radius of 58 lies four scatters away from any of them.
SENT_WORDS = 3
#: Five words and a similarity of 0.8 or more.
WIDE = Fingerprints(shingle=5, words=8, radius=58, similarity=0.8)
#: Chance that a pair at the similarity asked for shares a key; members that a group of equal keys has in the mean.
RECALL = 0.995
MEMBERS = 32


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, space-joined; the whole sequence if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.frombuffer(xxhash.xxh64_digest(joined, SEED), dtype=">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), dtype=">u8").astype(np.uint64)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive runs of `sizes` hashes: the word whose bits are set in over half of the run's hashes (0 if empty)."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    # byte lanes count to 255, so runs are summed in pieces of at most 255 hashes
    pieces = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    inside = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    cuts = np.repeat(begin, pieces) + 255 * inside
    words = np.zeros(len(full), dtype=np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > sizes[:, None]).astype(np.uint64)
        words |= (over << (np.uint64(8) * np.arange(8, dtype=np.uint64) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    out[full] = words
    return out


def mixed(x: np.ndarray, i: int) -> np.ndarray:
    """The i-th further hash of a hash (the finaliser of a splittable generator); the 0-th is the hash itself."""
    if i == 0:
        return x
    x = x + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(texts: list[str | None], spec: Fingerprints) -> np.ndarray:
    """(texts, words) array of fingerprints."""
    return fingerprints_of_runs([shingle_hashes(t, spec.shingle) for t in texts], spec)


def fingerprints_of_runs(runs: list[np.ndarray], spec: Fingerprints) -> np.ndarray:
    if spec.similarity is not None:
        runs = [np.unique(r) for r in runs]
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    hashes = np.concatenate([*runs, np.zeros(0, dtype=np.uint64)])
    return np.stack([majority_bits(mixed(hashes, i), sizes) for i in range(spec.words)], axis=1)


def fingerprint_column(text: str, spec: Fingerprints):
    """Fingerprints as big-endian bytes; behind them, if links are to be verified, 16 bytes that name the shingle set and 4 with its size."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[bytes] = []
            for i in range(0, len(batch), 128):
                runs = [shingle_hashes(t, spec.shingle) for t in batch.iloc[i : i + 128].tolist()]
                if spec.similarity is not None:
                    runs = [np.unique(r) for r in runs]
                raw = fingerprints_of_runs(runs, spec).astype(">u8").tobytes()
                points = [raw[j : j + 8 * spec.words] for j in range(0, len(raw), 8 * spec.words)]
                out += points if spec.similarity is None else [p + xxhash.xxh3_128_digest(r.tobytes()) + len(r).to_bytes(4, "big") for p, r in zip(points, runs, strict=True)]
            yield pd.Series(out, dtype=object)

    return run(text)


def words_in(points: list[bytes], words: int) -> np.ndarray:
    """(fingerprints, words) array of the first words of fingerprints given as bytes."""
    return np.frombuffer(b"".join([p[: 8 * words] for p in points]), dtype=">u8").astype(np.uint64).reshape(-1, words)


def pivots(words: int, n: int = PIVOTS) -> np.ndarray:
    return mixed(np.arange(1, n * words + 1, dtype=np.uint64), 7).reshape(n, words)


def pivot_table(points: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    refs = pivots(points.shape[1])
    return np.stack([np.bitwise_count(points ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)


def size_table(sizes: np.ndarray, spec: Fingerprints) -> np.ndarray:
    """The logarithm of each set's size, scaled so that sets which are similar enough differ by at most the radius."""
    return np.floor(np.log(np.maximum(sizes, 1)) * ((spec.radius - 1) / -math.log(spec.similarity))).astype(np.int16)[:, None]


def distance_column(point: str, spec: Fingerprints):
    """The table of distances of each fingerprint, as bytes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            held = batch.tolist()
            far = pivot_table(words_in(held, spec.words)) if spec.similarity is None else size_table(np.array([int.from_bytes(p[-4:], "big") for p in held]), spec)
            yield pd.Series([x.tobytes() for x in far.astype("<i2")], dtype=object)

    return run(point)


@dataclass(frozen=True)
class Keys:
    """Choices of blocks of bits, and cells of the first distances; each choice with a cell of each distance is one key."""

    blocks: tuple[tuple[int, int], ...]  # first bit and bits of each block, inside one 64-bit word
    choices: tuple[tuple[int, ...], ...]
    cells: int
    radius: int

    def of(self, points: np.ndarray, far: np.ndarray | None = None) -> np.ndarray:
        """(fingerprints, keys) array: number of the choice, cells, and the bits of the blocks."""
        far = pivot_table(points) if far is None else far
        parts = []
        for at, bits in self.blocks:
            word, shift = divmod(at, 64)
            parts.append((points[:, word] >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
        grids = [np.zeros(len(points), dtype=np.uint64)]
        for i in range(self.cells):
            near = far[:, i].astype(np.int64)
            grids = [(g << np.uint64(4)) | ((near + moved) // CELL).astype(np.uint64) for g in grids for moved in (0, self.radius)]
        out = np.empty((len(points), len(self.choices) * len(grids)), dtype=np.uint64)
        for c, choice in enumerate(self.choices):
            key = np.zeros(len(points), dtype=np.uint64)
            for b in choice:
                key = (key << np.uint64(self.blocks[b][1])) | parts[b]
            for j, grid in enumerate(grids):
                out[:, c * len(grids) + j] = key | (grid << np.uint64(46)) | (np.uint64(c) << np.uint64(58))
        return out.view(np.int64)


@dataclass(frozen=True)
class ScatteredKeys:
    """Keys of `bits` bits each, drawn from all words; keys that follow each other share no bit as long as bits last."""

    words: int
    n: int
    bits: int

    def of(self, points: np.ndarray, far: np.ndarray | None = None) -> np.ndarray:
        """(fingerprints, n) array: number of the key and its bits."""
        raw = np.unpackbits(np.ascontiguousarray(points.astype(">u8")).view(np.uint8), axis=1)
        r, whole = np.random.default_rng(SEED), 64 * self.words // self.bits * self.bits
        places = np.concatenate([r.permutation(64 * self.words)[:whole] for _ in range(-(-self.n * self.bits // whole))])[: self.n * self.bits]
        out = np.empty((len(points), self.n), dtype=np.int64)
        weight = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        for i in range(self.n):
            out[:, i] = raw[:, places[i * self.bits : (i + 1) * self.bits]] @ weight + (i << 40)
        return out


def keys_for(spec: Fingerprints, distinct: int) -> Keys | ScatteredKeys:
    """Keys that are long enough for so many fingerprints."""
    length = math.log2(max(distinct, 2) / MEMBERS)
    if spec.similarity is not None:
        bits = min(32, max(10, math.ceil(length)))
        equal = 1 - math.acos(2 * spec.similarity / (1 + spec.similarity)) / math.pi
        return ScatteredKeys(spec.words, math.ceil(math.log(1 - RECALL) / math.log(1 - equal**bits)), bits)
    # cells of a distance are worth a bit and a half; the forms stand in the order of the number of keys
    forms = [(spec.radius + more, cells) for more in (1, 2, 3) for cells in (1, 2, 3)]
    n, cells = next((f for f in forms if 64 * (f[0] - spec.radius) / f[0] + 1.5 * f[1] >= length), forms[-1])
    edges = [64 * i // n for i in range(n + 1)]
    blocks = tuple((a, b - a) for a, b in zip(edges, edges[1:], strict=False))
    return Keys(blocks, tuple(combinations(range(n), n - spec.radius)), cells, spec.radius)


def joined_in_groups(keys: np.ndarray, holds, check=None, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two ends of each edge of a spanning forest of the links inside each group, and of each place the place that names its tree;
    equal keys are adjacent.

    holds(i, j): which of the pairs (arrays of places) may be links; check(a, b), if given, decides on each pair that isn't joined yet.
    joined: of each place a place of its group that names the tree it is in from the start.
    """
    n = len(keys)
    last = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) if n else np.zeros(0, dtype=np.int64)
    group = np.searchsorted(last, np.arange(n))
    end = last[group] if n else last
    first = np.concatenate([[0], last[:-1] + 1])[group] if n else last
    label = np.arange(n) if joined is None else joined.copy()
    left, right = [], []
    active, k = np.flatnonzero(end > np.arange(n)), 1
    while len(active):
        i = active[label[active] != label[active + k]]
        i = i[holds(i, i + k)]
        for a in i.tolist():
            if (x := label[a]) != (y := label[a + k]) and (check is None or check(a, a + k)):
                left.append(a)
                right.append(a + k)
                part = label[int(first[a]) : int(end[a]) + 1]
                part[part == y] = x
        k += 1
        active = active[end[active] - active >= k]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), label


def near_enough(points: np.ndarray, far: np.ndarray, radius: int):
    """For joined_in_groups: pairs whose tables of distances and whose bits differ by at most radius."""

    def holds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        kept = (np.abs(far[i] - far[j]) <= radius).all(axis=1)
        kept[kept] = np.bitwise_count(points[i[kept]] ^ points[j[kept]]).sum(axis=1, dtype=np.int64) <= radius
        return kept

    return holds


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches, cut so that a group (equal values of the first column, which are adjacent) is never divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        start = int(np.argmax(keys == keys[-1]))
        if start == 0 and held and held[-1].column(0)[-1].as_py() == keys[0]:
            held.append(batch)  # one group goes on through the whole batch
            continue
        if held or start:
            yield [*held, batch.slice(0, start)] if start else held
        held = [batch.slice(start)]
    if held:
        yield held


def link_stream(words: int, radius: int):
    """For mapInArrow over (group, vertex, point, far) sorted by group: the edges (a, b) of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches):
            keys, vertices = (np.concatenate([b.column(c).to_numpy() for b in whole]) for c in (0, 1))
            points = words_in([p for b in whole for p in b.column(2).to_pylist()], words)
            far = np.frombuffer(b"".join([p for b in whole for p in b.column(3).to_pylist()]), dtype="<i2").reshape(len(keys), -1)
            a, b, _ = joined_in_groups(keys, near_enough(points, far, radius))
            yield pa.RecordBatch.from_arrays([pa.array(vertices[a]), pa.array(vertices[b])], schema=EDGES)

    return run


def in_pairs_of_parts(rows: DataFrame, parts: DataFrame, member: str) -> DataFrame:
    """rows (group, ...) of groups with parts (group, parts), each sent to the pairs of parts that it is in, by a hash of `member`."""
    mine = F.pmod(F.xxhash64(member), F.col("parts")).cast("int")
    sent = rows.join(parts, "group").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return sent.withColumn("group", F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other"))).select(*rows.columns)


def links(points: DataFrame, spec: Fingerprints, distinct: int, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect what the (proposed) links connect, for distinct points (vertex long, point binary, far binary)."""
    keys, wide = keys_for(spec, distinct), spec.similarity is not None
    sent = SENT_WORDS if wide else spec.words
    # a set of fewer shingles is similar enough to none but its equals
    least = math.ceil(spec.similarity / (1 - spec.similarity) - 1e-9) if wide else 0

    def explode(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    if wide:
                        part = part.filter(pa.array([int.from_bytes(p[-4:], "big") >= least for p in part.column(1).to_pylist()], pa.bool_()))
                    raw = part.column(1).to_pylist()
                    far = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype="<i2").reshape(part.num_rows, -1) if raw else np.zeros((0, PIVOTS), dtype=np.int16)
                    found = np.sort(keys.of(words_in(raw, spec.words), far), axis=1)
                    new = np.ones(found.shape, dtype=bool)  # two grids may give the same cell
                    new[:, 1:] = found[:, 1:] != found[:, :-1]
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(found[new])], names=["group"])
                        continue
                    index = pa.array(np.nonzero(new)[0])
                    short = pa.array([p[: 8 * sent] for p in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(found[new]), part.column(0).take(index), short.take(index), part.column(2).take(index)], names=["group", "vertex", "point", "far"])

        return run

    rows = points.select("vertex", "point", "far")
    n, stream = shuffle_partitions(points.sparkSession), link_stream(sent, spec.radius)
    hot = checkpointed(rows.mapInArrow(explode(False), "group long").groupBy("group").count().filter(F.col("count") > group))
    keyed = rows.mapInArrow(explode(True), "group long, vertex long, point binary, far binary")
    found = lambda df: df.repartition(n, "group").sortWithinPartitions("group").mapInArrow(stream, "a long, b long")
    if not (m := hot.count()):
        return found(keyed)
    parts = few(hot.select("group", F.ceil(F.col("count") / F.lit(group // 2)).cast("int").alias("parts")), m)
    return found(keyed.join(few(hot.select("group"), m), "group", "left_anti")).unionByName(found(in_pairs_of_parts(keyed, parts, "point")))


def text_key():
    """Names a text."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def shingle_set(text: str, spec: Fingerprints):
    """The distinct shingles of a text, as the bytes of their sorted hashes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(t, spec.shingle)).tobytes() for t in batch], dtype=object)

    return run(text)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """The Jaccard similarity of two shingle sets (sorted hashes) is at least `similarity`."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def shared_bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """A row of bits for each set, one for each element that two or more of them hold; None if that takes over BITS_BYTES."""
    element, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    words = -(-int((times > 1).sum()) // 64)
    if 8 * words * len(sets) > BITS_BYTES:
        return None
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    held = times[place] > 1
    bit = number[place[held]]
    out = np.zeros((len(sets), max(1, words)), dtype=np.uint64)
    np.bitwise_or.at(out, (row[held], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def shared_counts(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits the rows x and y of bits share, pair by pair; rows are copied for PAIRS_BYTES of pairs at a time."""
    step = max(1, PAIRS_BYTES // (8 * bits.shape[1]))
    parts = [np.bitwise_count(bits[x[k : k + step]] & bits[y[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), step)]
    return np.concatenate([*parts, np.zeros(0, dtype=np.int64)])


def similar_in_groups(keys: np.ndarray, sets: list[np.ndarray], spec: Fingerprints, trees: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """joined_in_groups by the similarity of whole sets. What sets of a large group share is counted for many pairs at once.

    trees: a name for each place; places of a group with the same name are joined already."""
    start = np.arange(len(keys))
    if trees is not None and len(keys):
        _, one, place = np.unique(np.stack([keys, trees], axis=1), axis=0, return_index=True, return_inverse=True)
        start = one[place.ravel()]
    size = np.array([len(x) for x in sets])
    points = np.stack([majority_bits(mixed(np.concatenate(sets), i), size) for i in range(SENT_WORDS)], axis=1)
    far = size_table(size, spec)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    large = [(a, b) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False) if b - a >= LARGE]
    alone, left, right, label = np.ones(len(keys), dtype=bool), [], [], start.copy()
    for a, b in large:
        if (bits := shared_bits(sets[a:b])) is None:
            continue
        own, near = size[a:b], near_enough(points[a:b], far[a:b], spec.radius)

        def holds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            kept = near(i, j)  # noqa: B023
            x, y = i[kept], j[kept]
            shared = shared_counts(bits, x, y)  # noqa: B023
            kept[kept] = shared >= spec.similarity * (own[x] + own[y] - shared) - 1e-9  # noqa: B023
            return kept

        one, two, named = joined_in_groups(keys[a:b], holds, joined=start[a:b] - a)
        left.append(one + a)
        right.append(two + a)
        label[a:b] = named + a
        alone[a:b] = False
    at = np.flatnonzero(alone)
    if len(at):
        one, two, named = joined_in_groups(keys[at], near_enough(points[at], far[at], spec.radius), lambda i, j: similar(sets[at[i]], sets[at[j]], spec.similarity), np.searchsorted(at, start[at]))
        left.append(at[one])
        right.append(at[two])
        label[at] = at[named]
    return np.concatenate([*left, np.zeros(0, dtype=np.int64)]), np.concatenate([*right, np.zeros(0, dtype=np.int64)]), label


def verify_stream(spec: Fingerprints, whole_clusters: bool):
    """For mapInArrow over (group, vertex, shingles, and tree if some are joined already) sorted by group: pairs of a vertex that has links that hold and the vertex that names
    its component, of all vertices with links if groups are whole clusters, else of all that others name: stars, which are joined in few rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches):
            keys, vertices = (np.concatenate([b.column(c).to_numpy() for b in whole]) for c in (0, 1))
            trees = np.concatenate([b.column(3).to_numpy() for b in whole]) if whole[0].num_columns > 3 else None
            _, _, label = similar_in_groups(keys, [np.frombuffer(x.as_buffer(), dtype=np.uint64) for r in whole for x in r.column(2)], spec, trees)
            a = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1 if whole_clusters else label != np.arange(len(label)))
            b = label[a]
            yield pa.RecordBatch.from_arrays([pa.array(vertices[a]), pa.array(vertices[b])], schema=EDGES)

    return run


def linked_in_parts(sets: DataFrame, hot: DataFrame, found, group: int, most: int) -> DataFrame:
    """(vertex, component) by the links that hold, for the clusters in hot (group, parts); sets has group, vertex, shingles, bytes.

    First each part of a cluster is compared with itself and with the cluster's representatives, which go to all parts: the work is the
    number of members times a part's size. A cluster that this makes one tree, as near copies of one text are, is done. Of any other one,
    the members outside its largest tree, in parts of their own, meet every part of the cluster, so no link between two trees is lost.
    """
    mine = F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("int")
    held = sets.join(hot, "group").withColumn("mine", mine)
    # Spark cuts each partition to its first rows by rank before the shuffle
    drawn = held.select("group", "vertex", "parts", "mine", "bytes", F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("vertex", F.lit(1)), "vertex")).alias("rank")).filter(F.col("rank") <= REPRESENTATIVES)
    total = F.sum("bytes").over(Window.partitionBy("group").orderBy("rank"))
    chosen = drawn.withColumn("total", total).filter((F.col("rank") == 1) | (F.col("total") <= most // 2))
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("mine"))
    shown = chosen.select("group", "vertex", F.explode(other).alias("mine")).join(sets.select("vertex", "shingles"), "vertex")
    columns = (F.xxhash64("group", "mine").alias("group"), "vertex", "shingles")
    edges = checkpointed(found(held.select(*columns).unionByName(shown.select(*columns))))
    named = held.select("group", "vertex", "parts", "mine", "bytes").join(connected_components(edges), "vertex", "left")
    named = checkpointed(named.withColumn("tree", F.coalesce("component", "vertex")))
    trees = named.groupBy("group", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    largest = trees.groupBy("group").agg(F.count(F.lit(1)).alias("trees"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "tree", "bytes")).alias("most"))
    rest_parts = F.greatest(F.ceil((F.col("n") - F.col("most.n")) / F.lit(group // 2)), F.ceil((F.col("bytes") - F.col("most.bytes")) / F.lit(most // 2)), F.lit(1)).cast("int")
    open_ = checkpointed(largest.filter("trees > 1").select("group", F.col("most.tree").alias("largest"), rest_parts.alias("rest_parts")))
    if not (m := open_.count()):
        return named.filter("component IS NOT NULL").select("vertex", "component")
    members = named.join(few(open_, m), "group")
    whole = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)))
    outside = members.filter("tree <> largest").withColumn("other", F.pmod(F.xxhash64("vertex", F.lit(2)), F.col("rest_parts")).cast("int"))
    met = outside.withColumn("mine", F.explode(other))  # in its own part it is already
    columns = (F.xxhash64("group", "mine", "other").alias("group"), "vertex", "tree")
    blocks = whole.select(*columns).unionByName(met.select(*columns)).join(sets.select("vertex", "shingles"), "vertex")
    return connected_components(edges.unionByName(found(blocks.select("group", "vertex", "shingles", "tree"))))


def verified(proposed: DataFrame, points: DataFrame, docs: DataFrame, spec: Fingerprints, group: int = GROUP, most: int = CLUSTER_BYTES) -> DataFrame:
    """(vertex, component) by the links that hold between whole shingle sets, inside each cluster of proposed links; points has vertex and
    text_key. Only texts of clusters are read again."""
    clusters = connected_components(proposed)
    wanted = checkpointed(points.select("vertex", "text_key").join(clusters.select("vertex", F.col("component").alias("group")), "vertex"))
    texts = docs.select(text_key().alias("text_key"), "text").join(few(wanted, wanted.count()), "text_key")
    sets = checkpointed(texts.groupBy("vertex", "group").agg(F.first("text").alias("text")).select("group", "vertex", shingle_set("text", spec).alias("shingles")))
    sizes = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    group = min(group, CLUSTER)
    parts = F.greatest(F.ceil(F.col("n") / F.lit(group // 2)), F.ceil(F.col("bytes") / F.lit(most // 2))).cast("int")
    hot = checkpointed(sizes.filter((F.col("n") > group) | (F.col("bytes") > most)).select("group", parts.alias("parts")))
    n = shuffle_partitions(docs.sparkSession)
    found = lambda df, whole: df.repartition(n, "group").sortWithinPartitions("group").mapInArrow(verify_stream(spec, whole), "a long, b long")
    if not (m := hot.count()):
        return found(sets, True).toDF("vertex", "component")
    small = found(sets.join(few(hot.select("group"), m), "group", "left_anti"), True).toDF("vertex", "component")
    linked = linked_in_parts(sets.withColumn("bytes", F.length("shingles")), few(hot, m), lambda df: found(df, False), group, most)
    return small.unionByName(linked)


def classes(docs: DataFrame, spec: Fingerprints, id_column: str, group: int, row_key=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, point, and row_key if given); linked points (point, first, component), their components (component, first_of), and points
    alone (vertex, point, first). A first is the least (none, doc_id, row_key); none is true for a row without doc_id."""
    extra = [] if row_key is None else [row_key.alias("row_key")]
    verify = spec.similarity is not None
    held = [text_key().alias("text_key")] if verify else []
    rows = checkpointed(docs.select(F.col(id_column).alias("doc_id"), fingerprint_column("text", spec).alias("point"), *held, *extra))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *(["row_key"] if extra else [])))
    points = checkpointed(rows.groupBy("point").agg(first.alias("first"), *([F.min("text_key").alias("text_key")] if verify else [])).withColumn("vertex", F.monotonically_increasing_id()))
    tables = checkpointed(points.select("vertex", "point", distance_column("point", spec).alias("far")))
    proposed = links(tables, spec, tables.count(), group)
    found = checkpointed(verified(proposed, points, docs, spec, group) if verify else connected_components(proposed))
    linked = points.join(found, "vertex").select("point", "first", "component")
    # its own table, so that the rows of a large component meet their minimum by a join that Spark can split or broadcast
    least = checkpointed(linked.groupBy("component").agg(F.min("first").alias("first_of")))
    return rows, linked, least, points.join(found, "vertex", "left_anti").select("vertex", "point", "first")


def components(docs: DataFrame, spec: Fingerprints = CONTRACT, id_column: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Return doc_id, point (the fingerprint's bytes), component and component_id for every row of docs.

    component names the component even where it has no doc_id but null. If links are verified, point has the set's name and size behind it.
    """
    rows, linked, least, alone = classes(docs, spec, id_column, group)
    named = linked.join(few(least, least.count()), "component").select("point", "component", F.col("first_of.doc_id").alias("component_id"))
    by_point = named.unionByName(alone.select("point", F.col("vertex").alias("component"), F.col("first.doc_id").alias("component_id")))
    return rows.join(by_point, "point").select("doc_id", "point", "component", "component_id")


def without_near_duplicates(docs: DataFrame, spec: Fingerprints = WIDE, group: int = GROUP) -> DataFrame:
    """The row with the smallest doc_id of each component stays, one without doc_id only if all are (of rows equal in doc_id and text, one)."""
    # names a row by id and text
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))
    rows, _, least, alone = classes(docs, spec, "doc_id", group, key)
    kept = least.select("first_of.row_key").unionByName(alone.select("first.row_key")).withColumn("kept", F.lit(True))
    counted = rows.groupBy("row_key").count().join(kept, "row_key", "left")
    marked = checkpointed(counted.filter("kept IS NULL OR count > 1").select("row_key", F.col("kept").isNotNull().alias("kept")))
    dropped, repeated = marked.filter("NOT kept").select("row_key"), marked.filter("kept").select("row_key")
    stay = docs.select(F.struct("*").alias("row_"), key.alias("row_key")).join(few(dropped, dropped.count()), "row_key", "left_anti")
    if n := repeated.count():
        one = stay.join(few(repeated, n), "row_key", "left_semi").groupBy("row_key").agg(F.first("row_").alias("row_")).select("row_", "row_key")
        stay = stay.join(few(repeated, n), "row_key", "left_anti").select("row_", "row_key").unionByName(one)
    return stay.select(*[F.col(f"row_.{c}") for c in docs.columns])


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("point")).alias("fingerprint"), "component_id")
