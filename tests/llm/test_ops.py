"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import components as cc
from lexmill.llm import crf, decontaminate, exact_dedup, gru, html_extract, licenses, mixing, page_samples, sharding, simhash, toxicity, url_filter, warc

#: Columns whose names clash with what operators use inside.
EXTRA = ["lang", "size", "weight", "row_", "shard", "slot", "score", "place"]


def documents(spark, rows, extra=True):
    """(doc_id, text, source) rows, with extra columns."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return frame.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)], F.length("text").alias("n_chars")) if extra else frame


def some_texts(n, seed=1, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(words)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = some_texts(60)
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100, None, "s1"), (101, "", None), (None, "null id", "s1"), (None, None, None), (102, "long " * 30_000, "s2"), (103, "twice", "s0"), (103, "twice", "s0"), (104, texts[0], "s3"), (105, texts[0], "s3"), (106, " \n\t ", "s0")]
    return rows


def key(r):
    return tuple("" if x is None else str(x) for x in r)


# --- sharding ----------------------------------------------------------------------------------------------------------------------


def test_shards_are_balanced_and_slots_gapless(spark, odd):
    out = sharding.shard_rows(documents(spark, odd), 7, 32, keep=["lang"]).collect()
    assert len(out) == len(odd)
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    expected = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in odd)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == expected
    again = sharding.shard_rows(documents(spark, odd).repartition(5), 7, 32)
    distinct = lambda rows: {(r["doc_id"], r["text_crc32"]): r["shard"] for r in rows if r["doc_id"] not in (103, None)}
    assert distinct(out) == distinct(again.collect())


def test_placement_follows_the_ring_row_by_row():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, 1 << sharding.RING_BITS)
    segments = sharding.place_cells(counts, 5, 16)
    points, total = sharding.ring_points(5, 16), int(counts.sum())
    room = [total // 5 + (s < total % 5) for s in range(5)]
    placed = [None] * total
    for s in segments:
        placed[s.first : s.first + s.count] = [s.shard] * s.count
    row, cells = 0, [c for c, _ in points]
    for cell, n in enumerate(counts.tolist()):
        at = int(np.searchsorted(cells, cell))
        for _ in range(n):
            step = at
            while not room[points[step % len(points)][1]]:
                step += 1
            shard = points[step % len(points)][1]
            room[shard] -= 1
            assert placed[row] == shard
            row += 1


def test_growing_the_ring_moves_few_rows(spark):
    docs = documents(spark, [(i, f"t{i}", "s") for i in range(6000)], extra=False)
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, n).collect()} for n in (24, 25))
    assert sum(a[i] != b[i] for i in a) / len(a) < 0.2


def test_sharding_no_rows(spark, odd):
    assert sharding.shard_rows(documents(spark, odd).limit(0)).count() == 0
    manifest = sharding.shard_manifest(documents(spark, odd), 3)
    assert manifest.columns[:3] == ["doc_id", "source", "lang"] and manifest.count() == len(odd)


# --- mixing --------------------------------------------------------------------------------------------------------------------------


def brute_mix(rows, weights=(5, 2, 1), epochs=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    skey = lambda s: "1" if s is None else "0" + s
    place = lambda d, t: hashlib.md5(":".join([str(d) if d is not None else "null", *([t] if t is not None else [])]).encode()).hexdigest()
    sources = sorted({skey(s) for _, _, s in rows})
    total = {k: sum(size(t) for _, t, s in rows if skey(s) == k) for k in sources}
    w = {k: float(weights[i % len(weights)]) for i, k in enumerate(sources)}
    budget, open_, target = sum(total.values()), set(sources), {}
    left = budget
    while open_:
        level = left / sum(w[k] for k in open_)
        full = [k for k in open_ if w[k] * level > epochs * total[k]]
        if not full:
            target |= {k: w[k] * level for k in open_}
            break
        for k in full:
            target[k] = float(epochs * total[k])
            left -= target[k]
            open_.remove(k)
    copies, each = [], []
    for k in sources:
        run = 0
        for p, n in sorted((place(d, t), size(t)) for d, t, s in rows if skey(s) == k):
            run += n
            copies += [((run + e * total[k]) / w[k], k, e, p, len(each), n) for e in range(epochs) if n]
            each.append((k, p, n))
    taken, used = 0, Counter()
    for c in sorted(copies):
        taken += c[5]
        if taken > budget:
            break
        used[c[4]] += 1
    return Counter((k, p, n, total[k], round(target[k], 6), used[i] * n) for i, (k, p, n) in enumerate(each))


def test_mix_equals_brute_force(spark, odd):
    out = mixing.mix(documents(spark, odd)).collect()
    assert len(out) == len(odd)
    assert Counter((r["skey"], r["place"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in out) == brute_mix(odd)


@pytest.mark.parametrize("copies", [300, 400, 3600])  # of one row, in sources of 400 and 4000 rows
def test_mix_of_repeated_rows(spark, copies):
    size = 4000 if copies > 400 else 400
    rows = [(1, " ".join(["w"] * 50), "a")] * copies + [(10 + i, " ".join(["w"] * 50), "a") for i in range(size - copies)] + [(10_000 + i, " ".join(["v"] * 50), "b") for i in range(size)]
    docs = documents(spark, rows)
    out = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {r["source"]: r["target"] for r in out}
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 50 for s in target) and sum(taken.values()) <= 100 * size
    made = Counter((r["source"], r["doc_id"]) for r in mixing.mixed_documents(docs).select("source", "doc_id").collect())
    assert {s: 50 * sum(n for (x, _), n in made.items() if x == s) for s in taken} == dict(taken)


def test_mix_comes_near_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 13 + 1)), "abc"[min(2, i % 7)]) for i in range(900)]
    out = mixing.mix(documents(spark, rows, extra=False)).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 26 for s in target)


def test_mixed_rows_and_no_rows(spark, odd):
    docs = documents(spark, odd)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["skey"], r["place"]] += r["copies"]
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    counted = Counter((r["skey"], r["place"]) for r in mixing.keyed(made.select("doc_id", "source", "text")).collect())
    assert counted == {k: n for k, n in plan.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.mixed_documents(docs.limit(0)).count()
    assert mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).filter("taken <> 0").count() == 0


# --- exact duplicates ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (3, 5)])  # small primes: fingerprints collide
def test_duplicates_equal_brute_force(spark, odd, primes):
    out = exact_dedup.duplicates(documents(spark, odd), primes=primes, chunk=7).collect()
    groups = defaultdict(list)
    for d, t, _ in odd:
        groups[t or ""].append(d)
    assert len(out) == len(odd)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in out:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup.duplicates(documents(spark, odd).limit(0)).count() == 0


def test_fingerprints_compose():
    r = random.Random(3)
    for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True):
        texts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 16, 17, 300, 5000]))) for _ in range(40)]
        plain = lambda t: __import__("functools").reduce(lambda h, x: (h * b + x) % p, t, 0)  # noqa: B023, E731
        hashes = exact_dedup.polynomial_hashes(texts, p, b).tolist()
        assert hashes == [plain(t) for t in texts]
        joined = exact_dedup.combine((hashes[0], len(texts[0])), (hashes[1], len(texts[1])), p, b)
        assert joined == (plain(texts[0] + texts[1]), len(texts[0] + texts[1]))


# --- near duplicates -------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd):
    r = random.Random(5)
    base = some_texts(1, 9)[0] + " and a tail of words that stays the same in all of these texts"
    near = [" ".join(w if r.random() > 0.01 else "x" for w in (base * 4).split()) for _ in range(30)]
    rows = odd + [(200 + i, t, "n") for i, t in enumerate(near)]
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        least[find(i)].append(d)
    expected = Counter((d, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _, _) in enumerate(rows))
    for group in (simhash.GROUP, 4):  # 4: groups are split in parts
        out = simhash.components(documents(spark, rows), group=group).select("doc_id", F.lower(F.hex("point")).alias("f"), "component_id")
        assert Counter(tuple(x) for x in out.collect()) == expected
    assert simhash.components(documents(spark, rows).limit(0)).count() == 0


def test_keys_are_complete():
    rng = np.random.default_rng(4)
    for distinct in (10, 1 << 23, 1 << 31):
        keys = simhash.keys_for(simhash.CONTRACT, distinct)
        x = rng.integers(0, 1 << 63, 500, dtype=np.uint64).reshape(-1, 1)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in x], dtype=np.uint64)
        assert (keys.of(x) == keys.of(x ^ flips[:, None])).any(axis=1).all()


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, (200, 2), dtype=np.uint64)
    y = x.copy()
    y[:, 0] ^= np.uint64(0b1011)
    assert (np.abs(simhash.pivot_table(x) - simhash.pivot_table(y)) <= 3).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r["vertex"]: r["component"] for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(41)}) == 1 and found[100] == found[101] != found[0]
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, odd):
    docs = documents(spark, odd)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = Counter(r["text"] for r in kept.collect())
    assert max(texts.values()) == 1 and texts["twice"] == 1
    assert {t for _, t, _ in odd if t and t.strip()} == {t for t in texts if t and t.strip()}
    assert sum(1 for t in texts if not (t or "").strip()) == 1  # texts without words are one group
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0


def test_wide_search_finds_near_copies(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, changed = [], []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(300)]
        rows.append((2 * i, " ".join(words), "s"))
        for _ in range(3):  # 15 of 296 shingles each way: similarity 0.9
            words[r.randrange(300)] = "changed"
        rows.append((2 * i + 1, " ".join(words), "s"))
    found = {x["doc_id"]: x["component_id"] for x in simhash.components(documents(spark, rows, extra=False), simhash.WIDE).collect()}
    changed = sum(found[2 * i + 1] == 2 * i for i in range(60))
    assert changed >= 57
    assert len({found[2 * i] for i in range(60)}) == 60


def test_wide_keys_have_their_recall():
    r = random.Random(3)
    one, two = [], []
    while len(one) < 2000:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([40, 120, 300]))]
        other = list(words)
        for _ in range(int(r.uniform(0, 0.05) * len(words))):
            other[r.randrange(len(other))] = f"x{r.randrange(10**6)}"
        a, b = (np.unique(simhash.shingle_hashes(" ".join(w), 5)) for w in (words, other))
        shared = len(np.intersect1d(a, b))
        if 0.8 <= shared / (len(a) + len(b) - shared) < 0.85:
            one.append(a)
            two.append(b)
    x, y = (simhash.fingerprints_of_runs(s, simhash.WIDE) for s in (one, two))
    sizes = [simhash.size_table(np.array([len(a) for a in s]), simhash.WIDE) for s in (one, two)]
    near = simhash.near_enough(np.concatenate([x, y])[:, : simhash.SENT_WORDS], np.concatenate(sizes), simhash.WIDE.radius)(np.arange(2000), np.arange(2000) + 2000)
    longer = [simhash.keys_for(simhash.WIDE, n) for n in (10**4, 10**6, 10**8)]
    assert [k.bits for k in longer] == sorted({k.bits for k in longer})
    for keys in longer:
        assert ((keys.of(x) == keys.of(y)).any(axis=1) & near).mean() > 0.98


@pytest.mark.parametrize("group", [simhash.GROUP, 6])  # 6: groups and clusters are divided
def test_near_duplicates_equal_brute_force(spark, odd, group):
    r = random.Random(12)
    rows = list(odd)
    for i in range(12):  # families of texts that differ a little from each other; some share passages only
        words = [f"f{i}w{r.randrange(10**6)}" for _ in range(r.choice([9, 30, 150]))]
        for j in range(r.randint(2, 9)):
            other = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, len(words) // 3])):
                other[r.randrange(len(other))] = f"x{r.randrange(10**6)}"
            rows.append((1000 + 20 * i + j, " ".join(other), "n"))
    kept = Counter(x["doc_id"] for x in simhash.without_near_duplicates(documents(spark, rows), group=group).collect())
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        classes[find(i)].append(d)
    assert kept == Counter(min((d for d in c if d is not None), default=None) for c in classes.values())


def test_clusters_in_parts_lose_no_link(spark):
    r = random.Random(3)
    rows = []
    for c in range(2):  # chains, in which only neighbours are similar enough, and a star of near copies
        words = [f"c{c}w{i}" for i in range(150)]
        rows += [(100 * c + i, " ".join(words[4 * i : 4 * i + 60]), "n") for i in range(18)]
    rows += [(500 + i, " ".join([*(f"s{k}" for k in range(80)), f"y{i}"]), "n") for i in range(30)]
    r.shuffle(rows)
    kept = {x["doc_id"] for x in simhash.without_near_duplicates(documents(spark, rows), group=6).collect()}
    assert kept == {0, 100, 500}


@pytest.mark.parametrize("most", [simhash.BITS_BYTES, 0])  # 0: pair by pair
def test_sets_of_large_groups_equal_pair_by_pair(monkeypatch, most):
    monkeypatch.setattr(simhash, "BITS_BYTES", most)
    rng = np.random.default_rng(3)
    base, sets, keys = rng.integers(1, 1 << 63, 200, dtype=np.uint64), [], []
    for g, n in enumerate((60, 1, 5, 40, 33)):
        for _ in range(n):
            own = base[rng.random(200) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate([own, rng.integers(1, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])))
            keys.append(g)
    left, right, label = simhash.similar_in_groups(np.array(keys), sets, simhash.WIDE)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if keys[i] == keys[j] and simhash.similar(sets[i], sets[j], 0.8):
                parent[find(i)] = find(j)
    expected = Counter(frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets)))
    assert Counter(frozenset(np.flatnonzero(label == label[i]).tolist()) for i in range(len(sets))) == expected
    assert len(left) == len(sets) - len({find(i) for i in range(len(sets))}) and (label[left] == label[right]).all()


def test_near_copies_are_verified_on_shingle_sets(spark):
    r = random.Random(9)
    line = " ".join(f"often{i}" for i in range(12))
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(40):  # one often repeated line, all else different: similarity 0.02
        rows.append((i, " ".join([*own(150), *[line] * 20, *own(150)]), "apart"))
    for i in range(40):  # the same words, the line once or 20 times: similarity of over 0.9
        a, b = own(150), own(150)
        rows += [(1000 + 2 * i, " ".join([*a, line, *b]), "near"), (1001 + 2 * i, " ".join([*a, *[line] * 20, *b]), "near")]
    for i in range(60):  # the last 60 of 296 shingles differ: 236 / 356 = 0.66; the last 30: 266 / 326 = 0.816
        words = own(300)
        rows += [(2000 + 3 * i, " ".join(words), "edge"), (2001 + 3 * i, " ".join(words[:240] + own(60)), "edge"), (2002 + 3 * i, " ".join(words[:270] + own(30)), "edge")]
    kept = {x["doc_id"] for x in simhash.without_near_duplicates(documents(spark, rows, extra=False)).collect()}
    assert kept >= set(range(40))
    assert kept & set(range(1000, 1080)) == set(range(1000, 1080, 2))
    assert all(2000 + 3 * i in kept and 2001 + 3 * i in kept for i in range(60))
    assert sum(2002 + 3 * i in kept for i in range(60)) <= 3


# --- decontamination --------------------------------------------------------------------------------------------------------------------


def brute_tiles(text, item, least):
    """Greedy string tiling by definition: again and again the longest match of unmarked words."""
    used_t, used_i, tiles = set(), set(), []
    while True:
        best = None
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] and t + n not in used_t and i + n not in used_i:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (t, i, n)
        if best is None:
            return tiles
        tiles.append(best)
        used_t |= set(range(best[0], best[0] + best[2]))
        used_i |= set(range(best[1], best[1] + best[2]))


def test_tiling_equals_its_definition():
    r = random.Random(7)
    for _ in range(60):
        item = [r.choice("abc") for _ in range(r.randint(3, 14))]
        text = [r.choice("abcx") for _ in range(r.randint(0, 30))]
        ids = {c: k for k, c in enumerate("abcx")}
        t, i = (np.array([ids[c] for c in x], dtype=np.int64) for x in (text, item))
        hits = [(a, b) for a in range(len(t) - 2) for b in range(len(i) - 2) if (t[a : a + 3] == i[b : b + 3]).all()]
        mine, theirs = decontaminate.tile(t, i, hits, 3), brute_tiles(text, item, 3)
        assert sum(n for *_, n in mine) == sum(n for *_, n in theirs)
        assert [n for *_, n in mine] == [n for *_, n in theirs]


def test_matches_and_tiles_of_whole_texts_equal_brute_force():
    r = random.Random(11)
    for alphabet in ("ab", "abcdefgh"):
        items = [[r.choice(alphabet) for _ in range(r.randint(1, 25))] for _ in range(25)]
        items += [items[0], ["a"] * 12]
        texts = [[r.choice(alphabet + "x") for _ in range(r.randint(0, 60))] + r.choice(items) for _ in range(25)] + [["a"] * 70, []]
        block = decontaminate.Benchmark.of([(i % 20, [w.encode() for w in x]) for i, x in enumerate(items)])  # some ids are equal
        found = block.leaks([" ".join(t) for t in texts], 0.5)
        for text, leaks in zip(texts, found, strict=True):
            expected = []
            for i, item in enumerate(items):
                tiles = brute_tiles(text, item, min(decontaminate.SEED, len(item)))
                if tiles and 2 * sum(n for *_, n in tiles) >= len(item):
                    expected.append((i, sum(n for *_, n in tiles), len(tiles)))
            assert sorted(leaks) == expected


def test_repetitive_texts_are_tiled_in_time():
    import time

    block = decontaminate.Benchmark.of([(1, [b"a"] * 200), (2, [b"a", b"b"] * 100)])
    start = time.perf_counter()
    found = block.leaks(["a " * 100_000, "a b " * 30_000, "b " * 50_000], 0.5)
    assert found == [[(0, 200, 1)], [(1, 200, 1)], []] and time.perf_counter() - start < 20


def test_leaks(spark):
    r = random.Random(2)
    items = [[f"{c}{r.randrange(10**6)}" for _ in range(24)] for c in "pqr"] + [["only", "three", "words"], []]
    text = lambda w: " ".join(w)
    bench = spark.createDataFrame([*[(i, text(w)) for i, w in enumerate(items)], (9, None)], "item_id long, text string")
    pad = some_texts(20, 3)
    rows = [
        (1, f"{pad[0]} {text(items[0])} {pad[1]}", "s"),
        (2, f"{text(items[1][12:])}, {pad[2]}\n{text(items[1][:12]).upper()}", "s"),  # halves in the other order
        (3, f"{pad[3]} {text(items[2][:9])}", "s"),  # 9 of 24 words
        (4, f"x only three words y {text(items[0])} {text(items[1])}", "s"),
        (5, None, "s"), (6, "", "s"), (None, text(items[2]), "s"), (7, ("z " * 5000) + text(items[2]), "s"), (7, ("z " * 5000) + text(items[2]), "s"),
    ]
    docs = documents(spark, rows)
    expected = Counter({(1, 0): 1, (2, 1): 1, (4, 0): 1, (4, 1): 1, (4, 3): 1, (None, 2): 1, (7, 2): 2})
    for block in (decontaminate.BLOCK_WORDS, 1):  # 1: the seeds are joined by a shuffle
        assert Counter((x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, bench, block_words=block).collect()) == expected
        kept = decontaminate.without_leaks(docs, bench, block_words=block)
        assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [3, 5, 6]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), bench).count()


# --- toxicity ------------------------------------------------------------------------------------------------------------------------------


def test_gradients():
    net = gru.Network.start()
    for k in net.parameters():
        setattr(net, k, getattr(net, k).astype(np.float64))
    words, ids = [b"idiot", b"the", b"a", b"x" * 40], np.array([[0, 1, 2, 3, *[0] * 28], [3, 1, *[0] * 30]])
    size, label, weight = np.array([4, 2]), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    grads = net.gradients(words, ids, size, label, weight)

    def loss():
        p = gru.sigmoid(net.run(net.vectors(words)[0] @ net.inputs + net.bias, ids, size).astype(float))
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()

    for k, v in net.parameters().items():
        flat, at = v.ravel(), int(np.argmax(np.abs(grads[k])))
        old = flat[at]
        flat[at] = old + 1e-3
        high = loss()
        flat[at] = old - 1e-3
        low = loss()
        flat[at] = old
        assert grads[k].ravel()[at] == pytest.approx((high - low) / 2e-3, rel=1e-3, abs=1e-6)


def test_all_windows_cover_all_words():
    begin, size, text = gru.windows_of([0, 1, 32, 33, 100])
    for i, n in enumerate([0, 1, 32, 33, 100]):
        own = [(b - sum([0, 1, 32, 33, 100][:i]), s) for b, s, t in zip(begin, size, text, strict=True) if t == i]
        assert {w for b, s in own for w in range(b, b + s)} == set(range(n)) and len(own) >= 1


def test_batches_score_alike():
    net = gru.Network.start()
    texts = [*some_texts(40, 4), None, "", "word " * 500, "Idiot!! idiot"]
    whole = gru.Scorer(net).scores(texts)
    assert np.allclose(whole, [gru.Scorer(net).scores([t])[0] for t in texts], atol=1e-5)
    assert ((whole > 0) & (whole < 1)).all()


def test_held_out_accuracy_and_filter(spark):
    r = random.Random(1)
    texts = some_texts(700, 6)
    rows, labels = [], []
    for i, t in enumerate(texts):
        toxic = i % 4 == 0
        words = t.split()
        if toxic:
            words.insert(r.randint(0, len(words)), f"zork{r.choice('abcdefgh')}{r.choice('mnop')}")
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "s"), (901, "", "s"), (None, "x", "s")]
    labels += [(900, 1), (None, 0), (5000, 1), (6, None), (7, 9)]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(docs, marks)
    scored = {x["doc_id"]: (x["held"], x["score"]) for x in docs.select("doc_id", toxicity.held_out().alias("held"), toxicity.score_column("text", model, spark).alias("score")).collect()}
    test = [(i % 4 == 0, s >= 0.3) for i, (h, s) in scored.items() if h and i is not None and i < 700]
    assert len(test) > 100 and sum(a == b for a, b in test) / len(test) > 0.95
    assert scored[None][0] is False and 0 <= scored[901][1] <= 1
    kept = docs.select("*").filter(F.lit(True))
    out = toxicity.without_toxic(kept, marks)
    assert out.columns == docs.columns
    assert {x["doc_id"] for x in out.collect()} == {i for i, (_, s) in scored.items() if s < 0.3}
    none = toxicity.without_toxic(docs, marks.limit(0))
    assert none.count() == docs.count() and toxicity.without_toxic(docs.limit(0), marks).count() == 0




def test_license_windows(spark, odd):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by"
    scattered = " ".join(["released", *["x"] * 30, "under", *["y"] * 30, "the", *["z"] * 30, "license"])
    r = random.Random(4)
    words = [w for _, t in licenses.TEMPLATES for w in re.split(licenses.SEPARATOR, t) if w] + ["x", "y"]
    mixed = [" ".join(r.choice(words) for _ in range(200)) for _ in range(10)] + [t.replace(" ", r.choice(["\n", " x ", "  "]), r.randint(1, 4)) for _, t in licenses.TEMPLATES for _ in range(4)]
    rows = odd + [(300, grant, "l"), (301, bsd, "l"), (302, gpl, "l"), (303, scattered, "l")] + [(400 + i, t, "l") for i, t in enumerate(mixed)]
    out = licenses.scan_windows(documents(spark, rows)).collect()
    by_id = {x["doc_id"]: (x["labels"], round(x["score"], 9)) for x in out}
    assert [by_id[i] for i in (300, 301, 302, 303)] == [(["mit"], 1.0), (["bsd"], 1.0), (["gpl"], 1.0), ([], 0.0)]

    def brute(text):
        tokens = [w for w in re.split(licenses.SEPARATOR, (text or "").lower()) if w]
        base = {label for p, label in licenses.PHRASES if f" {p} " in f" {' '.join(tokens)} "}
        found, best = set(), 0.0
        for label, t in licenses.TEMPLATES:
            template, width = set(licenses.template_tokens(t)), licenses.window_words(t)
            own = set(licenses.OWN.get(label, ())) & template
            shared = max((len(set(tokens[i : i + width]) & template) for i in range(len(tokens)) if own <= set(tokens[i : i + width])), default=0)
            if shared >= licenses.needed(len(template), licenses.THRESHOLD):
                found.add(label)
                best = max(best, shared / len(template))
        return sorted(base | found), 1.0 if base else round(best, 9)

    expected = Counter(repr((d, *brute(t))) for d, t, _ in rows)
    assert Counter(repr((x["doc_id"], x["labels"], round(x["score"], 9))) for x in out) == expected
    assert licenses.scan_windows(documents(spark, rows).limit(0)).count() == 0
    db = duckdb.connect()
    db.register("documents", pd.DataFrame([(d, t) for d, t, _ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    theirs = db.execute(licenses.oracle_op9()).fetchall()
    in_order = ("doc_id", "n_words", "n_base", "first_word", "last_word")
    ours = Counter((*(x[c] for c in in_order), ",".join(x["base_labels"]), ",".join(x["labels"]), round(x["score"], 9)) for x in out)
    assert ours == Counter((*x[:7], round(x[7], 9)) for x in theirs)


# --- html ------------------------------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>t</title><style>a{}</style></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Head</h1><p>One &amp; two.</p><p>Three  \n four.</article><footer>&copy; x</footer></body></html>", "Head One & two. Three four."),
    ("<article><p>a<b>b</b>c<br>d</p><script>var x='</p><p>no</p>';</script><!-- <p>no</p> --><p title='1 > 0'>e</p></article>", "abc d e"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut</p><p", "cut"),
    (None, ""), ("", ""), ("<nav><a href='/x'>x</a></nav>", ""),
]


def test_known_pages(spark):
    frame = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in html_extract.extract(frame).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert (out[i]["text"], out[i]["n_chars"]) == (text, len(text))
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_head_without_end_tag():
    body = "<article><h1>Head</h1><p>One &amp; two.</p><p>Three four.</p></article>"
    head = "<html><head><meta charset=utf-8><title>t</title><style>a{}</style><noscript><img src=x></noscript><script>x</script>"
    whole = [b.text for b in html_extract.leaf_blocks(f"{head}</head><body>{body}</body></html>")]
    assert whole == ["Head", "One & two.", "Three four."]
    for page in (f"{head}<body>{body}", f"{head}{body}", f"{head}<noscript><body>{body}", f"{head}<head><body>{body}</body></html>", f"{head}</hed>\n<div>{body}</div>"):
        assert [b.text for b in html_extract.leaf_blocks(page)] == whole
    assert html_extract.main_text(f"{head}<body>{body}", html_extract.extractor()) == html_extract.main_text(f"{head}</head><body>{body}", html_extract.extractor()) == " ".join(whole)
    assert [b.text for b in html_extract.leaf_blocks("<head><title>t</title>Bare text.")] == ["Bare text."]


def test_blocks_are_read_to_their_end():
    filler = " ".join(f"w{i}" for i in range(70))
    for text in (f"{filler} all rights reserved cookies", f"all rights reserved cookies {filler}"):
        (features,) = html_extract.features_of(html_extract.leaf_blocks(f"<p>{text}</p>"))
        assert {"says:rights", "says:reserved", "says:cookies"} <= set(features)


def test_optional_end_tags_long_pages_and_repeated_ids(spark):
    whole = "<html><head><title>t</title></head><body><article><h1>Head</h1><p>One is here.</p><ul><li>first item</li><li>second item</li></ul><p>Two is here.</p></article></body></html>"
    text = "Head One is here. first item second item Two is here."
    cuts = [whole.replace(tag, "", 1) for tag in ("</head>", "</body>", "</html>", "</p>", "</li>", "</head><body>")] + [whole.replace("</li>", "").replace("</p>", "").replace("</head>", "")]
    long = "<html><body><article>" + "".join(f"<p>Paragraph {i} of a very long page, with words in it.</p>" for i in range(30_000)) + "</article><footer>All rights reserved.</footer></body></html>"
    rows = [(i, p) for i, p in enumerate([whole, *cuts])] + [(50, long), (51, "<article><p>" + "word " * 400_000 + "</p></article>"), (7, whole), (7, whole), (None, whole), (None, None)]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    out = html_extract.extract(frame).collect()
    assert len(out) == len(rows)
    assert {r["text"] for r in out if r["page_id"] is not None and r["page_id"] < 50} == {text}
    by_id = {r["page_id"]: r for r in out}
    assert by_id[50]["text"].startswith("Paragraph 0 of") and by_id[50]["text"].endswith("with words in it.") and by_id[50]["text"].count("Paragraph") == 30_000
    assert by_id[51]["n_chars"] == 400_000 * 5 - 1
    assert sorted(r["text"] for r in out if r["page_id"] is None) == ["", text]


def test_held_out_pages():
    chain = html_extract.extractor()
    right = total = 0
    for features, labels in html_extract.training_sequences(200, seed=77):
        found = chain.decode([chain.unary(f) for f in features])
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


# Pages that the generator of training pages hasn't made, labelled by hand.
def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


LINKS = "<ul><li><a href='/a'>News</a></li><li><a href='/b'>Sport</a></li></ul>"
T1, T2, T3 = "The bridge was closed on Monday after cracks were found.","Engineers say that repairs will take two months.","Drivers must use the ferry until then."
HAND = [
    (f"<body><div id='topbar'>{LINKS}</div><div id='content'><h1>Bridge closed</h1>{paragraphs(T1, T2)}<div class='share'><a href='#'>Tweet</a> <a href='#'>Mail</a></div>{paragraphs(T3)}</div><div id='sidebar'><h3>Most read</h3>{LINKS}</div></body>", f"Bridge closed {T1} {T2} {T3}"),
    (f"<body><header><h1>Daily Post</h1><nav>{LINKS}</nav></header><main><h2>Bridge closed</h2>{paragraphs(T1)}<figure><img src=x><figcaption>The bridge in May</figcaption></figure>{paragraphs(T2)}<form><label>Mail</label><input><button>Send</button></form>{paragraphs(T3)}</main><footer><p>Contact us</p></footer></body>", f"Bridge closed {T1} The bridge in May {T2} {T3}"),
    (f"<body><article class='post'><h1>Bridge closed</h1>{paragraphs(T1, T2, T3)}<section id='comments'><h3>3 comments</h3><div class='comment'><p>At last! I told you so.</p></div><div class='comment'><p>What about cyclists?</p></div></section></article></body>", f"Bridge closed {T1} {T2} {T3}"),
    (f"<body><div class='cookie-banner'><p>We use cookies.</p><button>Accept</button></div><article>{paragraphs(T1, T2)}<blockquote><p>It was time.</p></blockquote>{paragraphs(T3)}</article></body>", f"{T1} {T2} It was time. {T3}"),
    (f"<body><article><h1>Bridge closed</h1>{paragraphs(T1)}<div class='advertisement'><p>Buy new boots. Half price this week.</p></div>{paragraphs(T2)}<aside><h4>Background</h4><p>The bridge was built in 1931.</p></aside>{paragraphs(T3)}</article></body>", f"Bridge closed {T1} {T2} {T3}"),
    (f"<body><div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div><div class='entry-content'><h1>Bridge closed</h1>{paragraphs(T1)}<ul><li>Trucks: route 4.</li><li>Cars: ferry.</li></ul>{paragraphs(T2)}</div><div class='related'><h3>Related</h3>{LINKS}</div></body>", f"Bridge closed {T1} Trucks: route 4. Cars: ferry. {T2}"),
    (f"<body><main><article>{paragraphs(T1, T2)}</article><div class='paywall'><p>Log in to read on. The first month is free.</p></div></main><footer>{LINKS}</footer></body>", f"{T1} {T2}"),
    (f"<body><article><h1>Bridge closed</h1>{paragraphs(T1, T2)}</article><div class='comments-area'><ol class='comment-list'><li class='comment'><article><p>Why so late? It was known for years.</p></article></li></ol></div></body>", f"Bridge closed {T1} {T2}"),
    (f"<body><div class='wrapper'><div class='story-body'>{paragraphs(T1)}<div class='newsletter-box'><h4>Our letter</h4><p>All news, each morning.</p></div>{paragraphs(T2, T3)}</div></div></body>", f"{T1} {T2} {T3}"),
    (f"<body><article>{paragraphs(T1)}<h2>Who is affected</h2>{paragraphs(T2)}<table><tr><td>Cars</td><td>2000</td></tr></table>{paragraphs(T3)}</article><nav class='pagination'><a href='/2'>Next</a></nav></body>", f"{T1} Who is affected {T2} Cars 2000 {T3}"),
]


CELLAR = ("<p>Cellars need air. Open the vents in spring, when nights are dry.</p>", "<p>In summer the air outside is warmer than the walls, so keep them shut.</p>")
CELLAR_TEXT = "Keeping a cellar dry Cellars need air. Open the vents in spring, when nights are dry. In summer the air outside is warmer than the walls, so keep them shut."


def test_hand_labelled_pages():
    chain = html_extract.extractor()
    for page, text in HAND:
        assert html_extract.main_text(page, chain) == text


@pytest.mark.parametrize("opened", ["aside", "nav", *[f'div class="{c}"' for c in ("sidebar", "related-posts", "newsletter-signup", "ad-slot", "promo-box", "cookie-notice", "menu")], 'section class="newsletter"'])
def test_what_stands_inside_an_article_goes(opened):
    end = opened.split(" ")[0]
    for extra in ("Read also: ten tips for dry cellars", "Ten tips for dry cellars are in our spring issue. Get it now."):
        page = f"<html><body><header><a href='/'>Home</a></header><article><h1>Keeping a cellar dry</h1>{CELLAR[0]}<{opened}><p>{extra}</p></{end}>{CELLAR[1]}</article><footer>&copy; 2023 House Paper</footer></body></html>"
        assert html_extract.main_text(page, html_extract.extractor()) == CELLAR_TEXT


@pytest.mark.parametrize("name", ["comments", "user-comments", "comment-list", "reader-responses", "disqus_thread"])
def test_reader_comments_go(name):
    for opened, closed in (('<div class="x"><article>', "</article></div>"), ("<main>", "</main>"), ("<article>", "</article>"), ('<div class="x">', "</div>")):
        for before, after in ((f'<div class="{name}">', "</div>"), (f'<section class="{name}"><div class="comment">', "</div></section>")):
            page = f"<html><body><nav><a href='/'>Home</a></nav>{opened}<h1>Keeping a cellar dry</h1>{''.join(CELLAR)}{closed}{before}<p>Thanks, this worked for me. My walls are dry now.</p>{after}<footer>&copy; 2023 House Paper</footer></body></html>"
            assert html_extract.main_text(page, html_extract.extractor()) == CELLAR_TEXT


def test_viterbi_is_the_best_path():
    chain = crf.Chain({}, ((0.4, -0.9), (-1.1, 0.7)), 0.2, 0.0)
    rng = np.random.default_rng(3)
    for n in range(1, 9):
        u = rng.normal(size=n).tolist()

        def score(y):
            return sum(u[i] for i in range(n) if y[i]) + 0.2 * y[0] + sum(chain.step[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023

        best = max(((score(y), y) for y in [[k >> i & 1 for i in range(n)] for k in range(1 << n)]))
        assert score(chain.decode(u)) == pytest.approx(best[0])
    assert chain.decode([]) == []


def test_marginals_add_up():
    rng = np.random.default_rng(1)
    u, on = rng.normal(size=(3, 5)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], dtype=bool)
    step, first = rng.normal(size=(2, 2)), 0.3
    node, edge = crf.marginals(u, step, first, on)
    total_edge = np.zeros((2, 2))
    for s in range(3):
        n = int(on[s].sum())
        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        w = np.array([np.exp(sum(u[s, i] * y[i] for i in range(n)) + first * y[0] + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))) for y in paths])
        w /= w.sum()
        assert np.allclose(node[s, :n], [(w * [y[i] for y in paths]).sum() for i in range(n)])
        for p, y in zip(w, paths, strict=True):
            for a, b in zip(y, y[1:], strict=False):
                total_edge[a, b] += p
    assert np.allclose(edge, total_edge)


def test_sample_pages_parse_into_their_pieces():
    for pieces in page_samples.labelled_pages(30, seed=5):
        assert any(y == 1 for _, y in pieces)


# --- urls -----------------------------------------------------------------------------------------------------------------------------------------


def brute_scores(links, trusted, blocked, rounds=400, d=url_filter.DAMPING):
    hosts = {h for e in links for h in e} | trusted | blocked
    t, q = {h: float(h in trusted) for h in hosts}, {h: float(h in blocked) for h in hosts}
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    for _ in range(rounds):
        t2, q2 = {h: float(h in trusted) for h in hosts}, {h: float(h in blocked) for h in hosts}
        for (a, b), n in links.items():
            t2[b] += d * t[a] * n / out[a]
            q2[a] += d * q[b] * n / into[b]
        t, q = t2, q2
    return t, q


def test_url_filter_equals_brute_force(spark):
    r = random.Random(3)
    hosts = [f"h{i}.{'a.example.net b.org www.example.com'.split()[i % 3]}" for i in range(12)]
    rows, links = [], Counter()
    for i in range(120):
        h = hosts[r.randrange(12)]
        path = r.choice(["/de/1", "/de/8x", "/en/5", "/en/71", "/es/2", "", "/fr"])
        targets = [hosts[r.randrange(12)] for _ in range(r.randint(0, 3))]
        links.update((h, x) for x in targets if x != h)
        tags = [f'<a href="{s}://{x.upper()}/p?q">' if s else f"<a class=x HREF='//{x}#f'>" for x, s in ((x, r.choice(["http", "https", ""])) for x in targets)]
        rows.append((i, f"https://{h.upper() if i % 5 == 0 else h}{path}{r.choice(['', '?x://y', '#t'])}", "".join(tags) + '<a href="/local">'))
    rows += [(300 + i, f"http://bad.org/{p}", "") for i, p in enumerate(["es/1", "es/2", "fr", "it?x"])] + [(310, "http://friend.com/x", "<a href=http://bad.org/>")]
    links["friend.com", "bad.org"] += 1
    rows += [(200, None, None), (201, "no url", "<a href='http://x.org/'>"), (202, "://", ""), (203, "http://", None), (203, "http://", None), (None, "http://H0.a.example.net/de/1", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    out = url_filter.judge(frame).collect()

    def parts(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fit = [x for x, _ in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        return max(fit, key=len, default=None)

    kinds, pages = dict(url_filter.RULES), defaultdict(list)
    for _, u, _ in rows:
        pages[parts(u)[0]].append(kinds.get(rule(*parts(u))))
    n = {h: Counter(x) for h, x in pages.items()}
    trusted = {h for h in n if n[h]["allow"] > n[h]["block"]}
    blocked = {h for h in n if 2 * n[h]["block"] >= len(pages[h]) and n[h]["block"] > n[h]["allow"]}
    t, q = brute_scores(links, trusted, blocked)
    assert len(out) == len(rows) and links
    by_id = defaultdict(list)
    for i, u, _ in rows:
        by_id[i].append(u)
    for x in out:
        host, path = parts(by_id[x["page_id"]][0])
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule(host, path))
        assert (x["trust"], x["distrust"]) == (pytest.approx(t.get(host, 0), abs=1e-6), pytest.approx(q.get(host, 0), abs=1e-6))
        by_host = "block" if q.get(host, 0) >= url_filter.BLOCK_FROM and q.get(host, 0) > t.get(host, 0) else "allow"
        assert x["verdict"] == kinds.get(x["rule"], by_host)
    assert {x["verdict"] for x in out if x["rule"] is None} == {"allow", "block"}
    assert url_filter.judge(frame.limit(0)).count() == 0
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    assert Counter(db.execute(url_filter.oracle_op3()).fetchall()) == Counter(tuple(x) for x in out)


def test_distrust_reaches_the_end_of_a_chain(spark):
    rows = [(0, "http://bad.org/es/1", None)] + [(i, f"http://h{i}.com/", f"<a href='http://{'bad.org' if i == 1 else f'h{i - 1}.com'}/'>") for i in range(1, 31)]
    out = {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(31):
        assert out[i]["distrust"] == pytest.approx(0.85**i, abs=1e-6)
        assert out[i]["verdict"] == ("block" if i <= 14 else "allow")


def test_hubs_are_divided_and_cycles_settle(spark):
    r = random.Random(9)
    pairs = Counter((f"h{r.randrange(40)}", f"h{r.randrange(40)}") for _ in range(300))
    pairs.update({("hub", f"h{i}"): 1 + i % 3 for i in range(40)})
    pairs.update({(f"h{i}", "hub"): 1 for i in range(0, 40, 2)})
    pairs = {k: n for k, n in pairs.items() if k[0] != k[1]}
    trusted, blocked = {"h1", "hub"}, {"h2", "h3", "alone"}
    links = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "source string, target string, n long")
    seeds = spark.createDataFrame([(h, int(h in trusted), int(h in blocked)) for h in sorted(trusted | blocked | {"h9"})], "host string, trusted int, blocked int")
    t, q = brute_scores(pairs, trusted, blocked)
    for hub in (url_filter.HUB, 7):
        found = {x["host"]: (x["trust"], x["distrust"]) for x in url_filter.propagate(links, seeds, tolerance=1e-4, hub=hub).collect()}
        assert set(found) == {h for h in t if t[h] or q[h]}
        assert all(found[h] == (pytest.approx(t[h], abs=1e-3), pytest.approx(q[h], abs=1e-3)) for h in found)


# --- archives ---------------------------------------------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    big = "é<p>" * 3000
    pages = [(1, "http://a", big), (2, "http://b", big), (3, None, "short"), (4, "http://d", "short"), (5, "http://e\r\nX: y", None), (6, "u", ""), (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 9), (None, "u", "n" * 100), (8, "u", "n" * 100), (9, "u", "é" * 50), (9, "u", "z" * 5000), (10, "u", "z" * 5000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    for compress in (True, False):
        path = str(tmp_path / f"w{compress}")
        warc.write_archive(frame, path, segment=1000, compress=compress)
        records = warc.read_records(spark, path)
        assert records.filter("kind = 'continuation'").count() > 10
        out = warc.payloads(warc.reassembled(records)).collect()
        assert Counter(r["payload_digest"] for r in out) == Counter(hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in pages)
        sizes = {hashlib.sha256((h or "").encode()).hexdigest(): len((h or "").encode()) for _, _, h in pages}
        assert all(r["payload_bytes"] == sizes[r["payload_digest"]] for r in out)
        bodies = {bytes(r["payload"]) for r in out if r["kind"] == "response"}
        assert bodies == {(h or "").encode() for _, _, h in pages}
        revisits = {r["record_id"].split(":")[2].split(".")[0]: r["refers_to"].split(":")[2].split(".")[0] for r in out if r["kind"] == "revisit"}
        assert revisits == {"2": "1", "8": "null", "10": "9"}
        # a lost piece shows
        broken = warc.payloads(warc.reassembled(records.filter("number IS NULL OR number <> 3"))).filter("status = 'broken'")
        assert broken.count() == 2 and broken.filter("payload IS NOT NULL").count() == 0
    empty = str(tmp_path / "none")
    warc.write_archive(frame.limit(0), empty)
    assert warc.payloads(warc.reassembled(warc.read_records(spark, empty))).count() == 0


def test_chunked_framing():
    for size in (1, 3, 8192):
        for body in (b"", b"a", b"0\r\n\r\n", bytes(range(256)) * 50):
            assert warc.unchunked(warc.chunked(body, size)) == body
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab")


# --- licenses -----------------------------------------------------------------------------------------------------------------------------------------


def test_license_scan_equals_brute_force(spark, odd):
    lines = ["Released under the MIT License.", "see the MIT-license, apache  LICENSE; mit license", "licensed under CC BY NC 4 0 or so", "This program is free software you can redistribute it and or modify it under the terms", "GNU general public license general public license", "all mit", "mitlicense mit licenses"]
    r = random.Random(1)
    rows = odd + [(300 + i, "\n".join(r.choice([*lines, *(t for t in some_texts(5, i))]) for _ in range(r.randint(1, 5))), "l") for i in range(60)]
    out = licenses.scan_windows(documents(spark, rows)).collect()
    sets = [(label, set(licenses.template_tokens(t)), set(licenses.own_words(label, t)), licenses.window_words(t)) for label, t in licenses.TEMPLATES]

    def brute(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split(licenses.SEPARATOR, low) if w]
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        base = {label for _, label in places}
        found, best = set(), 0.0
        for label, template, own, width in sets:
            for i in range(len(words)):
                tokens = set(words[i : i + width])
                share = len(tokens & template) / len(template)
                if own <= tokens and len(tokens & template) >= licenses.needed(len(template), licenses.THRESHOLD):
                    found.add(label)
                    best = max(best, share)
        first, last = min((i for i, _ in places), default=None), max((i for i, _ in places), default=None)
        return len(words), len(places), first, last, sorted(base), sorted(base | found), 1.0 if base else round(best, 9)

    expected = Counter(repr((d, *brute(t))) for d, t, _ in rows)
    got = Counter(repr((x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], round(x["score"], 9))) for x in out)
    assert got == expected
    assert sum("cc-by-nc" in x["labels"] for x in out) > 0


def test_licenses_that_share_most_words_are_told_apart(spark):
    rows = [
        (1, "Licensed under CC BY-SA 4.0", ["cc-by-sa"]),
        (2, "Licensed under CC BY-NC 4.0", ["cc-by-nc"]),
        (3, "This file is licensed under the GNU General Public License.", ["gpl"]),
        (4, "It is licensed under the GNU Lesser General Public License.", ["gpl", "lgpl"]),  # gpl by the base phrase
        (5, "Released under the BSD License", []),
        (6, "Licensed under the Foo License, Version 2.0", []),
        (7, "This Source Code Form is subject to the terms of the Foo Public License, v. 2.0", []),
        (8, "Distributed under the MIT License; parts are licensed under CC BY-SA 4.0", ["cc-by-sa", "mit"]),
    ]
    out = {x["doc_id"]: x["labels"] for x in licenses.scan_windows(documents(spark, [(i, t, "l") for i, t, _ in rows])).collect()}
    assert out == {i: labels for i, _, labels in rows}
