"""Whitening, conversation repair and media archives against brute force, on odd and empty tables too."""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import conversations as cv
from lexmill.llm import media, registry, whitening

DATA = "/root/testdata/sf0.001"


# --- whitening -----------------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return frame.select("*", *[F.lit(c).alias(c) for c in ("key", "x", "n", "component", "whitened")])


def check_whitening(rows, out, model, components=16):
    """Everything about whitened rows, from their definition."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in fit])
    values, turns = np.linalg.eigh(centred.T @ centred / n)
    values, turns = values[::-1][:components], turns[:, ::-1][:, :components]
    assert model.n == n and np.allclose(model.values, values[: len(model.values)], rtol=1e-9)
    assert model.trace == pytest.approx((centred**2).sum() / n, rel=1e-12)
    k = len(model.values)
    assert np.allclose(np.abs((model.vectors * turns[:, :k]).sum(axis=0)), 1, atol=1e-8) and model.identity_error < 1e-9
    expected = defaultdict(list)
    for i, x in kept:
        z = [n * v - s for v, s in zip(x, sums, strict=True)]
        expected[i].append((sum(v * v for v in z), np.abs((np.array(z, dtype=float) / n) @ turns[:, :k] / np.sqrt(values[:k]))))
    assert len(out) == len(kept)
    for r in out:
        assert any(r["deviation"] == d and np.allclose(np.abs(r["whitened"]), w, atol=1e-6) for d, w in expected[r["vec_id"]])


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(1)
    spread = np.array([9, 7, 5, 4, 3.5, 3, *([0.4] * 24)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((300, 30)) * spread)]
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[1][1]), (1001, None), (1002, [None, *rows[2][1][1:]]), (1003, [float("nan"), *rows[2][1][1:]]), (1004, [float("inf"), *rows[2][1][1:]]), (1005, [0.0] * 30), (1006, [-0.0] * 30)]
    for components in (6, 16):
        out, model = whitening.whitened(vectors(spark, rows), components=components)
        check_whitening(rows, out.collect(), model, components)
    # separate variances are found by the random block, close ones need the full dimension
    assert whitening.fit_whitening(spark.createDataFrame([([int(x) for x in v],) for v in r.standard_normal((400, 40)) * np.array([9000, 3000, 900, *([0.0] * 37)])], "x array<long>"), 3).full is False
    assert model.full


def test_whitening_of_odd_tables(spark):
    one = [(i, [1.0, 2.0, 3.0]) for i in range(5)]
    for rows in ([], [(1, None)], one, [(1, [])]):
        out, model = whitening.whitened(vectors(spark, rows))
        assert out.count() == 0 and model is None
    flat = [(i, [float(i), 2.0 * i, 5.0, float(i % 2)]) for i in range(9)]
    out, model = whitening.whitened(vectors(spark, flat))
    assert len(model.values) == 2
    check_whitening(flat, out.collect(), model)
    uneven = [(0, [1.0]), (1, [2.0, 3.0]), (2, [4.0, 1.0]), (3, [])]
    out, model = whitening.whitened(vectors(spark, uneven))
    check_whitening([(i, (v + [0.0, 0.0])[:2]) for i, v in uneven], out.collect(), model)
    large = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3.0, 3.0])]
    out, model = whitening.whitened(vectors(spark, large))
    assert model.n == 3 and sorted(r["deviation"] is None for r in out.collect()) == [False, True, True]


def test_whitening_query(spark):
    out = registry.QUERIES["op11_whitened_embeddings"](spark, DATA)
    rows = out.collect()
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(rows) == 16 * 500 and {r["component"] for r in rows} == set(range(1, 17)) and rows[0]["identity_error"] < 1e-4
    shares = sorted({(r["component"], r["explained"]) for r in rows})
    assert len(shares) == 16 and [s for _, s in shares] == sorted((s for _, s in shares), reverse=True)


# --- conversations -------------------------------------------------------------------------------------------------------------------


def brute_repair(rows, gap=3):
    """Least (cost, audit) by trying all edits, with up to `gap` inserts between rows."""
    grammar = re.compile(r"(?:s?(?:ua)+)?\Z")
    options = []
    for initial, fault in rows:
        own = [("D", "", 2)]
        if fault in ("", "truncated"):
            extra = 5 if fault else 0
            own += [("K", initial or "?", extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append(own)
    inserts = [("I" * len(c), "".join(c), 5 * len(c)) for n in range(gap + 1) for c in itertools.product("ua", repeat=n)]
    best = None
    slots = [inserts, *itertools.chain.from_iterable((o, inserts) for o in options)]
    for choice in itertools.product(*slots):
        if best is not None and sum(c[2] for c in choice) > best[0]:
            continue
        if grammar.match("".join(c[1] for c in choice)):
            found = (sum(c[2] for c in choice), "".join(c[0] for c in choice))
            best = found if best is None or found < best else best
    return best


def test_audits_equal_brute_force():
    r = random.Random(2)
    kinds = ["", "", "", "truncated", "blank", "duplicate"]
    for n in range(4):
        for _ in range(60 if n < 3 else 25):
            rows = [(r.choice(["u", "a", "s", "t", "", " "]), r.choice(kinds)) for _ in range(n)]
            assert cv.repair_audit(rows) == brute_repair(rows, 2), rows


def test_long_conversations_settle(monkeypatch):
    r = random.Random(3)
    for _ in range(40):
        rows = [(r.choice("uuuaaas"), r.choice(["", "", "", "", "truncated", "blank"])) for _ in range(r.randint(0, 120))]
        monkeypatch.setattr(cv, "SETTLE", 10**9)
        whole = cv.repair_audit(rows)
        monkeypatch.setattr(cv, "SETTLE", 2)
        assert cv.repair_audit(rows) == whole
        said = [({"u": "user", "a": "assistant", "s": "system"}[i], f"t{n}") for n, (i, _) in enumerate(rows)]
        assert re.fullmatch("(?:s?(?:ua)+)?", "".join(role[0] for role, _ in cv.replay(said, whole[1])))
    monkeypatch.undo()
    assert cv.repair_audit([("s", "")] + [("ua"[i % 2], "") for i in range(100_000)]) == (0, "K" * 100_001)


def brute_conversations(rows):
    """The query's rows, from the contract."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faults = []
        for i, (_, role, text) in enumerate(own):
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in [(x[1], x[2]) for x in own[:i]] else "truncated" if body[-1] not in ".!?" else "")
        turns = [x[0] for x in own if x[0] is not None]
        initials = [x[1][:1] for x in own]
        cost, audit = cv.repair_audit(list(zip(initials, faults, strict=True)))
        lines = "\n".join(f"{r}:{t}" for r, t in cv.replay([x[1:] for x in own], audit))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark, tmp_path):
    r = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Why?", "Right!", "a. b", "é。", " \t\n", "", None, "long " * 50_000 + "end."]
    rows = [(c, r.choice([None, *range(8)]), r.choice(roles[:2] * 4 + roles), f"{r.choice(texts) or ''}{r.randrange(30)}." if r.random() < 0.6 else r.choice(texts)) for c in [*range(200), None] for _ in range(r.randint(1, 9))]
    rows += rows[:5] + [(900, t, "user", "Same.") for t in range(300)] + [(901, None, "user", "Hello."), (901, None, "assistant", "Hi.")]
    dropped = next(c for c in range(2000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(7) for c in ("copies", "damage_", "audit")})
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    query = registry.QUERIES["op12_repair_conversations"]
    out = query(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {x["conv_id"]: tuple(x)[1:] for x in out.collect()}
    assert got == brute_conversations(rows) and len(got) == out.count()
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    frame.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert query(spark, f"{tmp_path}/none").count() == 0
    real = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert {x["conv_id"]: tuple(x)[1:] for x in query(spark, DATA).collect()} == brute_conversations([tuple(x) for x in real.select("conv_id", "turn", "role", "text").collect()])


def test_repair_keeps_good_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (2, 0, "assistant", "Hi."), (2, 1, "user", "Bye.")]
    out = {x["conv_id"]: x for x in cv.repair(spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")).collect()}
    assert (out[1]["cost"], out[1]["audit"], len(out[1]["messages"])) == (0, "KKK", 3)
    assert (out[2]["cost"], out[2]["audit"], [m["role"] for m in out[2]["messages"]]) == (2, "RR", ["user", "assistant"])


# --- media ---------------------------------------------------------------------------------------------------------------------------


def brute_media(text):
    """What the query says of a text, but for the feature; the image is decoded by the format's definition."""
    content = (text or "").encode()
    payload = content + bytes(64 if not content else -len(content) % 64)
    return {"n_bytes": len(content), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}


def test_images_round_trip():
    for content in (b"", b"a", bytes(64), bytes(range(256)) * 3, b"x" * 129, bytes(np.random.default_rng(0).integers(0, 256, 3 << 20, dtype=np.uint8))):
        image = media.encode_image(content)
        samples, length = media.decode_image(image)
        assert samples == media.padded(content) and length == len(content) and len(samples) % 64 == 0 and len(samples) > 0
        assert struct.unpack(">2I", image[16:24]) == (64, len(samples) // 64)
        assert media.feature(samples).startswith(f"lines={len(samples) // 64};mean={np.frombuffer(samples, dtype=np.uint8).mean():.4f};")
    with pytest.raises(ValueError):
        media.decode_image(image[:-20] + b"x" + image[-19:])


class Flaky(io.BytesIO):
    """An archive whose reads fail at times, or at given places always."""

    def __init__(self, data, chance, r, broken=()):
        super().__init__(data)
        self.chance, self.r, self.broken = chance, r, broken

    def read(self, *size):
        if self.r.random() < self.chance or any(self.tell() <= b < self.tell() + (size[0] if size and size[0] and size[0] > 0 else 1 << 60) for b in self.broken):
            raise OSError("lost the connection")
        return super().read(*size)


def archive_of(contents, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for i, c in enumerate(contents):
            z.writestr(media.member_name(i, f"k{i}", ".bin"), c)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_ranges_take_each_member_once(method):
    r = random.Random(5)
    contents = [r.randbytes(r.choice([0, 1, 50, 3000])) for _ in range(60)]
    data = archive_of(contents, method)
    for size in (1, 100, 5000, 10**9):
        ranges = media.byte_ranges([("a.zip", len(data))], size) if size > 1 else media.byte_ranges([("a.zip", len(data))], 997)
        for piece in (1, 4000, 10**9):
            found = [x for p in ranges for run in media.read_range(lambda: io.BytesIO(data), p.start, p.end, piece=piece) for x in run]
            assert [(media.key_of(m.filename, ".bin"), c, e) for m, c, e in found] == [(f"k{i}", c, None) for i, c in enumerate(contents)]


def test_members_are_read_again_on_their_own():
    r = random.Random(6)
    contents = [r.randbytes(200) for _ in range(80)]
    data = archive_of(contents)
    found = [x for run in media.read_range(lambda: Flaky(data, 0.02, r), 0, len(data), tries=60, pause=0, piece=1000) for x in run]
    assert [c for _, c, _ in found] == contents
    # one member that can't be read leaves the others alone
    at = zipfile.ZipFile(io.BytesIO(data)).infolist()[7].header_offset + 60
    found = [x for run in media.read_range(lambda: Flaky(data, 0, r, [at]), 0, at + 3000, tries=3, pause=0, piece=2000) for x in run]
    assert [m.header_offset for m, c, _ in found if c is None] == [zipfile.ZipFile(io.BytesIO(data)).infolist()[7].header_offset]
    # nor does one whose bytes are wrong
    bad = bytearray(data)
    bad[at] ^= 1
    found = [x for run in media.read_range(lambda: io.BytesIO(bytes(bad)), 0, len(data), tries=3, pause=0) for x in run]
    assert [i for i, (_, c, e) in enumerate(found) if e] == [7] and all(c == contents[i] for i, (_, c, _) in enumerate(found) if i != 7)


def test_archives_of_any_size(spark, tmp_path):
    rows = [(None, b"null key"), ("", b"empty key"), ("a/b é.png", b"x" * 5000), ("same", b"1"), ("same", b"2"), ("none", None)] + [(f"{i}", bytes([i % 256]) * i) for i in range(400)]
    frame = spark.createDataFrame(rows, "key string, media binary").withColumns({"archive": F.lit(1), "offset": F.lit(2)}).repartition(4)
    expected = Counter((k, bytes(m or b"")) for k, m in rows)
    for i, (archive, size) in enumerate(((1 << 30, 1 << 30), (9000, 4096))):
        folder = f"file://{tmp_path}/a{i}"
        media.write_media(frame, folder, ".bin", archive)
        listed = json.loads((tmp_path / f"a{i}" / media.MANIFEST).read_text())
        assert (len(listed) > 8) == (archive == 9000)
        # what an attempt left that wasn't committed isn't read
        (tmp_path / f"a{i}" / "part-lost.zip").write_bytes(b"PK half an archive")
        out = media.read_media(spark, folder, ".bin", size)
        assert Counter((r["key"], bytes(r["media"])) for r in out.collect()) == expected
    media.write_media(frame.limit(0), f"file://{tmp_path}/none")
    assert media.read_media(spark, f"file://{tmp_path}/none").count() == 0
    # archives that other tools made, one of them damaged
    (tmp_path / "own" / "sub").mkdir(parents=True)
    data = archive_of([b"first", b"second", b"third"])
    (tmp_path / "own" / "sub" / "x.zip").write_bytes(data)
    assert [bytes(r["media"]) for r in media.read_media(spark, str(tmp_path / "own")).orderBy("offset").collect()] == [b"first", b"second", b"third"]
    (tmp_path / "own" / "sub" / "x.zip").write_bytes(data.replace(b"second", b"sEcond"))
    kept = media.read_media(spark, str(tmp_path / "own"), keep_broken=True).orderBy("offset").collect()
    assert [r["media"] and bytes(r["media"]) for r in kept] == [b"first", None, b"third"] and "damaged" in kept[1]["error"]
    with pytest.raises(Exception, match="damaged"):
        media.read_media(spark, str(tmp_path / "own")).collect()


def test_media_query_equals_brute_force(spark, tmp_path):
    texts = [(1, "é" * 100), (2, None), (3, ""), (None, "no id"), (4, "long " * 300_000), (5, "é" * 100), (5, "é" * 100), (6, "x" * 64), (7, "\x00"), (8, " \n")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("key", "media", "n_bytes")}).repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    query = registry.QUERIES["op13_media_archive"]
    out = query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = out.collect()
    expected = Counter((d, *brute_media(t).values(), len(image), hashlib.sha256(image).hexdigest(), media.feature(media.padded((t or "").encode()))) for d, t in texts for image in [media.encode_image((t or "").encode())])
    assert Counter(tuple(r) for r in rows) == expected
    by_payload = defaultdict(set)
    for r in rows:
        by_payload[r["n_bytes"], r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert query(spark, f"{tmp_path}/none").count() == 0
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in query(spark, DATA).collect())
    assert got == Counter((r["doc_id"], *brute_media(r["text"]).values()) for r in real)
