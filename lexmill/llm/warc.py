r"""WARC archives with segmented records (operator 8).

Writing. A record's block is an HTTP message whose body is the page in chunked transfer framing. Of equal payloads of at least
REVISIT_BYTES bytes, the row with the smallest id is a response; the others are revisits that name it. A block of over `segment`
bytes is cut: the first piece is the response with WARC-Segment-Number 1, each further piece a continuation record with the
first one's id as WARC-Segment-Origin-ID, and the last one states WARC-Segment-Total-Length. Each file begins with a warcinfo record. Spark's text writer writes the records: a record ends
with CR LF and the writer's line end is CR LF too, so the files are plain WARC files, each written by one task and committed
by Spark (in gzip if asked for: one stream for a file, not one for each record).

Reading. Each file is parsed record by record by Content-Length. Records of one piece are decoded at once; pieces are grouped
by origin id, ordered by segment number, checked for gaps and against the total length, and decoded. A group is one
page's pieces, so its size is that page's. A record that can't be put together has status `broken` and no payload.

Results for odd input: null text is an empty payload, null and repeated ids are rows like any other (a null id is smallest),
rows equal in id and payload get a record of the same type each, an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, checkpointed, few, table, text_or_empty

REVISIT_BYTES = 100
#: Bytes of a block in one record, and of a body in one chunk of the transfer framing.
SEGMENT = 1 << 15
CHUNK = 1 << 13
#: Records in a file, so that a file of full segments is at most 64 MB.
RECORDS_IN_FILE = 2048
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record, but for the last CR LF (the writer's line end)."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body inside chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk without its end")
        out.append(framed[at : at + size])
        at += size + 2


def page_records(key: str, url: str, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page. key: names the record, refers_to: the response's key for a revisit."""
    about = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [record("revisit", [("WARC-Record-ID", f"<urn:page:{key}>"), *about, profile, ("WARC-Refers-To", f"<urn:page:{refers_to}>")], head)]
    about.append(("Content-Type", "application/http;msgtype=response"))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record("response", [("WARC-Record-ID", f"<urn:page:{key}>"), *about], block)]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record("response", [("WARC-Record-ID", f"<urn:page:{key}>"), *about, ("WARC-Segment-Number", "1")], pieces[0])]
    for n, piece in enumerate(pieces[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(pieces) else []
        out.append(record("continuation", [("WARC-Record-ID", f"<urn:page:{key}:{n}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{key}>"), ("WARC-Segment-Number", str(n)), *total], piece))
    return out


def file_head(name: str) -> bytes:
    """The warcinfo record that a file begins with."""
    return record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("Content-Type", "application/warc-fields")], b"software: lexmill\r\nformat: WARC File Format 1.1\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def with_responses(pages: DataFrame, id_column: str, least: int) -> DataFrame:
    """Add key (names the row), digest and response_key (null for responses) to the id, url and payload of pages.

    Payloads are read and hashed twice, which moves none of them between tasks; only repeated digests are joined.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col("url").alias("url"), text_or_empty("html").cast("binary").alias("payload"))
    number = F.monotonically_increasing_id().cast("string")
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes"), F.concat_ws(".", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), number).alias("key"))
    first = F.min(F.struct("page_id", "key")).alias("first")
    repeated = checkpointed(rows.filter(F.col("bytes") >= least).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1"))
    named = few(repeated.select(F.col("digest").alias("digest_"), F.col("first.page_id").alias("first_id"), F.col("first.key").alias("first_key")), repeated.count())
    joined = rows.join(named, (F.col("digest") == F.col("digest_")) & (F.col("bytes") >= least), "left")
    return joined.withColumn("response_key", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_key")))


def write_archive(pages: DataFrame, path: str, id_column: str = "page_id", least: int = REVISIT_BYTES, segment: int = SEGMENT, compress: bool = True) -> None:
    """Write a record for each row of pages (id, url, html) to WARC files under path."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made = []
                for r in batch.slice(at, 64).to_pylist():
                    for x in page_records(r["key"], (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A"), r["payload"], r["digest"], r["response_key"], segment):
                        if written % RECORDS_IN_FILE == 0:  # the writer begins a new file here
                            made.append(file_head(f"{r['key']}.{written}"))
                            written += 1
                        made.append(x)
                        written += 1
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    ready = with_responses(pages, id_column, least).select("key", "url", "payload", "digest", "response_key")
    records = ready.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    out = records.write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_IN_FILE)
    (out.option("compression", "gzip") if compress else out).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records under path: one row each, with the headers that reassembly needs and the block."""
    names = ["kind", "record_id", "origin", "number", "total", "digest", "url", "refers_to"]
    wire = ["warc-type", "warc-record-id", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length", "warc-payload-digest", "warc-target-uri", "warc-refers-to"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                held: list[tuple[dict[str, str], bytes]] = []
                for found in parse(data):
                    held.append(found)
                    if len(held) == 128:
                        yield as_batch(held)
                        held = []
                if held:
                    yield as_batch(held)

    def as_batch(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
        columns = [pa.array([h.get(w) for h, _ in rows], pa.string()) for w in wire]
        return pa.RecordBatch.from_arrays([*columns, pa.array([b for _, b in rows], pa.binary())], names=[*names, "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    schema = ", ".join([f"{n} string" for n in names] + ["block binary"])
    return files.mapInArrow(split, schema).withColumns({c: F.col(c).cast("long") for c in ("number", "total")})


def reassembled(records: DataFrame) -> DataFrame:
    """One row for each page: kind, record_id, digest, url, refers_to and block; block is null if pieces or bytes are missing."""
    whole = records.filter("number IS NULL AND kind <> 'warcinfo'").select("kind", "record_id", "digest", "url", "refers_to", "block")
    pieces = records.filter("number IS NOT NULL").withColumn("of", F.coalesce("origin", "record_id"))
    grouped = pieces.groupBy("of").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("kind", "digest", "url", "refers_to")],
    )
    block = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["block"]))
    complete = F.transform("parts", lambda x: x["number"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    joined = grouped.withColumn("block", block).withColumn("block", F.when(complete & (F.octet_length("block") == F.col("total")), F.col("block")))
    return whole.unionByName(joined.select(F.coalesce("kind", F.lit("response")).alias("kind"), F.col("of").alias("record_id"), "digest", "url", "refers_to", "block"))


def payloads(pages: DataFrame) -> DataFrame:
    """Add payload, payload_bytes, payload_digest and status (whole, revisit or broken) to reassembled pages."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [body(k, b) for k, b in zip(part.column("kind").to_pylist(), part.column("block").to_pylist(), strict=True)]
                digests = [hashlib.sha256(p).hexdigest() if p is not None else (d or "").removeprefix("sha256:") or None for (p, _, _), d in zip(rows, part.column("digest").to_pylist(), strict=True)]
                columns = [part.column(c) for c in ("kind", "record_id", "url", "refers_to")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array(digests, pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["kind", "record_id", "url", "refers_to", "payload", "payload_bytes", "payload_digest", "status"],
                )

    return pages.mapInArrow(decode, "kind string, record_id string, url string, refers_to string, payload binary, payload_bytes long, payload_digest string, status string")


def body(kind: str, block: bytes | None) -> tuple[bytes | None, int | None, str]:
    """Payload, its length and the status, from the HTTP message in a record."""
    if block is None:
        return None, None, "broken"
    head, _, rest = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    if kind == "revisit":
        return None, int(fields[b"content-length"]) if b"content-length" in fields else None, "revisit"
    try:
        found = unchunked(rest) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else rest
    except ValueError:
        return None, None, "broken"
    return found, len(found), "whole"


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster's machines share."""
    return f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"


def op8_segmented_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive_folder(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    found = payloads(reassembled(read_records(spark, path)))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)\.", 1).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


ORACLE_OP8 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= {REVISIT_BYTES} GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND n >= {REVISIT_BYTES}
"""
