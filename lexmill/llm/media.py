"""Media columns (operator 13): binary members in archives, read by a data source of their own.

The source "media_archive" writes rows (key, media) as ZIP archives, and reads a folder of archives. Planning looks at no member: it
deals out ranges of bytes of each archive, and a task takes the members whose headers lie in its range from the archive's own
directory. A range is read a few MB at a time, each piece a batch of Arrow; a member that doesn't come through whole (length and
CRC-32 of the directory) is read again by its offset, alone, so its neighbours need no second read. What stays broken stops the
read, or with option onerror=keep is a row with an error and no media.

Writing survives lost tasks: each attempt writes archives under names of its own, and only those that the commit lists are read.

Texts become grey images (PNG, 64 samples of 8 bits a line), whose samples are the text's UTF-8 bytes and zeros up to a whole line.

Results for odd input: null and empty texts are one line of zeros; null keys stay null, equal keys are kept apart; texts of any
length are one image; empty tables give an archive folder without members; further columns are left out.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import checkpoint_folder, table, text_or_empty

#: An archive is closed when it has so many bytes; a task may write several.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive that one task reads.
RANGE_BYTES = 32 << 20
#: Bytes that are read at once and make one batch.
PIECE_BYTES = 4 << 20
#: How often a member is read before it counts as broken, and the seconds before the second try (twice as many before each further one).
TRIES = 4
PAUSE = 0.2

MANIFEST = "_archives.json"
SCHEMA = "key string, media binary, archive string, offset long, error string"
LOCAL_HEADER = struct.Struct("<4s5H3I2H")


# --- archives ------------------------------------------------------------------------------------------------------------------------


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


def byte_ranges(archives: Sequence[tuple[str, int]], size: int) -> list[Range]:
    """Ranges of at most `size` bytes that cover each archive (name, bytes)."""
    return [Range(name, at, min(at + size, length)) for name, length in archives for at in range(0, length, size)]


def directory(archive) -> list[zipfile.ZipInfo]:
    """The members of an open archive in the order of their offsets."""
    return sorted(zipfile.ZipFile(archive).infolist(), key=lambda m: m.header_offset)


def member_in(data: bytes, at: int, member: zipfile.ZipInfo) -> bytes:
    """A member's content, whose header begins at data[at]; OSError if it isn't whole."""
    try:
        mark, *_, name, extra = LOCAL_HEADER.unpack_from(data, at)
        begin = at + LOCAL_HEADER.size + name + extra
        body = bytes(data[begin : begin + member.compress_size])
        if member.compress_type == zipfile.ZIP_DEFLATED:
            body = zlib.decompress(body, -15)
    except (struct.error, zlib.error) as e:
        raise OSError(f"{member.filename} is cut or damaged: {e}") from e
    if mark != b"PK\x03\x04" or len(body) != member.file_size or zlib.crc32(body) != member.CRC:
        raise OSError(f"{member.filename} is cut or damaged")
    return body


def pieces(members: Sequence[tuple[zipfile.ZipInfo, int]], size: int) -> Iterator[list[tuple[zipfile.ZipInfo, int]]]:
    """Members (with the offset at which each ends) in runs of about `size` bytes."""
    held: list[tuple[zipfile.ZipInfo, int]] = []
    for member in members:
        if held and member[1] - held[0][0].header_offset > size:
            yield held
            held = []
        held.append(member)
    if held:
        yield held


def read_range(opened: Callable[[], object], start: int, end: int, tries: int = TRIES, pause: float = PAUSE, piece: int = PIECE_BYTES) -> Iterator[list[tuple[zipfile.ZipInfo, bytes | None, str | None]]]:
    """(member, content, error) of the members whose headers lie in [start, end), a list for each piece that is read.

    `opened` opens the archive; it is called again for each new try, so that a connection which broke is left behind.
    """

    def again(f: Callable, times: int):
        for i in range(times):
            try:
                with opened() as archive:
                    return f(archive)
            except (OSError, zipfile.BadZipFile):
                if i + 1 == times:
                    raise
                time.sleep(pause * 2**i)

    def span(begin: int, until: int) -> bytes:
        def take(archive) -> bytes:
            archive.seek(begin)
            return archive.read(until - begin)

        return again(take, 1)

    def listed(archive) -> tuple[list[zipfile.ZipInfo], int]:
        members = zipfile.ZipFile(archive)
        return sorted(members.infolist(), key=lambda m: m.header_offset), members.start_dir

    found, stop = again(listed, tries)
    ends = [m.header_offset for m in found[1:]] + [stop]
    mine = [(m, e) for m, e in zip(found, ends, strict=True) if start <= m.header_offset < end]
    for run in pieces(mine, piece):
        begin = run[0][0].header_offset
        try:
            data = span(begin, run[-1][1])
        except OSError:
            data = b""
        out = []
        for member, until in run:
            content, error = None, None
            try:
                content = member_in(data, member.header_offset - begin, member)
            except OSError:
                try:
                    content = again(lambda archive, m=member, u=until: (archive.seek(m.header_offset), member_in(archive.read(u - m.header_offset), 0, m))[1], tries - 1)
                except OSError as e:
                    error = str(e)
            out.append((member, content, error))
        yield out


def member_name(number: int, key: str | None, suffix: str) -> str:
    """A name that no other member of the archive has and that holds the key; a null key has no second part."""
    return f"{number:010d}" if key is None else f"{number:010d}/{quote(key, safe='')}{suffix}"


def key_of(name: str, suffix: str) -> str | None:
    return unquote(name.partition("/")[2].removesuffix(suffix)) if "/" in name else None


class MediaArchive(DataSource):
    """Format "media_archive": load(folder) and save(folder), with options suffix (of member names), rangebytes, archivebytes, onerror."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options, schema.names)


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.size, self.keep = int(options.get("rangebytes", RANGE_BYTES)), options.get("onerror", "fail") == "keep"

    def partitions(self) -> Sequence[InputPartition]:
        fs, folder = file_system(self.folder)
        manifest = fs.get_file_info(f"{folder}/{MANIFEST}")
        if manifest.type == pafs.FileType.File:
            archives = json.loads(fs.open_input_file(manifest.path).read())
        else:
            found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
            archives = sorted((f.path[len(folder) + 1 :], f.size) for f in found if f.path.endswith(".zip"))
        return byte_ranges([tuple(a) for a in archives], self.size) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, folder = file_system(self.folder)
        for out in read_range(lambda: fs.open_input_file(f"{folder}/{partition.archive}"), partition.start, partition.end):
            for member, _, error in out:
                if error and not self.keep:
                    raise OSError(f"{partition.archive} at {member.header_offset}: {error}")
            arrays = [
                pa.array([key_of(m.filename, self.suffix) for m, _, _ in out], pa.string()),
                pa.array([content for _, content, _ in out], pa.binary()),
                pa.array([partition.archive] * len(out), pa.string()),
                pa.array([m.header_offset for m, _, _ in out], pa.int64()),
                pa.array([error for _, _, error in out], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "media", "archive", "offset", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: Sequence[str]) -> None:
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.most, self.columns = int(options.get("archivebytes", ARCHIVE_BYTES)), list(columns)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        rows = ((k, m) for batch in iterator for k, m in zip(batch.column(self.columns.index("key")).to_pylist(), batch.column(self.columns.index("media")).to_pylist(), strict=True))
        row = next(rows, None)
        while row is not None:
            name = f"part-{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{folder}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    number = 0
                    while row is not None and out.tell() < self.most:
                        archive.writestr(zipfile.ZipInfo(member_name(number, row[0], self.suffix)), row[1] or b"")
                        number, row = number + 1, next(rows, None)
                length = out.tell()
            done.append((name, length))
        return Written(done)

    def commit(self, messages) -> None:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        listed = sorted(a for m in messages if m is not None for a in m.archives)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        fs, folder = file_system(self.folder)
        for name, _ in (a for m in messages if m is not None for a in m.archives):
            fs.delete_file(f"{folder}/{name}")


def write_media(rows: DataFrame, folder: str, suffix: str = "", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write (key, media) as archives in a folder that all machines share."""
    rows.sparkSession.dataSource.register(MediaArchive)
    rows.select(F.col("key").cast("string").alias("key"), F.col("media").cast("binary").alias("media")).write.format("media_archive").mode("append").options(suffix=suffix, archivebytes=archive_bytes).save(folder)


def read_media(spark: SparkSession, folder: str, suffix: str = "", range_bytes: int = RANGE_BYTES, keep_broken: bool = False) -> DataFrame:
    """(key, media, archive, offset, error) of all members of the archives in a folder."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(suffix=suffix, rangebytes=range_bytes, onerror="keep" if keep_broken else "fail").load(folder)


# --- images ---------------------------------------------------------------------------------------------------------------------------

#: Fixed values of the PNG format: signature, and header fields for 8-bit grey samples.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY = (8, 0, 0, 0, 0)
#: Samples in a line.
WIDTH = 64
#: The text chunk in which an image says how many of its samples are content.
LENGTH_KEY = b"Length\0"
DATA_CHUNK = 1 << 20


def padded(content: bytes) -> bytes:
    """The content with zeros up to a positive multiple of WIDTH."""
    return content + bytes(-len(content) % WIDTH if content else WIDTH)


def encode_image(content: bytes) -> bytes:
    """A grey PNG whose samples are the padded content."""
    samples = np.frombuffer(padded(content), dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = samples
    packed = zlib.compress(lines, 6)
    chunks = [(b"IHDR", struct.pack(">2I5B", WIDTH, len(samples), *GREY)), (b"tEXt", LENGTH_KEY + str(len(content)).encode())]
    chunks += [(b"IDAT", packed[i : i + DATA_CHUNK]) for i in range(0, len(packed), DATA_CHUNK)] + [(b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)) for kind, data in chunks)


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The samples of an image that encode_image made, and how many of them are content."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, length = 8, [], None, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a damaged PNG")
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(LENGTH_KEY):
            length = int(data[len(LENGTH_KEY) :])
    if head is None or head[0] != WIDTH or head[2:] != GREY:
        raise ValueError(f"not a grey PNG of {WIDTH} samples a line")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(head[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a PNG with line filters")
    return lines[:, 1:].tobytes(), length


def feature(samples: bytes) -> str:
    """Lines, mean and entropy of the samples, and a hash of 64 bits: which 64ths of the image are brighter than its mean."""
    values = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(values, minlength=256)
    shares = counts[counts > 0] / len(values)
    whole = int(values.sum(dtype=np.int64))
    sums = np.add.reduceat(values, np.arange(WIDTH, dtype=np.int64) * len(values) // WIDTH, dtype=np.int64)
    bits = sums * len(values) > whole * (len(values) // WIDTH)
    return f"lines={len(values) // WIDTH};mean={whole / len(values):.4f};entropy={abs(float(-(shares * np.log2(shares)).sum())):.4f};bright={int(''.join('01'[b] for b in bits.tolist()), 2):016x}"


def as_images(content: Column) -> Column:
    """The image of each binary value; null: that of an empty one."""

    @F.udf("binary", useArrow=True)
    def run(value):
        return encode_image(bytes(value or b""))

    return run(content)


def described(media: DataFrame) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, stored in zip(batch.column(0), batch.column(1), strict=True):
                image = stored.as_py()
                samples, length = decode_image(image)
                out.append({"key": key.as_py(), "n_bytes": length, "payload_bytes": len(samples), "payload_sha256": sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-WIDTH:]), "media_bytes": len(image), "media_sha256": sha256(image).hexdigest(), "feature": feature(samples)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    numbers = {"n_bytes", "payload_bytes", "tail_crc32", "media_bytes"}
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = pa.schema([(n, pa.int64() if n in numbers else pa.string()) for n in names])
    return media.select("key", "media").mapInArrow(run, ", ".join(f"{n} {'long' if n in numbers else 'string'}" for n in names))


def archived_texts(docs: DataFrame, folder: str, id_column: str = "doc_id") -> DataFrame:
    """Write each text as an image into archives in `folder`, and return what is read back."""
    images = docs.select(F.col(id_column).cast("string").alias("key"), as_images(text_or_empty("text").cast("binary")).alias("media"))
    write_media(images, folder, ".png")
    return read_media(docs.sparkSession, folder, ".png")


def op13_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = archived_texts(docs, f"{checkpoint_folder(spark)}/media-{uuid.uuid4().hex}")
    return described(stored).withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
