"""Media columns: payloads stored losslessly as images in archives, and a Spark data source that reads them back.

``write_archives`` turns each text's bytes, padded with zeros to a positive
multiple of 64, into a grayscale PNG of 8-bit samples (64 a row) and appends it
to a ZIP archive in a folder that all executors share. An archive is rolled at
``roll_bytes``; each is written under a temporary name and renamed when whole,
and names depend on the partition only, so a task that runs again replaces what
a lost one wrote.

The data source ``media_archive`` plans partitions as byte ranges of the
folder's archives. A reader opens an archive's directory, takes the members
whose headers start in its range and streams them as Arrow batches; a member
that can't be read or fails its checksum is read again by its own offset, up to
``retries`` times, without touching the others; then the task fails.

Nulls and edge cases: a null text is empty and stored as 64 zero bytes; a null
id is kept, and ids (not the empty string) keep their type; repeated rows are members of their own; equal texts give equal
bytes; an empty table gives an empty archive folder and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trackloom.llm.textbytes import sliced
from trackloom.plans.lineage import qualified, shared_dir

ROW = 64
BATCH_BYTES = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, offset long, member string, media binary"


# PNG with 8-bit gray samples.

def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, n_bytes: int) -> bytes:
    """``payload`` (a multiple of 64 bytes) as an image; the unpadded size goes into a private chunk."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), dtype=np.uint8)  # each row has filter type 0
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"laSt", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded size)"""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, size, n_bytes = 8, [], (0, 0), 0
    while at < len(media):
        length, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + length)[0]:
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"laSt":
            n_bytes = struct.unpack(">Q", data)[0]
        elif kind == b"IDAT":
            parts.append(data)
        at += length + 12
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    return rows[:, 1:].tobytes(), n_bytes


def describe(payload: bytes) -> str:
    """Mean and deviation of the samples, then an 8 x 8 average hash over equal spans."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.float64)
    means = np.add.reduceat(x, np.arange(64) * len(x) // 64) / (len(x) // 64)
    bits = np.packbits(means > x.mean())
    return f"{x.mean():.3f} {x.std():.3f} {bits.tobytes().hex()}"


# Archives.

def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """folder: with its scheme."""
    return pafs.FileSystem.from_uri(folder)


def _write(folder: str, roll_bytes: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        archive, count, n = None, 0, 0

        def close() -> pa.RecordBatch:
            archive.close()
            stream.close()
            fs.move(temporary, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["archive", "members"])

        for rows, texts in sliced(batches):
            for text, own in zip(texts, rows.column("id").to_pylist()):
                if archive is None:
                    name = f"part-{part:06d}-{n:05d}.zip"
                    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(temporary)
                    archive, count, n = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0, n + 1
                payload = text + bytes(-len(text) % ROW or (0 if text else ROW))
                member = zipfile.ZipInfo(f"{count}/{'' if own is None else f'id-{own}'}.png")
                archive.writestr(member, encode_image(payload, len(text)))
                count += 1
                if stream.tell() >= roll_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", roll_bytes: int = 64 << 20) -> int:
    """Writes all payloads below ``folder``; returns the number of members."""
    folder = qualified(docs.sparkSession, folder)
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_write(folder, roll_bytes), "archive string, members long").agg(F.sum("members")).first()[0] or 0


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        super().__init__((archive, start, end))
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        fs, root = _file_system(self.folder)
        files = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".zip") and not f.base_name.startswith(".")]
        return [ByteRange(f.path, a, min(a + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = _file_system(self.folder)
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        members.sort(key=lambda m: m.header_offset)
        stream = fs.open_input_file(partition.archive)
        rows, size = [], 0
        for m in members:
            for attempt in range(self.retries + 1):
                try:
                    media = read_member(stream, m)
                    break
                except (OSError, ValueError, struct.error):
                    if attempt == self.retries:
                        raise
                    time.sleep(0.05 * 2**attempt)
                    stream = fs.open_input_file(partition.archive)
            rows.append((partition.archive, m.header_offset, m.filename, media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def read_member(stream, member: zipfile.ZipInfo) -> bytes:
    """A stored member by its offset, checked."""
    stream.seek(member.header_offset)
    header = stream.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {member.header_offset}")
    name, extra = struct.unpack("<HH", header[26:30])
    stream.seek(member.header_offset + 30 + name + extra)
    media = bytes(stream.read(member.compress_size))
    if len(media) != member.compress_size or zlib.crc32(media) != member.CRC:
        raise ValueError(f"member at {member.header_offset} is damaged")
    return media


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "offset", "member", "media"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangeBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(qualified(spark, folder))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for member, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
            own = member.split("/", 1)[1].removesuffix(".png")
            payload, n_bytes = decode_image(media)
            rows.append((own.removeprefix("id-") or None, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
        if rows:
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def media_features(archives: DataFrame) -> DataFrame:
    """What the stored bytes hold: one row a member, the id as a string."""
    return archives.mapInArrow(_features, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Stores ``docs`` in a new folder below the shared one and returns the features as read back; the archives stay there."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    write_archives(docs, folder, id_col, text_col)
    found = media_features(read_archives(spark, folder, **options))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
