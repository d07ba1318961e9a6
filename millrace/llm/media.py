"""Media columns: texts stored as 8-bit images in archives, read back by byte range.

``media_archive`` is a Spark data source in both directions. Written rows
(key, payload) become members of ZIP archives, each payload a PNG of one 8-bit
grey sample per byte, 64 samples a row, deflated and so lossless. Every task
writes archives of its own; those of the tasks that succeeded are listed in a
manifest at commit, so that failed or doubled attempts leave no rows.

Reading plans from the manifest alone: each archive is cut into byte ranges, and
a partition reads the members whose header begins in its range, found through
the archive's central directory. Payloads stream through Arrow in batches of
bounded bytes. A member that fails to read or whose checksum is wrong is opened
and read again by its offset, RETRIES times, without the others being repeated.

Paths may be of any file system pyarrow opens by URI (file, s3, gs, hdfs); they
must be shared by the executors.

Defined results: null text is empty; a payload is padded with zeros to a
positive multiple of 64 bytes; equal texts give equal media and features; null
keys come back null, equal keys as often as they were written and in no order, so
there are no ties; an empty table gives no archives and no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from millrace.session import shared_dir

ROW_BYTES = 64
ARCHIVE_BYTES = 32 << 20
ARCHIVE_MEMBERS = 20_000
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
DEFLATE_LEVEL = 4
MANIFEST = "manifest.json"
_PNG = b"\x89PNG\r\n\x1a\n"
_NULL_KEY = "-"
WRITE_SCHEMA = "key string, payload binary"
READ_SCHEMA = "key string, media binary"


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples wide; the payload is a positive multiple of 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    raw = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)  # each row after its filter type, 0
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", ROW_BYTES, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw.tobytes(), DEFLATE_LEVEL)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` made; checks the chunks' checksums."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return raw[:, 1:].tobytes()


@dataclass
class Written(WriterCommitMessage):
    """The archives of one task: (name, bytes, members)."""

    archives: list


@dataclass
class ByteRange(InputPartition):
    archive: str
    begin: int
    end: int


class _Sink:
    """A counting, write-only file for zipfile over a stream that cannot seek."""

    def __init__(self, stream):
        self.stream, self.count = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.count += len(data)
        return len(data)

    def tell(self) -> int:
        return self.count

    def flush(self) -> None:
        pass

    def seekable(self) -> bool:
        return False


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        done, archive, name = [], None, ""

        def close():
            archive.close()
            sink.stream.close()
            done.append((name, sink.count, members))

        for batch in iterator:
            keys, payloads = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                if archive is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    sink = _Sink(fs.open_output_stream(f"{base}/{name}"))
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                key = keys[i].as_py()
                key = _NULL_KEY if key is None else "k" + key.encode().hex()
                archive.writestr(zipfile.ZipInfo(f"{members:08d}.{key}.png"), encode_png(payloads[i].as_py()))
                members += 1
                if sink.count >= ARCHIVE_BYTES or members >= ARCHIVE_MEMBERS:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def _manifest(self, messages) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        listed = [a for m in messages if m is not None for a in m.archives]
        if not self.overwrite and fs.get_file_info(f"{base}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                listed = json.loads(f.read()) + listed
        with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps(listed).encode())

    def commit(self, messages) -> None:
        self._manifest(messages)

    def abort(self, messages) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _, _ in m.archives if m is not None else []:
                fs.delete_file(f"{base}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        # One range beyond the archives keeps an empty directory readable.
        return [
            ByteRange(name, at, at + self.range_bytes) for name, size, _ in archives for at in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        path = f"{base}/{partition.archive}"
        members = _retried(lambda: _members(fs, path, partition))
        keys, media, held = [], [], 0
        for info in members:
            data = _retried(lambda info=info: _member(fs, path, info))
            key = info.filename.split(".")[1]
            keys.append(None if key == _NULL_KEY else bytes.fromhex(key[1:]).decode())
            media.append(data)
            held += len(data)
            if held >= BATCH_BYTES:
                yield _batch(keys, media)
                keys, media, held = [], [], 0
        if keys:
            yield _batch(keys, media)


def _batch(keys: list, media: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(keys, pa.string()), pa.array(media, pa.binary())], names=["key", "media"])


def _members(fs, path: str, part: ByteRange) -> list[zipfile.ZipInfo]:
    """The members whose header begins in the range, by the central directory."""
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
        return [m for m in archive.infolist() if part.begin <= m.header_offset < part.end]


def _member(fs, path: str, info: zipfile.ZipInfo) -> bytes:
    """One member, read at its offset; raises if its bytes do not have the directory's checksum."""
    with fs.open_input_file(path) as f:
        f.seek(info.header_offset)
        head = f.read(30)
        name, extra = struct.unpack_from("<HH", head, 26)
        f.seek(info.header_offset + 30 + name + extra)
        data = f.read(info.file_size)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"member {info.filename} at {info.header_offset} is damaged")
    return data


def _retried(read):
    """The result of ``read``, tried again after a short wait that doubles."""
    for attempt in range(RETRIES):
        try:
            return read()
        except (OSError, zipfile.BadZipFile):
            if attempt + 1 == RETRIES:
                raise
            time.sleep(0.2 * 2**attempt)


class MediaArchive(DataSource):
    """Format ``media_archive``; options: path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def to_payload(text):
    """UTF-8 bytes of a text column, padded with zeros to a positive multiple of 64 bytes."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    padded = F.greatest(F.lit(1), F.ceil(size / ROW_BYTES)) * ROW_BYTES
    return F.rpad(data, padded.cast("int"), F.lit(bytes(1)))


def store(rows: DataFrame, path: str) -> None:
    """Write (key, payload) rows as archives under ``path``."""
    rows.sparkSession.dataSource.register(MediaArchive)
    rows.write.format("media_archive").mode("append").save(path)


def load(spark, path: str) -> DataFrame:
    """The members (key, media) of the archives under ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(path)


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and an 8 x 8 average hash."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    image = samples.reshape(-1, ROW_BYTES)
    cuts = np.linspace(0, len(image), 9).astype(int)
    bands = np.add.reduceat(image.astype(np.int64), np.minimum(cuts[:-1], len(image) - 1), axis=0)
    cells = bands.reshape(8, 8, ROW_BYTES // 8).sum(axis=2) / np.maximum(1, np.diff(cuts))[:, None]
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};ahash={bits}"


def describe(media: DataFrame) -> DataFrame:
    """Decode each member and add its payload's size, digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(1).to_pylist()
            payloads = [decode_png(m) for m in stored]
            sha = lambda all_: pa.array([hashlib.sha256(x).hexdigest() for x in all_], pa.string())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    sha(payloads),
                    pa.array([zlib.crc32(p[-ROW_BYTES:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()),
                    sha(stored),
                    pa.array([features(p) for p in payloads], pa.string()),
                ],
                names=["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "key string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def through_archive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` as media and describe what is read back.

    The unpadded size travels in the key, as text may itself end in zeros.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.concat_ws("|", size.cast("string"), F.col(id_col).cast("string"))
    store(docs.select(key.alias("key"), to_payload(F.col(text_col)).alias("payload")), path)
    parts = F.split("key", r"\|", 2)
    return describe(load(spark, path)).select(
        F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("key"),
        F.element_at(parts, 1).cast("long").alias("n_bytes"),
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
    )
