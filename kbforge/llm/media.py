"""Media columns over archives of lossless images (operator 10).

``write_archives`` stores each document's payload as the samples of an 8-bit grey PNG image, as a
member of a zip archive in the shared folder; every task writes archives of bounded size.

``ArchiveDataSource`` reads such folders: it plans partitions from the archives' paths and sizes
alone, as ranges of bytes; a manifest tells the archives of finished tasks from those of lost ones. A task reads its archive's directory, takes the members whose header
starts in its range, and streams their bytes through one handle as Arrow batches. A member that
fails its checksum or a read (a short one too) is tried again from its own offset, with the file
opened anew, without reading others again; so is the directory.

Defined cases: null and empty texts have a payload of 576 bytes 255; repeated rows are members of
their own; a very long text is one member, whatever the size of archives and ranges; an empty table
gives no archive and no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workspace import fresh_dir

#: Payloads are multiples of this many bytes; an image row has so many samples.
UNIT = 576
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = pa.schema([("archive", pa.string()), ("bytes", pa.int64())])
MEMBERS = "doc_id long, archive string, offset long, media binary"


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text, filled with bytes 255 (which UTF-8 never has) up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """The payload as an 8-bit grey image, UNIT samples a row, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    parts = [(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), level)), (b"IEND", b"")]
    return PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def decode_png(media: bytes) -> bytes:
    """The samples of an image that ``encode_png`` has made; a damaged one raises ValueError."""
    if media[:8] != PNG:
        raise ValueError("no PNG signature")
    at, width, idat = 8, 0, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            idat.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not used here")
    return lines[:, 1:].tobytes()


def image_features(payload: bytes) -> str:
    """Height, mean, standard deviation and entropy of the samples, and a 64-bit hash of 8 x 8 block means."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    spread = float(counts @ (np.arange(256) - mean) ** 2 / len(samples)) ** 0.5
    cuts = np.linspace(0, len(samples), 65).astype(int)
    means = np.add.reduceat(samples, cuts[:-1], dtype=np.int64) / np.diff(cuts)
    bits = int("".join("1" if x > mean else "0" for x in means), 2)
    return f"h={len(samples) // UNIT};mean={mean:.4f};sd={spread:.4f};entropy={-float(share @ np.log2(share)):.4f};hash={bits:016x}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes (doc_id, text) as archives into ``folder``; one row for each archive: (archive, members, bytes).

    An archive's name holds the task's attempt, so no attempt touches another's files and no store
    has to replace or rename one. Which attempt counts is Spark's decision: the rows returned name
    the archives of those whose result was taken, and written as Parquet they are the manifest to
    read by. Archives that it does not name are left over from lost attempts.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made, number, buffer, archive = [], 0, None, None

        def close() -> None:
            nonlocal buffer, archive, number
            members = len(archive.namelist())
            archive.close()
            name = f"part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.zip"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(buffer.getbuffer())
            made.append((name, members, buffer.getbuffer().nbytes))
            buffer, archive, number = None, None, number + 1

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if archive is None:
                    buffer = io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{len(archive.namelist()):08d}_{'' if doc_id is None else doc_id}.png")
                archive.writestr(member, encode_png(payload_of(text.as_py())))
                if buffer.tell() >= archive_bytes:
                    close()
        if archive is not None:
            close()
        names, members, sizes = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(members, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "members", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(write, "archive string, members long, bytes long")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveHandle:
    """An archive that is opened once and opened anew after a failure."""

    def __init__(self, store: fs.FileSystem, path: str, attempts: int):
        self.store, self.path, self.attempts, self.source = store, path, attempts, None

    def close(self) -> None:
        if self.source is not None:
            try:
                self.source.close()
            except OSError:  # a lost connection
                pass
        self.source = None

    def retried(self, work, what: str):
        """``work`` of the open file; a failed read, a short one or a wrong checksum is tried again."""
        for attempt in range(self.attempts):
            try:
                if self.source is None:
                    self.source = self.store.open_input_file(self.path)
                return work(self.source)
            except (OSError, ValueError, struct.error, zipfile.BadZipFile) as e:
                why = e
                self.close()
            if attempt + 1 < self.attempts:
                time.sleep(0.05 * 2**attempt)
        raise RuntimeError(f"{what} of {self.path}: {why}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.manifest = options.get("manifest")
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges of bytes over the archives that the manifest names, or, without one, over all of the folder; no archive is opened here."""
        store, root = fs.FileSystem.from_uri(self.folder)
        if self.manifest:
            named = ds.dataset(self.manifest, format="parquet", schema=MANIFEST).to_table()
            files = sorted((f"{root}/{name}", size) for name, size in zip(named["archive"].to_pylist(), named["bytes"].to_pylist()))
        else:
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".zip") and not f.base_name.startswith("."))
        return [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in files for at in range(0, size, self.range_bytes)]

    def directory(self, archive: ArchiveHandle) -> list[zipfile.ZipInfo]:
        return archive.retried(lambda source: zipfile.ZipFile(source).infolist(), "its directory")

    def member(self, archive: ArchiveHandle, info: zipfile.ZipInfo) -> bytes:
        """One member's bytes, read again from its own offset after a failure."""

        def load(source: pa.NativeFile) -> bytes:
            source.seek(info.header_offset)
            head = source.read(30)
            if len(head) < 30:
                raise ValueError("its header ends early")
            name, extra = struct.unpack("<HH", head[26:30])
            source.seek(info.header_offset + 30 + name + extra)
            data = source.read(info.compress_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise ValueError("its checksum differs")
            return data

        return archive.retried(load, f"{info.filename} at {info.header_offset}")

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        archive = ArchiveHandle(store, partition.path, self.attempts)
        members = [m for m in self.directory(archive) if partition.start <= m.header_offset < partition.stop]
        held, size = [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for info in members:
            data = self.member(archive, info)
            name = info.filename.split("_", 1)[1].removesuffix(".png")
            held.append((int(name) if name else None, partition.path.rsplit("/", 1)[-1], info.header_offset, data))
            size += len(data)
            if size >= self.batch_bytes:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()
        archive.close()


class ArchiveDataSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options manifest, rangeBytes, batchBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(doc_id, archive, offset, media) of the members of the archives in ``folder``, or of those that a ``manifest`` of it names."""
    spark.dataSource.register(ArchiveDataSource)
    return spark.read.format("media_archives").options(**options).load(folder)


def store_media(docs: DataFrame) -> DataFrame:
    """The documents' payloads, written as archives into the shared folder and read back through the data source."""
    spark = docs.sparkSession
    folder, manifest = fresh_dir(spark, "archives"), fresh_dir(spark, "manifest")
    write_archives(docs, folder).write.parquet(manifest)
    return read_archives(spark, folder, manifest=manifest)


def media_features(media: DataFrame) -> DataFrame:
    """Features of decoded images: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column("media"):
                stored = cell.as_py()
                payload = decode_png(stored)
                n = len(payload.rstrip(b"\xff"))
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), image_features(payload)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "media").mapInArrow(describe, schema)
