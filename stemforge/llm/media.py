"""Media columns: payloads stored losslessly as greyscale PNG members of zip archives, and read back by a Spark data source.

The source plans byte ranges over the archives of a folder without opening them. A task reads the directory of its archive,
takes the members whose header lies in its range, streams their bytes to Spark in Arrow batches, and reads a member that
fails again on its own, from its offset.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stemforge.llm.shared import groups_of, new_dir, texts_of

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LOCAL_HEADER = struct.Struct("<4s5H3I2H")
MEMBERS = T.StructType([T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("error", T.StringType())])
#: Bytes of members in one Arrow batch, unless a single member is longer.
BATCH_BYTES = 4 << 20


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """payload and blanks (byte 32) up to a positive multiple of unit."""
    return payload.ljust(max(unit, -(-len(payload) // unit) * unit), b" ")


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image, WIDTH samples wide, whose samples are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image made by to_png; raises ValueError if a checksum or the form is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, packed = 8, 0, 0, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def write_archives(documents: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes each partition's texts as one archive of images in folder; returns the number of members.

    An archive gets its name, that of its partition, only when it is whole, so a task that runs again replaces what an earlier
    attempt has left. A null text is stored as an empty one; null ids and repeated rows are members of their own; a partition
    without rows writes nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/part-{TaskContext.get().partitionId():07d}.zip", f"{root}/.{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for batch in groups_of(batches):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                    raw = text.encode()
                    archive.writestr(zipfile.ZipInfo(f"{n:09d}_{'' if doc_id is None else doc_id}_{len(raw)}.png"), to_png(padded(raw)))
                    n += 1
        if n:
            store.move(own, name)
        else:
            store.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["members"])

    rows = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "members long")
    return rows.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", 16 << 20)))
        self.retries = int(options.get("retries", 3))
        self.on_error = options.get("onerror", options.get("onError", "fail"))

    def partitions(self) -> list[ByteRange]:
        store, root = fs.FileSystem.from_uri(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file and f.path.endswith(".zip")]
        return [ByteRange(f.path, a, min(a + self.split_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.split_bytes)] or [ByteRange("", 0, 0)]

    def member(self, store: fs.FileSystem, path: str, info: zipfile.ZipInfo, held: list) -> bytes:
        """The bytes of one member, from its offset; held: the open file, opened anew after a failure."""
        for left in range(self.retries, -1, -1):
            try:
                if not held:
                    held.append(store.open_input_file(path))
                head = LOCAL_HEADER.unpack(held[0].read_at(LOCAL_HEADER.size, info.header_offset))
                if head[0] != b"PK\3\4":
                    raise OSError(f"no member at {info.header_offset} of {path}")
                data = held[0].read_at(info.compress_size, info.header_offset + LOCAL_HEADER.size + head[9] + head[10])
                data = zlib.decompress(data, -15) if info.compress_type == zipfile.ZIP_DEFLATED else data
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise OSError(f"{info.filename} at {info.header_offset} of {path} is damaged")
                return data
            except (OSError, zlib.error, struct.error):
                held.clear()
                if not left:
                    raise
                time.sleep(0.05 * 2 ** (self.retries - left))
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        held: list = [store.open_input_file(partition.path)]
        with zipfile.ZipFile(held[0]) as archive:
            infos = sorted((i for i in archive.infolist() if partition.begin <= i.header_offset < partition.end), key=lambda i: i.header_offset)
        held.clear()  # the archive has closed it
        rows: list[tuple] = []
        size = 0
        for info in infos:
            try:
                row = (partition.path, info.filename, info.header_offset, self.member(store, partition.path, info, held), None)
            except (OSError, zlib.error, struct.error) as e:
                if self.on_error == "fail":
                    raise
                row = (partition.path, info.filename, info.header_offset, None, str(e))
            rows.append(row)
            size += len(row[3] or b"")
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], MEMBERS.names)


class ArchiveSource(DataSource):
    """spark.read.format("archive_members").load(folder): one row per member of the folder's zip archives.

    Options: splitBytes (bytes of a partition), retries (of a member that fails), onError ("fail", or "keep": media is null
    and error tells why). A folder without archives gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> T.StructType:
        return MEMBERS

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").options(**options).load(folder)


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples."""
    seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share, values = seen / len(payload), np.arange(256)
    mean = float(share @ values)
    there = share[share > 0]
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};std={max(0.0, float(share @ values**2) - mean**2) ** 0.5:.4f};bits={float(-(there @ np.log2(there))) + 0.0:.4f}"


def member_digests(members: DataFrame) -> DataFrame:
    """The digests of each member's payload and stored form; a member that could not be read has nulls there."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "media"):
            rows = []
            for name, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
                _, doc_id, n = name.removesuffix(".png").split("_")
                payload = None if media is None else from_png(media)
                rows.append((int(doc_id) if doc_id else None, int(n), *([None] * 6 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))))
            kinds = [pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return members.select("member", "media").mapInArrow(run, schema)


def media_digests(documents: DataFrame, **options) -> DataFrame:
    """Stores every text of documents (integer doc_id) as an image in archives in the shared folder, reads the archives back by
    the data source and returns one row of digests per document. Null and empty texts are images of one row of blanks; null
    ids and repeated rows stay; an empty table gives no rows; other columns are not read."""
    spark = documents.sparkSession
    folder = new_dir(spark, "media")
    write_archives(documents, folder)
    return member_digests(read_archives(spark, folder, **options))
