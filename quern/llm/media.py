"""Media columns: archives of images, and a Spark data source that reads them by byte ranges.

`store` turns payloads into 8-bit grayscale PNG images of ROW samples a row and writes those of a task as one
ZIP archive (members stored as they are) into the shared folder, under a name of the attempt and then
renamed, so a task that runs twice leaves the same archive. `MediaArchives` is a data source over a folder of
archives: the driver lists the archives and plans ranges of RANGE bytes; a task reads its archive's
directory, takes the members whose offset is in its range, and streams them as Arrow batches of bounded size.
A member that can't be read or whose checksum is wrong is read again by its offset, alone, up to ATTEMPTS times.

Payloads are texts: UTF-8, filled up with bytes 255 (which UTF-8 never has) to a positive multiple of ROW.

Defined cases: null is stored as the empty text, one row of 255; a null doc_id stays null; equal texts have
equal images; repeated rows are members of their own; an empty table makes no archive and reads as no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_dir, remote, write_once

ROW, LEVEL = 576, 3
RANGE, BATCH, ATTEMPTS = 8 << 20, 4 << 20, 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(samples: bytes) -> bytes:
    rows = np.zeros((len(samples) // ROW, ROW + 1), "u1")  # the first byte of a row is its filter, none
    rows[:, 1:] = np.frombuffer(samples, "u1").reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image as to_png makes it; every checksum is tested."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, head = 8, [], b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("wrong checksum in an image")
        head = part if kind == b"IHDR" else head
        body += [part] if kind == b"IDAT" else []
        at += 12 + n
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head)
    rows = np.frombuffer(zlib.decompress(b"".join(body)), "u1").reshape(height, width + 1)
    if depth != 8 or colour or laced or rows[:, 0].any():
        raise ValueError("an image of another kind")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation, extremes, mean step between neighbours and the entropy of the samples."""
    x = np.frombuffer(samples, "u1")
    p = np.bincount(x, minlength=256) / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    return f"mean={x.mean():.4f};std={x.std():.4f};min={x.min()};max={x.max()};step={step:.4f};entropy={entropy:.4f}"


def store(docs: DataFrame, out: str | None = None) -> str:
    """Writes the archives of the documents' texts; their folder."""
    out = out or new_dir(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0

        def write(stream) -> None:
            nonlocal done
            with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as z:
                for batch in batches:
                    for d, text in zip(batch["doc_id"], batch["text"]):
                        z.writestr(zipfile.ZipInfo(f"{done:08d}_{d.as_py()}.png"), to_png(payload(text.as_py())))
                        done += 1

        first = next(batches, None)
        if first is not None:
            rest = batches
            batches = (b for source in ([first], rest) for b in source)
            fs, folder = remote(out)
            fs.create_dir(folder, recursive=True)
            write_once(fs, f"{folder}/{part:07d}.zip", write)
        yield pa.RecordBatch.from_pydict({"members": pa.array([done], pa.int64())})

    docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "members long").agg({"members": "sum"}).collect()
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class MediaArchives(DataSource):
    """spark.read.format("media_archives").option("path", folder): doc_id, name, position and media."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, name string, position long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, folder = remote(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.path.endswith(".zip"))
        return [Range(p, a, min(a + self.range, n)) for p, n in found for a in range(0, n, self.range)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = remote(self.path)
        rows, size = [], 0
        for info in directory(fs, partition.path):
            if partition.start <= info.header_offset < partition.stop:
                data = member(fs, partition.path, info)
                name = info.filename.rsplit(".", 1)[0].split("_", 1)[-1]
                rows.append((None if name == "None" else int(name), info.filename, info.header_offset, data))
                size += len(data)
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "name", "position", "media"])


def _again(action):
    """action(), repeated after failures of reading, each time with everything opened anew."""
    for k in range(ATTEMPTS):
        try:
            return action()
        except (OSError, ValueError, zipfile.BadZipFile, struct.error):
            if k == ATTEMPTS - 1:
                raise
            time.sleep(0.05 * 2**k)


def directory(fs, path: str) -> list[zipfile.ZipInfo]:
    def read() -> list[zipfile.ZipInfo]:
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            return sorted(z.infolist(), key=lambda i: i.header_offset)

    return _again(read)


def member(fs, path: str, info: zipfile.ZipInfo) -> bytes:
    """A member's bytes, read by its offset and tested by its checksum."""

    def read() -> bytes:
        with fs.open_input_file(path) as f:
            f.seek(info.header_offset)
            head = f.read(30)
            names = sum(struct.unpack("<HH", head[26:30]))
            f.seek(info.header_offset + 30 + names)
            data = f.read(info.compress_size)
        if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
            raise ValueError(f"member {info.filename} of {path} is damaged")
        return data

    return _again(read)


def load(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", path).option("rangeBytes", str(range_bytes)).load()


def described(media: DataFrame) -> DataFrame:
    """What the stored images hold, per row: sizes, digests and features of the samples read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, m in zip(batch["doc_id"], batch["media"]):
                data = m.as_py()
                samples = from_png(data)
                rows.append((d.as_py(), len(samples.rstrip(b"\xff")), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
