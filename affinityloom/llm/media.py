"""Media columns: WAV members in ZIP archives, read by a data source that plans byte ranges."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from affinityloom.llm import files
from affinityloom.llm.common import scratch_path

ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
RATE = 16000


def to_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM: a header of 44 bytes, then the payload as samples."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a WAV member of this writer")
    return media[44:44 + struct.unpack_from("<I", media, 40)[0]]


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def write_archives(docs: DataFrame, folder: str) -> int:
    """Store each row's text as a WAV member of the task's archives; returns the number of archives.

    A member's name holds a serial number, the id and the unpadded size. An archive closes at
    ARCHIVE_BYTES, so a task holds one at a time. Null texts are empty, repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, k = TaskContext.get().partitionId(), 0, 0
        buffer = archive = None

        def close() -> pa.RecordBatch:
            archive.close()
            return pa.RecordBatch.from_pydict({"uri": [files.put(folder, f"part-{task:06d}-{k:05d}.zip", buffer.getvalue())]})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if archive is None:
                    buffer = io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                payload, n = padded(text)
                archive.writestr(zipfile.ZipInfo(f"{serial}_{'' if doc_id is None else doc_id}_{n}.wav"), to_wav(payload), zipfile.ZIP_DEFLATED, 1)
                serial += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    yield close()
                    k, archive = k + 1, None
        if archive is not None:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, "uri string").count()


class ByteRange(InputPartition):
    def __init__(self, uri: str, start: int, stop: int):
        self.uri, self.start, self.stop = uri, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives; the driver sees names and sizes only, no member."""
        return [ByteRange(uri, at, at + self.range_bytes) for uri, size in files.listed(self.folder, ".zip")
                for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """Members whose local header starts in the range, from the archive's own directory."""
        if not partition.uri:
            return
        with files.opened(partition.uri) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.stop]
        rows, size = [], 0
        for m in sorted(members, key=lambda m: m.header_offset):
            rows.append((m.filename, *member(partition.uri, m)))
            size += len(rows[-1][1] or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], ["member", "media", "error"])


def member(uri: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """One member by its offset, tried again on its own; after the last attempt its error is the row's."""
    error = None
    for _ in range(ATTEMPTS):
        try:
            with files.opened(uri) as f:
                f.seek(info.header_offset)
                head = f.read(30)
                names, extra = struct.unpack_from("<HH", head, 26)
                f.seek(info.header_offset + 30 + names + extra)
                raw = f.read(info.compress_size)
            data = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
            if zlib.crc32(data) != info.CRC:
                raise OSError("checksum differs")
            return data, None
        except (OSError, zlib.error, struct.error) as e:
            error = f"{type(e).__name__}: {e}"
    return None, error


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: member, media, error."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(folder)


def features(payload: bytes) -> str:
    """Mean, deviation, crossings of the middle and peak of the samples, as JSON."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return json.dumps({"mean": round(float(x.mean()), 4), "std": round(float(x.std()), 4), "crossings": crossings, "peak": int(np.abs(x).max())})


def with_features(members: DataFrame) -> DataFrame:
    """One row a member; a member that could not be read keeps its id and error, its values are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media, error in zip(*(batch.column(k).to_pylist() for k in ("member", "media", "error"))):
                _, doc_id, n = name.removesuffix(".wav").split("_")
                own = (int(doc_id) if doc_id else None, int(n))
                if media is None:
                    rows.append((*own, None, None, None, None, None, None, error))
                    continue
                payload = from_wav(media)
                rows.append((*own, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
                             hashlib.sha256(media).hexdigest(), features(payload), None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return members.mapInArrow(
        run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, feature string, error string")


def media_digest(docs: DataFrame) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "archives")
    write_archives(docs, folder)
    return with_features(read_archives(docs.sparkSession, folder))
