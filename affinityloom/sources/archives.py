"""Resumable index of tar archives: members by byte offset, in bounded chunks, progress kept as a table.

One run is one Spark job. It joins the listing of the archives with the progress of earlier runs, walks the
headers of every unfinished archive from its next byte (payloads are skipped by seeking), and appends members
and progress in one write. Archives are walked in parallel and independently; nothing passes through the
driver. A task writes an archive's members and its progress into one file, so a run that died halfway has
either both or neither, and the next run takes up what is missing.
"""

from __future__ import annotations

import re
import tarfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinityloom.operators.ordering import first_rows

BLOCK = 512
ROWS_PER_BATCH = 10_000
LOG = ("archive string, modified timestamp, length bigint, since int, member string, key string, header bigint, bytes bigint, "
       "next_byte bigint, chunks int, indexed bigint, total bigint, status string")
ARROW = pa.schema([
    ("archive", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("since", pa.int32()), ("member", pa.string()),
    ("key", pa.string()), ("header", pa.int64()), ("bytes", pa.int64()), ("next_byte", pa.int64()), ("chunks", pa.int32()),
    ("indexed", pa.int64()), ("total", pa.int64()), ("status", pa.string())])


def opened(uri: str):
    system, path = fs.FileSystem.from_uri(quote(uri, safe=":/%"))
    return system.open_input_file(path)


def model_accession(member: str) -> str | None:
    """Accession of a predicted-structure member, None for any other member."""
    base = member.rsplit("/", 1)[-1]
    found = re.match(r"AF-([^-]*)-", base)
    return (found.group(1).strip().upper() or None) if found and "-model_" in base else None


def walk(file, start: int, length: int, budget: int | None, key_of: Callable[[str], str | None], report: Callable[[str], None] = lambda status: None
         ) -> Iterator[tuple[str, str, int, int, int]]:
    """(member, key, header offset, bytes, next byte) of the kept regular files from ``start`` on.

    ``start`` must be a header's offset. Stops after ``budget`` kept members. ``report`` gets how it ended:
    ``completed``, ``partial``, or ``damaged`` (no header where one must be, or a payload cut short).
    """
    kept, status = 0, "completed"
    file.seek(start)
    try:
        with tarfile.open(fileobj=file, mode="r:") as archive:
            while True:
                at = archive.offset
                member = archive.next() if kept or archive.firstmember is None else archive.firstmember
                archive.firstmember = None
                archive.members.clear()
                if member is None:
                    file.seek(at)
                    status = "damaged" if file.read(BLOCK).strip(b"\0") else "completed"
                    break
                if budget is not None and kept >= budget:
                    status = "partial"
                    break
                following = member.offset_data + -(-member.size // BLOCK) * BLOCK
                if following > length:
                    status = "damaged"
                    break
                key = key_of(member.name) if member.isfile() else None
                if key is not None:
                    kept += 1
                    yield member.name, key, member.offset, member.size, following
    except (tarfile.TarError, OSError):
        status = "damaged"
    report(status)


def _walked(budget: int | None, key_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.to_pylist():
                head = (a["archive"], a["modified"], a["length"], a["since"])
                rows, ended, at, n = [], [], a["next_byte"], 0
                try:
                    with opened(a["archive"]) as file:
                        for name, key, header, size, following in walk(file, at, a["length"], budget, key_of, ended.append):
                            rows.append((*head, name, key, header, size, following, None, None, None, None))
                            at, n = following, n + 1
                            if len(rows) >= ROWS_PER_BATCH:
                                yield _batch(rows)
                                rows = []
                except OSError:
                    ended.append("damaged")
                rows.append((*head, None, None, None, None, at, a["chunks"] + 1, n, a["total"] + n, ended[-1]))
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def _log(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{LOG}, run int").parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def archive_progress(spark: SparkSession, target: str) -> DataFrame | None:
    """Latest progress per archive: next byte, chunks done, members of the last run and in all, status."""
    log = _log(spark, target)
    return None if log is None else first_rows(log.filter(F.col("member").isNull()), ["archive"], [F.col("run").desc()]).drop("member", "key", "header", "bytes")


def index_archives(spark: SparkSession, path: str, target: str, chunk: int | None = None, force: bool = False,
                   key_of: Callable[[str], str | None] = model_accession, tasks: int | None = None) -> DataFrame:
    """Index at most ``chunk`` more members of every archive below ``path`` into the log at ``target``.

    An archive that is completed (or damaged) and has the size and time of its last run is skipped; one that
    changed, and every one with ``force``, starts again from byte 0 and its earlier members no longer count.
    Returns the progress of all archives ever indexed. Files of no bytes are not listed; without archives the run is empty.
    """
    if chunk is not None and chunk < 1:
        raise ValueError("chunk must be at least 1")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", True).load(path).select(
        F.col("path").alias("archive"), F.col("modificationTime").alias("modified"), "length")
    seen = archive_progress(spark, target)
    run = 0
    if seen is not None:
        run = (seen.agg(F.max("run")).first()[0] or 0) + 1
    else:
        seen = spark.createDataFrame([], f"{LOG}, run int").drop("member", "key", "header", "bytes")
    was = seen.select("archive", *[F.col(c).alias(f"_{c}") for c in ("modified", "length", "since", "next_byte", "chunks", "total", "status")])
    same = ~F.lit(force) & F.coalesce((F.col("_modified") == F.col("modified")) & (F.col("_length") == F.col("length")), F.lit(False))
    kept = lambda c, fresh: F.when(same, F.col(f"_{c}")).otherwise(F.lit(fresh))
    pending = found.join(was, "archive", "left").filter(~same | (F.col("_status") == "partial")).select(
        "archive", "modified", "length", kept("since", run).cast("int").alias("since"), kept("next_byte", 0).cast("bigint").alias("next_byte"),
        kept("chunks", 0).cast("int").alias("chunks"), kept("total", 0).cast("bigint").alias("total"))
    # A stated number keeps adaptive execution from putting all the small rows into one task.
    spread = pending.repartition(tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive")
    spread.mapInArrow(_walked(chunk, key_of), LOG).write.mode("overwrite").parquet(f"{target}/run={run}")
    return archive_progress(spark, target)


def archive_members(spark: SparkSession, target: str) -> DataFrame:
    """All indexed members of the archives' present state, in the order of (archive, header)."""
    now = archive_progress(spark, target).select("archive", F.col("since").alias("_since"))
    return _log(spark, target).filter(F.col("member").isNotNull()).join(now, "archive").filter(F.col("since") == F.col("_since")).select(
        "archive", "member", "key", "header", F.col("bytes").alias("size_bytes"), "run")


def model_lookup(members: DataFrame) -> DataFrame:
    """One row per model: the last member of its name. Columns accession, entry_id, member, size_bytes, model_version."""
    base = F.substring_index("member", "/", -1)
    entry = base
    for ending in (r"\.pdb\.gz\z", r"\.cif\.gz\z", r"\.pdb\z", r"\.cif\z"):
        entry = F.regexp_replace(entry, ending, "")
    rows = members.select(F.col("key").alias("accession"), entry.alias("entry_id"), "member", "size_bytes",
                          F.regexp_extract(base, r"model_([^.]*)", 1).alias("model_version"), "archive", "header")
    return first_rows(rows, ["entry_id"], [F.col("archive").desc(), F.col("header").desc()]).drop("archive", "header")


def write_archives(rows: DataFrame, folder: str, member: str, payload: str, per_archive: int) -> int:
    """Rows as members of tar archives of at most ``per_archive`` members, in row order; returns their number.

    An archive is written under a private name and renamed, so a repeated task replaces its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        task, k, n, out, archive, private = TaskContext.get().partitionId(), 0, 0, None, None, ""

        def close() -> pa.RecordBatch:
            archive.close()
            out.close()
            system.move(private, f"{root}/part-{task:06d}-{k:05d}.tar")
            return pa.RecordBatch.from_pydict({"members": pa.array([n], pa.int64())})

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    private = f"{root}/_{uuid.uuid4().hex}"
                    out = system.open_output_stream(private)
                    archive = tarfile.open(fileobj=out, mode="w|")
                info = tarfile.TarInfo(name)
                info.size = len(data or b"")
                archive.addfile(info, pa.BufferReader(data or b""))
                archive.members.clear()
                n += 1
                if n >= per_archive:
                    yield close()
                    k, n, archive = k + 1, 0, None
        if archive is not None:
            yield close()

    return rows.select(member, F.col(payload).cast("binary")).mapInArrow(run, "members bigint").count()
