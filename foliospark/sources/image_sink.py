"""Files, one a row, written in two phases together with the rows that refer to them."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..cluster import ship_package

#: Folders of tasks that are under way, of tasks that were committed, and the table of references in each.
UNDER_WAY, DONE, REFERENCES = "_attempt", "part", "references.parquet"
SCHEMA = "key string, suffix string, content binary"
REFERENCE = pa.schema([("key", pa.string()), ("file", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string())])


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    part: str
    files: int


class FileSink(DataSource):
    """Format ``files``: writes the rows of SCHEMA as files under option ``path``. Null contents write no file."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(self.options["path"], uuid.uuid4().hex, overwrite)


class _FileWriter(DataSourceArrowWriter):
    """A task writes its files and their references into a folder of its own; commit renames these folders, one a task, and abort deletes them.

    A task that fails deletes its folder. What a lost executor leaves behind is under a name that readers pass over, and goes with the job's commit or abort.
    """

    def __init__(self, path: str, job: str, overwrite: bool):
        self.path, self.job, self.overwrite = path.rstrip("/"), job, overwrite

    def _open(self) -> tuple[pafs.FileSystem, str]:
        files, root = pafs.FileSystem.from_uri(self.path if re.match(r"[a-z0-9]+:/", self.path) else "file://" + self.path)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = self._open()
        task = TaskContext.get()
        part = f"{task.partitionId():06d}-{self.job}"
        folder = f"{root}/{UNDER_WAY}-{part}-{task.taskAttemptId()}"
        files.create_dir(folder, recursive=True)
        rows: list[tuple] = []
        try:
            for batch in iterator:
                for key, suffix, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    raw = content.as_py()
                    if raw is None:
                        continue
                    name = f"{len(rows):08d}-{hashlib.sha256((key or '').encode()).hexdigest()[:16]}.{suffix or 'bin'}"  # keys can hold what no file's name may
                    with files.open_output_stream(f"{folder}/{name}") as out:
                        out.write(raw)
                    rows.append((key, f"{DONE}-{part}/{name}", len(raw), hashlib.sha256(raw).hexdigest()))
            table = pa.table([pa.array([r[k] for r in rows], REFERENCE.field(k).type) for k in range(4)], schema=REFERENCE)
            with files.open_output_stream(f"{folder}/{REFERENCES}") as out:
                pq.write_table(table, out)
        except BaseException:
            files.delete_dir(folder)
            raise
        return _Written(folder, part, len(rows))

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = self._open()
        files.create_dir(root, recursive=True)
        old = [f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith(f"{DONE}-")] if self.overwrite else []
        for m in messages:
            if m is not None:
                files.move(m.folder, f"{root}/{DONE}-{m.part}")
        for folder in old:
            files.delete_dir(folder)
        self._clear(files, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, files: pafs.FileSystem, root: str) -> None:
        for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"{UNDER_WAY}-") and self.job in f.base_name:
                files.delete_dir(f.path)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of key, suffix and content as files under ``path``, all or none of them; ``overwrite`` puts them in place of those that are there.

    ``path`` is a folder that all executors reach: of a shared mount, or of a store that pyarrow opens.
    Repeated keys are files each; a null key is kept; rows without content are left out; an empty table writes no file.
    """
    ship_package(rows.sparkSession)
    rows.sparkSession.dataSource.register(FileSink)
    rows.select(F.col("key").cast("string").alias("key"), F.col("suffix").cast("string").alias("suffix"), F.col("content").cast("binary").alias("content")).write.format("files").mode(mode).option("path", path).save()


def references(spark: SparkSession, path: str) -> DataFrame:
    """key, file (under ``path``), n_bytes and sha256 of the files that were committed."""
    return spark.read.schema("key string, file string, n_bytes long, sha256 string").parquet(f"{path}/{DONE}-*/{REFERENCES}")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """references with the content of each file; null for one that is gone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*-*.*").load(f"{path}/{DONE}-*").select(F.regexp_extract("path", f"({DONE}-[^/]*/[^/]*)$", 1).alias("file"), "content")
    both = references(spark, path).join(found, "file", "left")
    return both.withColumn("content", F.coalesce("content", F.when(F.col("n_bytes") == 0, F.lit(b""))))  # Spark passes over empty files
