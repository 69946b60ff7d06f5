"""Token files: Parquet with a list of ids for each document, readable in part."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package
from .word_tokens import encoder

END_ID = 2
#: Row groups of so many bytes and pages of so many rows and bytes: a reader of a few documents skips the rest by the page index.
ROW_GROUP, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 1000
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "v2",  # DELTA_BINARY_PACKED wherever there is no dictionary
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write token files in ascending order of identifiers.

    The rows are range-partitioned and sorted by identifier, then text (nulls first), so that the
    files follow one another; a file's rows carry its number (part) and the count of
    ids before the row in the file (local_start). Columns: doc_id, part, local_start,
    n_tokens (delta encoded), ids (dictionary encoded). A null text counts as empty.
    Repeated rows are written as often as they occur, other columns are not read, and
    an empty table gives files without rows.
    """
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, enc, end = TaskContext.get().partitionId(), 0, encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                ids = [x + end for x in enc.encode(some.column(1).fill_null("").to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                cut = np.concatenate(([0], np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part)), pa.array(before + cut[:-1]), pa.array(n), lists], schema=schema)
                before += int(cut[-1])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encoded, "doc_id long, part long, local_start long, n_tokens long, ids array<int>").write.options(**FORMAT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with start, the count of ids of all documents before: doc_id, start, n_tokens, ids.

    Reading some columns, or a range of doc_id, reads only those columns and pages.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    base = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens as counted from ids, and ids_crc32 over little-endian unsigned 32-bit ids."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            cut = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cut).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
