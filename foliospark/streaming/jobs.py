"""Jobs as a stream: documents that arrive in a folder become records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100, names: str = "*", delete: bool = False) -> DataFrame:
    """The Parquet files that arrive in a folder under matching names; with ``delete`` a file is removed once its batch is done."""
    return spark.readStream.schema(schema).option("cleanSource", "delete" if delete else "off").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(path)


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of them."""
    name = path.rstrip("/")
    # Spark takes the path of a plain stream for a folder; a pattern that only this name matches can be either
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{name[:-1]}[{name[-1]}]")


def run_jobs(documents: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Process every batch of documents into records under ``target``/batch=<number>.

    A batch that is repeated after a failure overwrites its own folder, so records are
    written once. Runs over what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(changes: DataFrame) -> DataFrame:
    """The state of each job after changes (job_id, at, status): confirmed stays, otherwise the last one counts; ties go to the later status by name."""
    rank = F.when(F.col("status") == "confirmed", 1).otherwise(0)
    return changes.groupBy("job_id").agg(F.max_by("status", F.struct(rank, "at", "status")).alias("status"), F.count("*").alias("changes"))


def counts_by_window(events: DataFrame, every: str, delay: str, at: str = "ts") -> DataFrame:
    """An extension: events by tumbling windows, with a watermark for late ones."""
    return events.withWatermark(at, delay).groupBy(F.window(at, every), "event_type").agg(F.count("*").alias("n"))
