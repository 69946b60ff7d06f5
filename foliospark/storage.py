"""Storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and all of Spark runs on this machine (tests, notebooks) a temporary
    folder is made once and put into the setting; on a cluster it has to be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="folio-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{_own_part(spark)}/{uuid.uuid4().hex}/{name}"


def _own_part(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folio/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows; nothing happens if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application put into the shared folder.

    Results of operators are read from there when they are computed, so call this once they have been written.
    """
    delete(spark, _own_part(spark))


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, or to ``path``, and read it back.

    This cuts the lineage in a way that outlives lost executors, and gives the
    optimiser the true size of the result.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
