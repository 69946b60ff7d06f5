"""Changes applied to stored tables: an ordered fold by key, and only the partitions that it touches are written anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import delete, materialize

INSERT, UPDATE, DELETE = "insert", "update", "delete"
BUCKET = "_bucket"


def folded(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key with what its events (key, seq, op and columns) come to: kind (put, patch or delete) and a struct of seq and value for each column.

    Events count in the order of seq. ``insert`` sets all columns, of a key that is there as well; ``update`` sets those that aren't null and does nothing for a
    key that isn't there; ``delete`` removes. So what counts is the last insert or delete, and for each column the last value behind
    it: all of it greatest values, so that events of a hot key are combined before they are shuffled. Events with a null key, seq or unknown op are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col("seq").isNotNull() & F.col("op").isin(INSERT, UPDATE, DELETE))
    reset = F.max(F.when(F.col("op") != UPDATE, F.struct("seq", "op"))).alias("_reset")
    last = [F.max_by(F.when(F.col("op") != DELETE, F.struct(F.col("seq").alias("seq"), F.col(c).alias("value"))), F.when((F.col("op") != DELETE) & F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns]
    kind = F.when(F.col("_reset").isNull(), "patch").when(F.col("_reset.op") == DELETE, "delete").otherwise("put")
    since = lambda c: F.when(F.col("_reset").isNull() | (F.col(f"{c}.seq") >= F.col("_reset.seq")), F.col(f"{c}.value"))
    return rows.groupBy(key).agg(reset, *last).select(key, kind.alias("_kind"), *[since(c).alias(c) for c in columns])


@dataclass(frozen=True)
class StoredTable:
    """A Parquet table under ``path``, dealt into ``buckets`` partitions by a hash of its key."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 64

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> StoredTable:
        """Write the table anew. Of rows with one key, each is kept."""
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        self._dealt(named).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def apply(self, events: DataFrame) -> list[int]:
        """Apply events to the table and return the partitions that were written. Others are neither read nor written.

        The touched partitions are put together in the shared folder first and then put in place of the old ones; partitions left
        without rows are deleted. Applying the same events once more, as after a failure in between, ends in the same table, unless updates among them follow a delete or precede an insert of their key.
        """
        columns = [f.name for f in self.schema if f.name != self.key]
        net = materialize(self._dealt(folded(events, self.key, columns)), "net")
        touched = sorted(r[0] for r in net.select(BUCKET).distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        old = self._stored().where(F.col(BUCKET).isin(touched))
        n, o = net.alias("n"), old.withColumn("_there", F.lit(True)).alias("o")
        both = o.join(n, F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full")
        there, kind = F.coalesce(F.col("o._there"), F.lit(False)), F.coalesce(F.col("n._kind"), F.lit("none"))
        value = lambda c: F.when(kind == "put", F.col(f"n.{c}")).when(kind == "patch", F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}"))
        kept = both.where((there & (kind != "delete")) | (kind == "put"))
        fresh = kept.select(*[(F.coalesce(f"o.{self.key}", f"n.{self.key}") if f.name == self.key else value(f.name)).cast(f.dataType).alias(f.name) for f in self.schema], F.coalesce(f"o.{BUCKET}", f"n.{BUCKET}").alias(BUCKET))
        fresh = materialize(fresh, "fresh")
        left = {r[0] for r in fresh.select(BUCKET).distinct().collect()}
        fresh.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for b in touched:
            if b not in left:
                delete(self.spark, f"{self.path}/{BUCKET}={b}")
        return touched

    def reset(self) -> None:
        """Empty the table; its schema stays."""
        self.create(self.spark.createDataFrame([], self.schema))


def reset_all(tables: dict[str, StoredTable], templates: str, universal: DataFrame) -> None:
    """Empty all stored tables; that of ``templates`` keeps the ``universal`` row alone."""
    for name, table in tables.items():
        if name == templates:
            table.create(universal)
        else:
            table.reset()
