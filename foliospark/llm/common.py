"""Helpers shared by the operators: tables, bounded batches, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship_package
from ..storage import materialize, scratch, shared_dir, small_enough  # noqa: F401

#: White space of the contracts: space and U+0009 to U+000D.
BLANK = "[\\x20\\x09-\\x0D]"
#: Rows and bytes of texts that go to a Python worker at a time; Spark's own settings are kept where they are lower.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches to BATCH: rows here hold whole texts, and the default of 10,000 rows a batch takes hundreds of MB in each worker."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not str(now).lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """Whether ``crc32`` of the identifier as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def broadcast(df: DataFrame, value):
    """A broadcast variable for tasks over ``df``; the tasks can import this package and get batches of bounded size."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(value)


#: A node with more edges than this, and than one in MOST_HUBS of all ends of edges, has its edges spread over tasks.
HUB_EDGES, MOST_HUBS = 1000, 100_000


def _moved_to_least(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """Edges (u, v) with the m of their u from ``least`` (u, m, n: how many edges u has).

    Hubs, nodes of more than ``limit`` edges, have these spread by a salt over groups of about ``limit``;
    as many copies of the hub's row are joined to them. There are at most MOST_HUBS hubs, which are broadcast.
    """
    groups = F.ceil(F.col("n") / limit).cast("int")
    hubs = least.where(F.col("n") > limit).select(F.col("u").alias("hub"), groups.alias("groups"))
    salted = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("groups")), F.lit(0)).cast("int").alias("salt"))
    copies = least.select("u", "m", F.explode(F.sequence(F.lit(0), groups - 1)).alias("salt"))
    return salted.join(copies, ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: one row (node, component) for each node
    that has an edge to another one; component is the smallest node reachable.

    Alternates large-star and small-star steps: each node is linked to the smallest
    neighbour, until every node is linked to its root. Each step is an aggregate and
    an equi-join that spreads the edges of a hub over many tasks; the edges are
    written to the shared folder after each round. Null ends, self-loops and repeated
    edges are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    current = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, now = None, (current.count(),)
    while True:
        limit = max(HUB_EDGES, 2 * now[0] // MOST_HUBS)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _moved_to_least(both.where("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _moved_to_least(large, root, limit).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        current = materialize(small, "edges")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
