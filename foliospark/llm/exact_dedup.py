"""Exact deduplication by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK, materialize

#: A text on more rows than this, and than one in MOST_HOT of all rows, is hot: its rows are spread over runs of about that size.
HOT_ROWS, MOST_HOT = 256, 100_000
#: Characters of the text that splitters carry; the digest and the full text decide behind them.
PREFIX = 32


def exact_dedup(docs: DataFrame, payload: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find equal texts by sorting the normalised contents.

    Texts are equal when identical after deleting every space and U+0009..U+000D.
    The rows are range-partitioned by (first characters, SHA-256, salt) with the
    splitters that Spark samples, sorted on disk by that and the full normalised
    text, and neighbours are compared in full by the window that runs along the
    sorted rows. Of equal texts the longest original (code points) stays, then the
    smallest identifier.

    A text with very many copies would be one run in one task. The copies of every text are counted
    first, by a hash and with partial sums; rows of hot texts are spread over as many runs as bound their
    length, by a hash of identifier and place in the input (which is to come from files, so that a repeated task reads
    rows in the same order). The runs' heads are sorted and compared once more. At most MOST_HOT texts are hot, and the hash decides only how rows are spread.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    and ``payload``, a struct of the named input columns, if any are named.

    Nulls: a null text counts as empty; a null identifier loses against any other.
    Empty texts, or texts of white space only, are equal to one another. Rows that
    repeat both identifier and text are copies of one another, and one of them stays.
    Other input columns, whatever their names, are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANK, "")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        norm.alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
        *([F.struct(*[F.col(f"`{c}`") for c in payload]).alias("payload")] if payload else []),
    ).withColumn("sha", F.sha2("norm", 256))
    most = max(HOT_ROWS, docs.count() // MOST_HOT)
    hot = (
        docs.select(F.xxhash64(norm).alias("hot")).groupBy("hot").agg(F.count("*").alias("n")).where(F.col("n") > most)
        .select("hot", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    )
    hot = materialize(hot, "hot")
    keyed = (
        rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), F.xxhash64("norm") == F.col("hot"), "left")  # MOST_HOT rows at most
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), F.col("salts")), F.lit(0))).drop("place")
        .withColumn("prefix", F.substring("norm", 1, PREFIX))
    )
    order = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = keyed.repartitionByRange("prefix", "sha", "salt")
    run = Window.partitionBy("prefix", "sha", "salt", "norm").orderBy(*order)
    along = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "doc_id", "sha", "prefix", "chars", "hot", "salt",
        F.row_number().over(run).alias("place"),
        F.first("doc_id").over(along).alias("run_keep"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
        "norm", *(["payload"] if payload else []),
    ).withColumn("norm", F.when(F.col("hot").isNotNull() & (F.col("place") == 1), F.col("norm")))
    runs = materialize(runs, "runs")
    heads = runs.where("norm is not null").repartitionByRange("prefix", "sha")
    of_text = Window.partitionBy("prefix", "sha", "norm").orderBy(*order, "salt")
    texts = heads.select(
        F.col("sha").alias("text_sha"),
        F.col("doc_id").alias("text_keep"),
        F.col("salt").alias("text_salt"),
        F.row_number().over(of_text).alias("place"),
        F.sum("run_size").over(of_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("text_size"),
    ).where("place = 1").drop("place")
    joined = runs.join(F.broadcast(texts), F.col("sha") == F.col("text_sha"), "left")  # a row for each hot text
    is_hot = F.col("text_sha").isNotNull()
    keep = F.when(is_hot, F.col("text_keep")).otherwise(F.col("run_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(is_hot, F.col("text_size")).otherwise(F.col("run_size")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (~is_hot | (F.col("salt") == F.col("text_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["payload"] if payload else []),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns."""
    return exact_dedup(docs, payload=tuple(docs.columns)).where("kept").select(*[F.col("payload").getField(c).alias(c) for c in docs.columns])
