"""Queries through indexes: the nearest examples of all examples, and templates beyond those that fit a task."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..operators import layout, retrieval_index, template_index
from . import process
from .queries import CONFIG, SQL, _pages, _templates, _topk_sql, _vectors, fields, query, read, words


@query(_topk_sql("").replace("q.vec_id % 20 = 0", "q.vec_id IS NOT NULL"))
def rag_topk_all(spark, sf):
    """Every example as a query, over all others and itself."""
    v = _vectors(spark, sf)
    return retrieval_index.top_examples_indexed(v, v, CONFIG.top_k, by_template=False)[0]


@query(_topk_sql("AND q.label = e.label").replace("q.vec_id % 20 = 0", "q.vec_id IS NOT NULL"))
def rag_topk_all_by_template(spark, sf):
    v = _vectors(spark, sf)
    return retrieval_index.top_examples_indexed(v, v, CONFIG.top_k)[0]


@query(SQL["best_template_multi_angle"])
def best_of_many_templates(spark, sf):
    """The best template of each page and angle through groups of templates."""
    return template_index.best_of_many_templates(_pages(words(spark, sf)), _templates(spark, sf), angles=True)[0]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.4f', v) AS DOUBLE) AS four, CAST(printf('%.1f', v) AS DOUBLE) AS one, CAST(printf('%.2f', h) AS DOUBLE) AS two
    FROM (SELECT *, l_extendedprice * l_discount / 7 AS v, l_quantity * 0.125::DOUBLE + l_linenumber * 0.375::DOUBLE AS h FROM lineitem)""")
def exact_rounding(spark, sf):
    """Amounts, and eighths that lie just in the middle, rounded by their exact values."""
    rows = read(spark, sf, "lineitem").withColumn("v", F.col("l_extendedprice") * F.col("l_discount") / 7).withColumn("h", F.col("l_quantity") * 0.125 + F.col("l_linenumber") * 0.375)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[exact_round(F.col(c), d).alias(n) for c, d, n in (("v", 4, "four"), ("v", 1, "one"), ("h", 2, "two"))])


@query()
def process_with_anchors(spark, sf):
    """Documents through the whole chain: the first and the last word of each template's page are its anchors."""
    w = words(spark, sf)
    samples = layout.words_from_text(read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).where("page = 0")
    ends = samples.groupBy("doc_id").agg(F.min("word_no").alias("low"), F.max("word_no").alias("high"))
    at = samples.join(ends, "doc_id").where("word_no in (low, high)")
    found = at.select(F.col("doc_id").alias("template_id"), (F.col("doc_id") * 1000 + F.col("word_no")).alias("anchor_id"), F.col("text").alias("anchor_text"), F.lit(1.0).alias("weight"), (F.col("word_no") == F.col("low")).alias("required"), F.struct("x", "y", "w", "h").alias("source"))
    f = fields(spark).withColumnRenamed("template_id", "third")
    f = read(spark, sf, "benchmark").select(F.col("item_id").alias("template_id")).distinct().join(F.broadcast(f), F.pmod("template_id", F.lit(3)) == F.col("third")).drop("third")
    done = process.process_whole(w, _pages(w), _templates(spark, sf), f, found)
    pairs = F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done.withColumn("data", F.array_join(pairs, "; ")).withColumn("avg_confidence", F.round("avg_confidence", 4))
