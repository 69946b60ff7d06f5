"""Fields of a template, read from the words that lie in their regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.geometry import band, contains_centre, transformed
from ..storage import small_enough
from .layout import gathered

#: Most fields of all templates that are sent to every task; beyond that the join shuffles.
BROADCAST_FIELDS = 200_000
#: What is kept of a word, behind its band.
WORD = ("x", "word_no", "text", "conf", "y", "w", "h")


def page_words(words: DataFrame, *more: str) -> DataFrame:
    """doc_id, page, ws: the words of each page in reading order, and further columns that are the same for all words of a page."""
    return gathered(words, lambda c: F.struct(band(c("y")).alias("band"), *[c(name) for name in WORD]), *more)


def extract_fields(words: DataFrame, fields: DataFrame, padded: bool = True) -> DataFrame:
    """One row for each page and field of its template.

    words: doc_id, page, template_id, word_no, text, conf, box columns. fields: template_id, key, fx, fy, fw, fh.
    The value joins the words in reading order; it is empty and the box null where no word lies in the region.
    """
    return fields_of_pages(page_words(words, "template_id"), fields, padded)


def fields_of_pages(pages: DataFrame, fields: DataFrame, padded: bool = True) -> DataFrame:
    """The same for pages (doc_id, page, template_id, ws).

    Words are gathered by page once, which is the only shuffle: a page meets the list of its template's fields, which is
    sent to all tasks if there are at most BROADCAST_FIELDS of them, and each field filters the page's words.
    """
    box = F.struct(F.col("fx").alias("x"), F.col("fy").alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h"))
    lists = fields.groupBy(F.col("template_id").alias("_t")).agg(F.collect_list(F.struct("key", box.alias("box"))).alias("fs"))
    met = pages.join(F.broadcast(lists) if small_enough(fields, BROADCAST_FIELDS) else lists, F.col("template_id") == F.col("_t"))
    each = met.select("doc_id", "page", "ws", F.explode("fs").alias("f")).select("doc_id", "page", "f.key", F.filter("ws", lambda w: contains_centre(w, F.col("f.box"), padded)).alias("ws"))
    some, n = F.size("ws") > 0, F.size("ws")
    low = lambda c: F.array_min(F.transform("ws", lambda w: w[c]))
    far = lambda c, s: F.array_max(F.transform("ws", lambda w: w[c] + w[s]))
    total = F.aggregate("ws", F.lit(0.0), lambda s, w: s + w["conf"])
    return each.select(
        "doc_id", "page", "key",
        F.trim(F.array_join(F.transform("ws", lambda w: w["text"]), " ")).alias("value"),
        F.when(some, F.floor((20 * total + n) / (2 * n)) / 10).otherwise(0.0).alias("confidence"),
        n.cast("long").alias("n_words"), low("x").alias("x"), low("y").alias("y"), (far("x", "w") - low("x")).alias("w"), (far("y", "h") - low("y")).alias("h"),
    )


def weak_fields(values: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Fields worth a second reading: blank, or read with little confidence."""
    return values.where(is_weak(config))


def is_weak(config: EngineConfig = EngineConfig()) -> Column:
    return (F.trim("value") == "") | (F.col("confidence") < config.refine_below)


def better_values(values: DataFrame, again: DataFrame) -> DataFrame:
    """Replace values by second readings (doc_id, page, key, new_value, new_confidence) that have text and are no worse, or fill a blank."""
    return better_readings(values.join(again, ["doc_id", "page", "key"], "left"))


def better_readings(values: DataFrame) -> DataFrame:
    """The same for values with their second readings beside them (new_value and new_confidence, null where there is none): nothing is joined or shuffled."""
    taken = (F.coalesce(F.trim("new_value"), F.lit("")) != "") & ((F.trim("value") == "") | (F.col("new_confidence") >= F.col("confidence")))
    return values.select(
        "doc_id", "page", "key", F.when(taken, F.col("new_value")).otherwise(F.col("value")).alias("value"),
        F.when(taken, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.coalesce(taken & (F.col("value") != F.col("new_value")), F.lit(False)).alias("replaced"),
    )


def text_in_regions(words: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, page, key, value: the words whose centres lie in each field of the page's template, without padding, from top to bottom by their exact y, then x."""
    pages = gathered(words, lambda c: F.struct(c("y").alias("band"), *[c(name) for name in WORD]), "template_id")
    return fields_of_pages(pages, fields, padded=False).select("doc_id", "page", "key", "value")


def transformed_fields(pages: DataFrame, fields: DataFrame, padded: bool = True) -> DataFrame:
    """The values of fields whose regions each page's transform carries onto it: pages (doc_id, page, template_id, ws, matrix, width, height in pixels), fields as above.

    A region becomes the box around its transformed corners; a page without a matrix takes the regions as they are.
    """
    box = F.struct(*[F.col(f"f{c}").cast("double").alias(c) for c in "xywh"])
    met = pages.join(F.broadcast(fields) if small_enough(fields, BROADCAST_FIELDS) else fields, "template_id")
    moved = F.when(F.col("matrix").isNotNull(), transformed(box, F.col("matrix"), F.col("width"), F.col("height"))).otherwise(F.struct(*[F.col(f"f{c}").alias(c) for c in "xywh"]))
    hits = met.withColumn("box", moved).withColumn("ws", F.filter("ws", lambda w: contains_centre(w, F.col("box"), padded)))
    return hits.select("doc_id", "page", "key", F.trim(F.array_join(F.transform("ws", lambda w: w["text"]), " ")).alias("value"), F.size("ws").cast("long").alias("n_words"))
