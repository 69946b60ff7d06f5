"""Whole chains: pages to matched templates to values to records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.geometry import PAGE
from ..operators.anchors import anchor_pairs, anchor_scores, find_text_anchors
from ..operators.answers import KIND_KEY, extract_free, extract_with_examples, model_suggestions
from ..operators.extract import BROADCAST_FIELDS, better_values, fields_of_pages, page_words, weak_fields
from ..operators.layout import document_text, met_by_page
from ..operators.lines import code_values, group_lines, labelled_values, merge_suggestions, TABLE_TOLERANCE
from ..operators.matching import accepted, best_of_templates
from ..operators.records import merged_data, needs_review, status
from ..operators.transforms import consensus_fit
from ..sources.providers import Provider
from ..storage import materialize, small_enough


def match_pages(pages: DataFrame, templates: DataFrame, config: EngineConfig = EngineConfig(), angles: bool = True, universal: int | None = None) -> DataFrame:
    """doc_id, page, template_id, angle, score: the best template; where no match is accepted the ``universal`` one (or null) with score 0."""
    pages = materialize(pages, "signatures")  # read once to be compared and once to be kept
    best = best_of_templates(pages, templates, angles)
    ok = F.coalesce(accepted(F.col("score"), F.lit(0.0), config), F.lit(False))
    found = pages.select("doc_id", "page").join(best, ["doc_id", "page"], "left")
    return found.select("doc_id", "page", F.when(ok, F.col("template_id")).otherwise(F.lit(universal)).cast("long").alias("template_id"), F.when(ok, F.col("angle")).otherwise(0).alias("angle"), F.when(ok, F.col("score")).otherwise(0.0).alias("score"))


def process(words: DataFrame, pages: DataFrame, templates: DataFrame, fields: DataFrame, template_id: int | None = None, config: EngineConfig = EngineConfig(), universal: int | None = None) -> DataFrame:
    """A record for each page: template, score, values, average confidence and status.

    A template given by the caller skips the search and the acceptance rule. Pages without an accepted one get the ``universal``
    template; without fields they need a review. Words are gathered by page once; matching and values read that.
    """
    if template_id is None:
        match = match_pages(pages, templates, config, universal=universal)
    else:
        match = pages.select("doc_id", "page", F.lit(template_id).cast("long").alias("template_id"), F.lit(0).alias("angle"), F.lit(1.0).alias("score"))
    match = materialize(match, "match")
    known = met_by_page(page_words(words), match.where("template_id is not null").select("doc_id", "page", "template_id"), "of")
    values = fields_of_pages(known.withColumn("template_id", F.col("of")[0]["template_id"]), fields)
    read = values.groupBy("doc_id", "page").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("data"),
        F.avg(F.when(F.col("value") != "", F.col("confidence"))).alias("avg_confidence"),
    )
    rows = match.join(read, ["doc_id", "page"], "left")
    rows = rows.withColumn("data", F.coalesce("data", F.create_map().cast("map<string,string>"))).withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))
    has = F.col("template_id").isNotNull()
    review = needs_review(F.col("data"), has, F.col("score"), F.col("avg_confidence"), ~has, config)
    return rows.withColumn("status", status(review, F.lit(None).cast("string")))


def suggest_fields(words: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Fields suggested for each page: doc_id, page, place, key, box, origin (0 or, from the table rows, 1), source.

    Those of a model come first; a page for which it has none, or without a provider every page, has labelled values. The
    code values that overlap none of them follow. source is ``model`` or ``rules``, with ``+table`` where a page has code values.
    """
    if "ws" not in words.columns:
        words = materialize(words.select("doc_id", "page", "word_no", "text", "conf", "x", "y", "w", "h"), "words")
    first = labelled_values(group_lines(words)).select("doc_id", "page", "ordinal", "key", "box", F.lit("rules").alias("source"))
    if provider is not None:
        model = materialize(model_suggestions(words, provider).select("doc_id", "page", "ordinal", "key", "box", F.lit("model").alias("source")), "suggested")
        first = model.unionByName(first.join(model.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti"))
    first = materialize(first, "first")
    second = materialize(code_values(group_lines(words, TABLE_TOLERANCE)).select("doc_id", "page", "ordinal", "key", "box"), "second")
    by_page = first.groupBy("doc_id", "page").agg(F.min("source").alias("source")).join(second.groupBy("doc_id", "page").agg(F.count("*").alias("n")), ["doc_id", "page"], "full")
    by_page = by_page.select("doc_id", "page", F.concat(F.coalesce("source", F.lit("rules")), F.when(F.col("n") > 0, "+table").otherwise("")).alias("source"))
    return merge_suggestions(first.drop("source"), second).join(by_page, ["doc_id", "page"])


#: Units of a page to a unit of fitted transforms, so that a page is 1,000 wide and the fit's limit in pixels fits.
UNIT = PAGE // 1000
#: Pages of a document that models can be asked about one by one.
MOST_PAGES = 1 << 20


def rectify(words: DataFrame, anchors: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """The words of pages (with template_id) moved into the frame of their template's sample, and a row for each page whose template has anchors.

    anchors: template_id, anchor_id, anchor_text, weight, required and source (a box in the sample). Their texts are located on the page, and the
    consensus fit of their centres carries the page onto the sample. Pages without a fit, or that lack a required anchor, keep their words. The rows: doc_id, page, anchor_score, aligned, kind, scale, angle.
    """
    found = find_text_anchors(words, anchors, config).join(F.broadcast(anchors.select("anchor_id", "weight", "required", "source")) if small_enough(anchors, BROADCAST_FIELDS) else anchors.select("anchor_id", "weight", "required", "source"), "anchor_id")
    found = materialize(found, "anchors")
    scores = anchor_scores(found).withColumnRenamed("score", "anchor_score")
    near = anchor_pairs(found.withColumnRenamed("box", "target"))
    pixels = lambda c: F.col(c) / (2.0 * UNIT)
    fit = consensus_fit(near.select("doc_id", "page", pixels("dst_x").alias("src_x"), pixels("dst_y").alias("src_y"), pixels("src_x").alias("dst_x"), pixels("src_y").alias("dst_y")), config)
    told = scores.join(fit, ["doc_id", "page"], "left").withColumn("aligned", F.coalesce(F.col("required_ok") & F.col("matrix").isNotNull(), F.lit(False)))
    told = materialize(told.select("doc_id", "page", "anchor_score", "aligned", "kind", "scale", "angle", F.when(F.col("aligned"), F.col("matrix")).alias("matrix")), "fits")
    moved = words.join(told.select("doc_id", "page", "matrix", "scale"), ["doc_id", "page"], "left")
    m, centre = (lambda i, k: F.col("matrix")[i][k]), {c: (F.col(c) + F.col(s) / 2) / UNIT for c, s in (("x", "w"), ("y", "h"))}
    size = {s: F.col(s) * F.col("scale") for s in ("w", "h")}
    at = {c: (m(i, 0) * centre["x"] + m(i, 1) * centre["y"] + m(i, 2)) * UNIT - size[s] / 2 for i, (c, s) in enumerate((("x", "w"), ("y", "h")))}
    whole = lambda v, old: F.when(F.col("matrix").isNotNull(), F.floor(v + 0.5)).otherwise(F.col(old)).cast("long").alias(old)
    boxes = [whole(at[c], c) if c in at else whole(size[c], c) for c in ("x", "y", "w", "h")]
    return moved.select(*[c for c in words.columns if c not in ("x", "y", "w", "h")], *boxes), told.drop("matrix")


def process_whole(
    words: DataFrame, pages: DataFrame, templates: DataFrame, fields: DataFrame, anchors: DataFrame, again: Callable[[DataFrame], DataFrame] | None = None,
    provider: Provider | None = None, examples: DataFrame | None = None, config: EngineConfig = EngineConfig(), universal: int | None = None,
) -> DataFrame:
    """A record for each page by the whole chain: doc_id, page, template_id, score, anchor_score, aligned, data, avg_confidence, status.

    Pages are matched to templates; where the template has anchors, their words are moved into its frame (:func:`rectify`), and a page that can't be is for review. Fields are read from regions. ``again``
    gets the weak ones (doc_id, page, key, value, confidence) and gives second readings (new_value, new_confidence), which count where they are better. With a
    ``provider`` a model is asked too, about pages of a template by its fields (template_id, key, with ord and name) and similar ``examples``, about others freely; what it answers replaces what was read, if it isn't empty. A
    page without template is for review unless the model finds values. Page numbers are below MOST_PAGES.
    """
    match = materialize(match_pages(pages, templates, config, universal=universal).select("doc_id", "page", "template_id", "score"), "match")
    known = words.join(match.where("template_id is not null").select("doc_id", "page", "template_id"), ["doc_id", "page"])
    moved, told = rectify(known, anchors, config)
    values = fields_of_pages(page_words(moved, "template_id"), fields).select("doc_id", "page", "key", "value", "confidence")
    if again is not None:
        values = materialize(values, "values")
        values = better_values(values, again(weak_fields(values, config))).drop("replaced")
    read = values.groupBy("doc_id", "page").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("data"),
        F.avg(F.when(F.col("value") != "", F.col("confidence"))).alias("avg_confidence"),
    )
    rows = match.join(told.select("doc_id", "page", "anchor_score", "aligned"), ["doc_id", "page"], "left").join(read, ["doc_id", "page"], "left")
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("data", F.coalesce("data", none)).withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))
    if provider is not None:
        rows = rows.join(_answered(words, match, fields, examples, provider, config), ["doc_id", "page"], "left").withColumn("data", merged_data(F.col("data"), F.coalesce("said", none))).drop("said")
    has = F.col("template_id").isNotNull()
    unsure = F.col("aligned").isNotNull() & ~F.col("aligned")
    return rows.withColumn("status", status(needs_review(F.col("data"), has, F.col("score"), F.col("avg_confidence"), unsure, config), F.lit(None).cast("string")))


def _answered(words: DataFrame, match: DataFrame, fields: DataFrame, examples: DataFrame | None, provider: Provider, config: EngineConfig) -> DataFrame:
    """doc_id, page, said: what a model finds, by key; the kind of a page without template under KIND_KEY."""
    texts = materialize(document_text(words).join(match.select("doc_id", "page", "template_id"), ["doc_id", "page"]), "texts")
    free = extract_free(texts.where("template_id is null").select("doc_id", "page", "text"), words, provider)
    said = free.select("doc_id", "page", "key", "value").unionByName(free.select("doc_id", "page", F.lit(KIND_KEY).alias("key"), F.col("kind").alias("value")).distinct())
    if examples is not None:
        one = lambda df: df.withColumn("doc_id", F.col("doc_id") * MOST_PAGES + F.col("page")).withColumn("page", F.lit(0).cast("long"))
        asked = one(texts.where("template_id is not null")).withColumnRenamed("template_id", "template")
        keys = fields.select(F.col("template_id").alias("template"), "ord", "key", "name")
        found = extract_with_examples(asked, one(words), keys, examples, provider, config).where("value <> ''")
        said = said.unionByName(found.select(F.floor(F.col("doc_id") / MOST_PAGES).cast("long").alias("doc_id"), F.pmod("doc_id", F.lit(MOST_PAGES)).cast("long").alias("page"), "key", "value"))
    return said.groupBy("doc_id", "page").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("said"))
