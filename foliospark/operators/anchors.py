"""Anchors: texts at fixed places, found by fuzzy search over windows of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.geometry import band
from ..functions.sequences import window_search
from ..functions.text import normal_anchor, normal_anchors, normal_value, normal_values
from ..storage import small_enough
from .layout import gathered, met_by_page, unfolded

#: Most anchors of all templates that are sent to every task.
MOST_ANCHORS = 200_000

#: The score from which a value counts as found.
LEAST = 0.6


def _ordered(words: DataFrame, norms: Callable[[Column], Column], *more: str) -> DataFrame:
    """doc_id, page, more, ws, norms: the words of each page in reading order, and their normal forms; a page has a bounded number."""
    pages = gathered(words, lambda c: F.struct(band(c("y")).alias("band"), *[c(name) for name in ("x", "word_no", "y", "w", "h", "text")]), *more)
    return pages.withColumn("norms", norms(F.transform("ws", lambda v: v["text"])))


def _searched(pairs: DataFrame, glue: str, target_first: bool, least: float = 0.0) -> DataFrame:
    """A row for each of a page's targets, with best (score, size, start) and the box of the best window, null where nothing scores. A page is searched once for all of them."""
    part = lambda f: F.transform("ws", lambda v: v[f])
    of = lambda f: F.transform("targets", lambda t: t[f])
    found = pairs.withColumn("bests", window_search(of("target"), F.col("norms"), F.when(F.col("tol").isNotNull(), part("y")), of("sizes"), F.col("tol"), glue, target_first, least))
    found = found.withColumn("hits", F.zip_with("targets", "bests", lambda t, b: F.struct(t.alias("target"), b.alias("best")))).drop("targets", "bests")
    found = unfolded(found, "hits", "nth", "hit").drop("hits", "nth")
    found = found.select("*", "hit.target.*", "hit.best").drop("hit")
    found = found.withColumn("win", F.when(F.col("best.score") > 0, F.slice("ws", F.col("best.start") + 1, F.col("best.size"))))
    edge = lambda f, g: f(F.transform("win", g))
    x, y = edge(F.array_min, lambda v: v["x"]), edge(F.array_min, lambda v: v["y"])
    box = F.struct(x.alias("x"), y.alias("y"), (edge(F.array_max, lambda v: v["x"] + v["w"]) - x).alias("w"), (edge(F.array_max, lambda v: v["y"] + v["h"]) - y).alias("h"))
    return found.withColumn("box", F.when(F.col("win").isNotNull(), box))


def find_text_anchors(words: DataFrame, anchors: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The best window of each page for each anchor of its template: doc_id, page, anchor_id, score, found, box.

    words carry template_id; anchors: template_id, anchor_id, anchor_text. Windows have as many words as the anchor, one less
    or one more. Ties go to the smaller size, then the first window; an empty anchor and a page without a window that scores give 0 and no box.
    """
    pages = _ordered(words, normal_anchors, "template_id")
    targets = anchors.select("template_id", "anchor_id", normal_anchor(F.col("anchor_text")).alias("target")).withColumn("n", F.size(F.split("target", " ")))
    targets = targets.withColumn("sizes", F.when(F.col("target") == "", F.array().cast("array<int>")).otherwise(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)))
    lists = targets.groupBy("template_id").agg(F.collect_list(F.struct("anchor_id", "target", "sizes")).alias("targets"))
    pairs = pages.join(F.broadcast(lists) if small_enough(anchors, MOST_ANCHORS) else lists, "template_id").withColumn("tol", F.lit(None).cast("double"))
    found = _searched(pairs, " ", True)
    return found.select("doc_id", "page", "anchor_id", F.round("best.score", 4).alias("score"), (F.col("best.score") >= config.anchor_text_threshold).alias("found"), "box")


def find_values(words: DataFrame, values: DataFrame) -> DataFrame:
    """Where on its page a value stands: doc_id, page, value, score, box, for values found with a score of LEAST or more.

    values: doc_id, page, value. A window lies on one row (its y spread is at most 1.2 times the upper median of heights)
    and has up to two words more than the value; one more than twice as long as the value counts 0.7 times.
    """
    pages = _ordered(words, normal_values)
    heights = "array_sort(filter(transform(ws, v -> v.h), h -> h > 0))"
    pages = pages.withColumn("tol", F.expr(f"coalesce(get({heights}, cast(size({heights}) / 2 as int)) * 1.2, 2000.0)"))
    targets = values.distinct().withColumn("target", normal_value(F.col("value"))).where("target <> ''")
    tokens = F.filter(F.split("value", "[ \\t\\n\\r]+"), lambda t: normal_value(t) != "")
    targets = targets.withColumn("sizes", F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens)) + 2))
    pairs = met_by_page(pages, targets, "targets")
    found = _searched(pairs, "", False, LEAST)
    return found.where(F.col("best.score") >= LEAST).select("doc_id", "page", "value", F.round("best.score", 4).alias("score"), "box")


def anchor_scores(located: DataFrame) -> DataFrame:
    """doc_id, page, score, required_ok from located anchors (found, weight, required).

    The found share of weights; a missing or zero weight counts as 1 and a negative one as 0. All required anchors must be found.
    """
    weight = F.greatest(F.lit(0.0), F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")))
    rows = located.withColumn("wt", weight)
    return rows.groupBy("doc_id", "page").agg(
        F.coalesce(F.floor(F.sum(F.when(F.col("found"), F.col("wt")).otherwise(0.0)) / F.nullif(F.sum("wt"), F.lit(0.0)) * 10_000 + 0.5) / 10_000, F.lit(0.0)).alias("score"),
        F.coalesce(F.bool_and(F.col("found") | ~F.col("required")), F.lit(True)).alias("required_ok"),
    )


def best_orientation(tried: DataFrame) -> DataFrame:
    """Of several orientations (ord, n_found, rectifiable, score) of a page the one with most anchors, then rectifiable, then the score; ties go to the first."""
    key = F.struct("n_found", F.col("rectifiable").cast("int"), "score", -F.col("ord"))
    return tried.groupBy("doc_id", "page").agg(F.max_by(F.struct("ord", "n_found", "rectifiable", "score"), key).alias("b")).select("doc_id", "page", "b.*")


def shift(pairs: DataFrame) -> DataFrame:
    """The median shift of matched anchors (src_x, src_y, dst_x, dst_y), null if it is under a pixel both ways or over 15 % of the long side."""
    moved = pairs.groupBy("doc_id", "page").agg(F.median(F.col("src_x") - F.col("dst_x")).alias("dx"), F.median(F.col("src_y") - F.col("dst_y")).alias("dy"), F.max(F.greatest("width", "height")).alias("side"))
    use = ((F.abs("dx") >= 1) | (F.abs("dy") >= 1)) & (F.greatest(F.abs("dx"), F.abs("dy")) <= 0.15 * F.col("side"))
    return moved.select("doc_id", "page", F.when(use, F.col("dx")).alias("dx"), F.when(use, F.col("dy")).alias("dy"))


def anchor_pairs(located: DataFrame) -> DataFrame:
    """doc_id, page, src_x, src_y, dst_x, dst_y: the centres of found anchors in the template's sample and on the page (twice the centre of each, so that numbers stay whole)."""
    centre = lambda b: ((2 * F.col(f"{b}.x") + F.col(f"{b}.w")), (2 * F.col(f"{b}.y") + F.col(f"{b}.h")))
    (sx, sy), (dx, dy) = centre("source"), centre("target")
    return located.where("found and source is not null and target is not null").select("doc_id", "page", sx.alias("src_x"), sy.alias("src_y"), dx.alias("dst_x"), dy.alias("dst_y"))


def text_orientation(tried: DataFrame) -> DataFrame:
    """doc_id, page, angle, score: the angle at which the greatest share of weight of text anchors (angle, found, weight) is found; ties go to the smaller angle."""
    weight = F.greatest(F.lit(0.0), F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")))
    share = tried.withColumn("wt", weight).groupBy("doc_id", "page", "angle").agg(F.coalesce(F.sum(F.when(F.col("found"), F.col("wt")).otherwise(0.0)) / F.nullif(F.sum("wt"), F.lit(0.0)), F.lit(0.0)).alias("score"))
    return share.groupBy("doc_id", "page").agg(F.max_by(F.struct("angle", "score"), F.struct("score", -F.col("angle"))).alias("b")).select("doc_id", "page", "b.angle", (F.floor(F.col("b.score") * 10_000 + 0.5) / 10_000).alias("score"))


def best_candidate(items: DataFrame, candidates: list, score, *key: str) -> DataFrame:
    """key, candidate, score: of several candidates (such as angles) the one with the highest score by a function of the candidate's column, the first of equals."""
    tried = items.withColumn("c", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("candidate")) for n, c in enumerate(candidates)]))).withColumn("score", score(F.col("c.candidate")))
    return tried.groupBy(*key).agg(F.max_by(F.struct("c.candidate", "score"), F.struct("score", -F.col("c.n"))).alias("b")).select(*key, "b.candidate", "b.score")


def upper_median(values: Column) -> Column:
    """The element behind the middle of a list in order, null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def located_summary(located: DataFrame) -> DataFrame:
    """doc_id, page, n_found, n, all_found of located anchors."""
    return located.groupBy("doc_id", "page").agg(F.count_if("found").alias("n_found"), F.count("*").alias("n"), F.bool_and("found").alias("all_found"))
