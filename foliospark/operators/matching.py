"""Signatures of pages and their best template."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship_package
from ..config import EngineConfig
from ..functions.geometry import PAGE, div_round
from ..storage import small_enough

GRID = 8
CELLS = GRID * GRID
#: Similarity weighs aspect, colour and density.
WEIGHTS = (0.25, 0.20, 0.55)
#: Angles that a template is tried at; at 90 and 270 degrees also with the inverse aspect.
TURNS = [(0, False), (90, False), (90, True), (180, False), (270, False), (270, True)]
#: Most templates that are sent to every task, and pages scored at a time.
MOST_TEMPLATES, AT_ONCE = 10_000, 16


def _cells(words: DataFrame) -> DataFrame:
    """doc_id, page, cells: a list of cells with the area of words in them, as ten-thousandths of the fullest cell."""
    c = lambda p, s: F.least(F.lit(GRID - 1), F.floor((2 * F.col(p) + F.col(s)) * GRID / (2 * PAGE)))
    inside = words.where(f"2 * x + w between 0 and {2 * PAGE} and 2 * y + h between 0 and {2 * PAGE}")
    area = inside.groupBy("doc_id", "page", (c("y", "h") * GRID + c("x", "w")).cast("int").alias("cell")).agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    pages = area.groupBy("doc_id", "page").agg(F.max("area").alias("most"), F.collect_list(F.struct("cell", "area")).alias("cells")).where("most > 0")
    return pages.select("doc_id", "page", F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), div_round(10_000 * c["area"], F.col("most")).alias("v"))).alias("cells"))


def density_cells(words: DataFrame) -> DataFrame:
    """doc_id, page, cell, v: the area of words by grid cell, as ten-thousandths of the fullest cell."""
    return _cells(words).select("doc_id", "page", F.inline("cells"))


def signatures(words: DataFrame) -> DataFrame:
    """doc_id, page, density: an array of CELLS ten-thousandths, row by row."""
    cells = _cells(words).select("doc_id", "page", F.map_from_entries("cells").alias("m"))
    return cells.select("doc_id", "page", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("density"))


def rotated(density: Column, quarter: int) -> Column:
    """The grid turned counter-clockwise by quarters of a turn."""
    k = quarter % 4
    at = lambda i: {0: i, 1: (i % GRID) * GRID + GRID - 1 - i // GRID, 2: CELLS - 1 - i, 3: (GRID - 1 - i % GRID) * GRID + i // GRID}[k]
    return F.transform(F.array(*[F.lit(at(i)) for i in range(CELLS)]), lambda j: density[j])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, v: s + v)


def cosine(a: Column, b: Column, norm: Column | None = None) -> Column:
    """The cosine of two integer arrays; 0 for arrays of different lengths and zero vectors.

    ``norm`` is the product of their squared lengths, where these are known already.
    """
    norm = dot(a, a) * dot(b, b) if norm is None else norm
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.sqrt(norm)).otherwise(0.0)


def aspect_score(a: Column, b: Column) -> Column:
    """The smaller over the larger ratio, 0 if either is missing or 0."""
    return F.when((a > 0) & (b > 0), F.least(a, b).cast("double") / F.greatest(a, b)).otherwise(0.0)


def colour_score(a: Column, b: Column) -> Column:
    """One less the distance of two colours (arrays of 0..255) over the greatest distance; 0 if either is empty."""
    far = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 1 - F.sqrt(far.cast("double")) / F.sqrt(F.lit(195_075.0))).otherwise(0.0)


def rounded(score: Column, digits: int = 4) -> Column:
    return F.floor(score * 10**digits + 0.5) / 10**digits


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Geometric similarity of two signatures, given as aspect, colour, density and, if known, the density's squared length as norm."""
    norm = a["norm"] * b["norm"] if "norm" in a and "norm" in b else None
    s = WEIGHTS[0] * aspect_score(a["aspect"], b["aspect"]) + WEIGHTS[1] * colour_score(a["colour"], b["colour"]) + WEIGHTS[2] * cosine(a["density"], b["density"], norm)
    return rounded(s)


def combined(geometric: Column, visual: Column, config: EngineConfig = EngineConfig()) -> Column:
    """With a visual score, its weighted mean with the geometric one."""
    return F.when(visual > 0, rounded((1 - config.visual_weight) * geometric + config.visual_weight * visual)).otherwise(geometric)


def score_pairs(pages: DataFrame, templates: DataFrame, angles: bool = False) -> DataFrame:
    """doc_id, page, template_id, variant, angle, score of every page with every template.

    Every pair is returned, so this is for few templates; :func:`best_of_templates` keeps the best only. With ``angles`` each is also
    turned by quarters, at 90 and 270 degrees once more with the inverse aspect. Templates go to the tasks, MOST_TEMPLATES at a time.
    """
    ship_package(pages.sparkSession)
    turns, out = TURNS if angles else TURNS[:1], None
    listed = templates.select("template_id", "aspect", "colour", "density").orderBy("template_id").toLocalIterator()
    while sides := [(r.template_id, r.aspect, list(r.colour or []), list(r.density or [])) for r in itertools.islice(listed, MOST_TEMPLATES)]:
        some = _scored(pages, Sides(sides, turns), len(sides))
        out = some if out is None else out.union(some)
    return out if out is not None else _scored(pages, Sides([], turns), 1)


PAIRS = "doc_id long, page long, template_id long, variant int, angle int, score double"


def _scored(pages: DataFrame, sides: Sides, each: int) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(sides)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value.ids)
        for batch in batches:
            for i in range(0, batch.num_rows if n else 0, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                score = shared.value.scores(*(some.column(k).to_pylist() for k in (2, 3, 4)))
                row = pa.array(np.repeat(np.arange(some.num_rows), n))
                tiled = lambda x, t: pa.array(np.tile(np.array(x), some.num_rows), t)
                yield pa.RecordBatch.from_arrays([some.column(0).take(row), some.column(1).take(row), tiled(shared.value.ids, pa.int64()), tiled(np.arange(n) // each, pa.int32()), tiled(shared.value.angles, pa.int32()), pa.array(score.ravel())], names=[c.split()[0] for c in PAIRS.split(", ")])

    return _page_rows(pages).mapInArrow(scores, PAIRS)


def _page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), F.col("aspect").cast("long"), F.col("colour").cast("array<long>"), F.col("density").cast("array<long>"))


def best_template(pairs: DataFrame) -> DataFrame:
    """The highest score above zero of each page; ties go to the first variant, then the smallest template."""
    best = F.max_by(F.struct("template_id", "angle", "score"), F.struct("score", -F.col("variant"), -F.col("template_id")))
    return pairs.where("score > 0").groupBy("doc_id", "page").agg(best.alias("b")).select("doc_id", "page", "b.*")


def best_of_templates(pages: DataFrame, templates: DataFrame, angles: bool = False) -> DataFrame:
    """:func:`best_template` of :func:`score_pairs`, without pairs.

    Up to MOST_TEMPLATES templates (600 bytes each) go to every task, which scores a batch of pages with all of them by
    products of matrices and passes on the best of each page; nothing is shuffled. More templates go through
    :func:`foliospark.operators.template_index.best_of_many_templates`, with the same winners.
    """
    if not small_enough(templates, MOST_TEMPLATES):
        from .template_index import best_of_many_templates

        return best_of_many_templates(pages, templates, angles)[0]
    ship_package(pages.sparkSession)
    sides = [(r.template_id, r.aspect, list(r.colour or []), list(r.density or [])) for r in templates.select("template_id", "aspect", "colour", "density").orderBy("template_id").collect()]
    shared = pages.sparkSession.sparkContext.broadcast(Sides(sides, TURNS if angles else TURNS[:1]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *shared.value.best(*(some.column(k).to_pylist() for k in (2, 3, 4)))], names=["doc_id", "page", "template_id", "angle", "score"])

    return _page_rows(pages).mapInArrow(best, "doc_id long, page long, template_id long, angle int, score double").where("template_id is not null")


class Sides:
    """Templates, turned in all ways that are tried, as matrices; ordered so that the first of equal scores counts."""

    def __init__(self, templates: list[tuple], turns: list[tuple[int, bool]]):
        rows = [(a, inverse, t) for a, inverse in turns for t in templates]
        self.ids, self.angles = [t[0] for *_, t in rows], [a for a, *_ in rows]
        places = [turned(a) for a, *_ in rows]
        self.aspect = np.array([(np.floor(1e8 / t[1] + 0.5) if inverse else t[1]) if t[1] and t[1] > 0 else 0 for _, inverse, t in rows], float)
        self.colour, self.has_colour = matrix([t[2] for *_, t in rows], 3)
        self.density, self.has_density = matrix([[t[3][k] for k in at] if len(t[3]) == CELLS else [] for at, (*_, t) in zip(places, rows)], CELLS)
        self.norm = (self.density**2).sum(1)

    def scores(self, aspects: list, colours: list, densities: list) -> np.ndarray:
        """A row a page, a column a side."""
        a = np.array([x or 0 for x in aspects], float)[:, None]
        colour, has_colour = matrix(colours, 3)
        density, has_density = matrix(densities, CELLS)
        with np.errstate(divide="ignore", invalid="ignore"):
            shape = np.where((a > 0) & (self.aspect > 0), np.minimum(a, self.aspect) / np.maximum(a, self.aspect), 0.0)
            far = ((colour[:, None, :] - self.colour[None]) ** 2).sum(2)
            tone = np.where(has_colour[:, None] & self.has_colour, 1 - np.sqrt(far) / np.sqrt(195_075.0), 0.0)
            norm = (density**2).sum(1)[:, None] * self.norm
            fill = np.where(has_density[:, None] & self.has_density & (norm > 0), density @ self.density.T / np.sqrt(norm), 0.0)
        return np.floor((WEIGHTS[0] * shape + WEIGHTS[1] * tone + WEIGHTS[2] * fill) * 10_000 + 0.5) / 10_000

    def winners(self, aspects: list, colours: list, densities: list) -> tuple[np.ndarray, np.ndarray]:
        """The first side with the highest score of each page, and that score."""
        score = self.scores(aspects, colours, densities)
        k = score.argmax(1)
        return k, score[np.arange(len(k)), k]

    def best(self, aspects: list, colours: list, densities: list) -> list[pa.Array]:
        if not self.ids or not aspects:
            return [pa.nulls(len(aspects), pa.int64()), pa.nulls(len(aspects), pa.int32()), pa.nulls(len(aspects), pa.float64())]
        k, top = self.winners(aspects, colours, densities)
        none = top <= 0
        return [pa.array([self.ids[i] for i in k], pa.int64(), mask=none), pa.array([self.angles[i] for i in k], pa.int32(), mask=none), pa.array(top, pa.float64(), mask=none)]


def turned(angle: int) -> np.ndarray:
    """Which cell of a grid stands at each place once it is turned counter-clockwise."""
    return np.rot90(np.arange(CELLS).reshape(GRID, GRID), angle // 90).ravel()


def matrix(lists: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` numbers, zeros for lists that are null or of another length, and which are not."""
    good = np.array([x is not None and len(x) == width for x in lists], bool)
    return np.array([x if g else [0] * width for x, g in zip(lists, good)], float).reshape(len(lists), width), good


def accepted(score: Column, visual: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Whether a match counts: without a visual score it must be nearly perfect."""
    return ~(((visual <= config.visual_floor) & (score < config.blind_threshold)) | ((visual > config.visual_floor) & (score < config.match_threshold)))


def anchor_corrected(base: Column, anchor: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The score of a template with anchors."""
    return rounded((1 - config.anchor_weight) * base + config.anchor_weight * anchor)


def anchor_selection(chosen: DataFrame, tried: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, page, template_id, score: templates with anchors may replace the chosen one.

    chosen: doc_id, page, template_id, score (null and 0 if none); tried: doc_id, page, template_id, base (geometric
    similarity), anchor (anchor score). A template's score is the weighted mean of its base, for the chosen one its score,
    and its anchors; the highest counts if it is above the chosen score, the smaller template of equals.
    """
    c = chosen.select("doc_id", "page", F.col("template_id").alias("c_id"), F.coalesce("score", F.lit(0.0)).alias("c_score"))
    both = tried.join(c, ["doc_id", "page"]).withColumn("all", anchor_corrected(F.when(F.col("template_id") == F.col("c_id"), F.col("c_score")).otherwise(F.col("base")), F.col("anchor"), config))
    best = both.where("all > c_score").groupBy("doc_id", "page").agg(F.max_by(F.struct("template_id", "all"), F.struct("all", -F.col("template_id"))).alias("b"))
    return c.join(best, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("b.template_id", "c_id").alias("template_id"), F.coalesce("b.all", "c_score").alias("score"))
