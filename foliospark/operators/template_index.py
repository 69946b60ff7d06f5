"""The best template of each page where there are more templates than fit a task: blocks of templates, read by falling bound."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship_package
from ..storage import materialize
from .matching import AT_ONCE, CELLS, TURNS, WEIGHTS, Sides, matrix, turned

#: Templates that centroids are fitted on (at most 10 MB), the first by a hash of their identifier; all templates are indexed.
SAMPLE, ROUNDS, SEED = 20_000, 8, 5
#: Most groups, and templates of a group or pages for it that are compared at a time.
MOST_GROUPS, BLOCK = 1024, 2048
#: Scores are rounded to four digits; bounds of doubles get this much on top.
SLACK = 1e-9


def _rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("aspect").cast("long"), F.col("colour").cast("array<long>"), F.col("density").cast("array<long>"))


def _directions(densities: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of densities, and which have a direction."""
    x, good = matrix(densities, CELLS)
    norm = np.linalg.norm(x, axis=1)
    return x / np.maximum(norm, 1e-300)[:, None], good & (norm > 0)


def _fit(densities: list, groups: int) -> np.ndarray:
    x, good = _directions(densities)
    x, rng = x[good], np.random.default_rng(SEED)
    if not len(x):
        return np.zeros((0, CELLS))
    c = x[rng.choice(len(x), min(groups, len(x)), replace=False)]
    for _ in range(ROUNDS):
        total = np.zeros_like(c)
        np.add.at(total, (x @ c.T).argmax(1), x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], c)
    return c


class Bounds:
    """What is known of each group of templates: how far their densities are from its centroid, and the ranges of their aspects and colours."""

    def __init__(self, centroids: np.ndarray, known: dict[int, dict], turns: list[tuple[int, bool]]):
        self.groups = sorted(known)
        at = [known[g] for g in self.groups]
        self.centroids = np.array([centroids[g] if g >= 0 else np.zeros(CELLS) for g in self.groups]).reshape(len(at), CELLS)
        self.radius = np.array([k["radius"] or 0.0 for k in at]) + 1e-7
        self.flat = np.array([g < 0 for g in self.groups], bool)
        self.low, self.high = (np.array([k[n] or 0 for k in at], float) for n in ("low", "high"))
        self.colour_low, self.colour_high = (np.array([[v if v is not None else 0 for v in k[n]] for k in at], float).reshape(len(at), 3) for n in ("c_low", "c_high"))
        self.coloured = np.array([k["c_low"][0] is not None for k in at], bool)
        self.turns = turns

    def of(self, aspects: list, colours: list, densities: list) -> np.ndarray:
        """No template of a group (column) scores higher with a page (row)."""
        a = np.array([x or 0 for x in aspects], float)[:, None]
        colour, has_colour = matrix(colours, 3)
        off = np.maximum(0, np.maximum(self.colour_low[None] - colour[:, None], colour[:, None] - self.colour_high[None]))
        tone = np.where(has_colour[:, None] & self.coloured, 1 - np.sqrt((off**2).sum(2)) / np.sqrt(195_075.0), 0.0)
        x, good = _directions(densities)
        best = np.zeros((len(a), len(self.groups)))
        for angle, inverse in self.turns:
            back = x[:, np.argsort(turned(angle))]  # the page turned back, against templates as they are
            far = np.arccos(np.clip(back @ self.centroids.T, -1, 1))
            fill = np.where(good[:, None] & ~self.flat, np.cos(np.maximum(0, far - self.radius)), 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                low, high = ((np.floor(1e8 / self.high), np.floor(1e8 / self.low + 1)) if inverse else (self.low, self.high))
                shape = np.where((a > 0) & (self.high > 0), np.where(a < low, a / low, np.where(a > high, high / a, 1.0)), 0.0)
            best = np.maximum(best, WEIGHTS[0] * shape + WEIGHTS[1] * tone + WEIGHTS[2] * fill)
        return np.floor((best + SLACK) * 10_000 + 0.5) / 10_000


def _grouped(templates: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Templates with their group (-1 for those without density) and the angle to its centroid."""
    shared = templates.sparkSession.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _directions(batch.column(3).to_pylist())
            far = np.arccos(np.clip(x @ shared.value.T, -1, 1)) if len(shared.value) else np.zeros((len(x), 1))
            group = np.where(good & (len(shared.value) > 0), far.argmin(1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int32()), pa.array(np.where(group >= 0, far.min(1), 0.0))], names=["template_id", "aspect", "colour", "density", "grp", "angle"])

    return templates.mapInArrow(place, "template_id long, aspect long, colour array<long>, density array<long>, grp int, angle double")


def _visits(pages: DataFrame, bounds: Bounds, found: bool) -> DataFrame:
    """doc_id, page, grp: the group with the highest bound of each page; or, once its best score is known, all others whose bound reaches that."""
    shared = pages.sparkSession.sparkContext.broadcast(bounds)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows if b.groups else 0, AT_ONCE * 16):
                some = batch.slice(i, AT_ONCE * 16)
                bound = b.of(*(some.column(k).to_pylist() for k in ("aspect", "colour", "density")))
                first = np.zeros(bound.shape, bool)
                first[np.arange(len(bound)), bound.argmax(1)] = True
                chosen = first & (bound > 0)
                if found:
                    chosen = ~first & (bound > 0) & (bound >= some.column("score").to_numpy()[:, None])
                r, g = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(r)), some.column("page").take(pa.array(r)), pa.array(np.array(b.groups)[g], pa.int32())], names=["doc_id", "page", "grp"])

    return pages.mapInArrow(choose, "doc_id long, page long, grp int")


def _compared(pages: DataFrame, templates: DataFrame, visits: DataFrame, sizes: DataFrame, turns: list[tuple[int, bool]]) -> DataFrame:
    """doc_id, page, template_id, variant, angle, score: the best template of each page in each block of the groups that it visits."""
    cut = visits.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("p_blocks")).join(sizes, "grp")
    cut = materialize(cut.select("grp", "p_blocks", F.ceil(F.col("n") / BLOCK).cast("int").alias("t_blocks")), "blocks")  # a row a group
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = visits.join(F.broadcast(cut), "grp").join(pages.select("doc_id", "page", "aspect", "colour", "density"), ["doc_id", "page"])
    p = p.withColumn("p_part", F.pmod(F.xxhash64("doc_id", "page"), "p_blocks").cast("int")).withColumn("t_part", all_of("t_blocks")).drop("p_blocks", "t_blocks")
    t = templates.join(F.broadcast(cut), "grp").withColumn("t_part", F.pmod(F.xxhash64("template_id"), "t_blocks").cast("int")).withColumn("p_part", all_of("p_blocks")).drop("p_blocks", "t_blocks")
    key = ["grp", "p_part", "t_part"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "page", "template_id", "variant", "angle", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))})
        listed = sorted(((r["template_id"], r["aspect"], r["colour"] or [], r["density"] or []) for r in right.to_pylist()), key=lambda r: r[0])
        sides = Sides(listed, turns)
        out = []
        for i in range(0, left.num_rows, AT_ONCE):
            some = left.slice(i, AT_ONCE)
            k, top = sides.winners(*(some.column(n).to_pylist() for n in ("aspect", "colour", "density")))
            out.append(pa.table([some.column("doc_id"), some.column("page"), pa.array([sides.ids[j] for j in k], pa.int64()), pa.array(k // (len(sides.ids) // len(turns)), pa.int32()), pa.array([sides.angles[j] for j in k], pa.int32()), pa.array(top)], names=names))
        return pa.concat_tables(out)

    return p.groupBy(*key).cogroup(t.groupBy(*key)).applyInArrow(best, "doc_id long, page long, template_id long, variant int, angle int, score double")


def _best(scored: DataFrame) -> DataFrame:
    order = F.struct("score", -F.col("variant"), -F.col("template_id"))
    return scored.where("score > 0").groupBy("doc_id", "page").agg(F.max_by(F.struct("template_id", "variant", "angle", "score"), order).alias("b")).select("doc_id", "page", "b.*")


def best_of_many_templates(pages: DataFrame, templates: DataFrame, angles: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, page, template_id, angle, score of the best template of each page, as :func:`foliospark.operators.matching.best_of_templates`, and the groups read (doc_id, page, grp).

    Templates are grouped by the direction of their densities (about the square root of their number of groups, MOST_GROUPS at most). A
    group's bound for a page follows from its centroid, by the triangle inequality, and from the ranges of its aspects and colours. Each page is
    compared with the group of the highest bound; its score then rules groups out, and it is compared with the others, equal bounds included, so
    that ties end alike. Groups are compared block by block, however large they are. Pages are told apart by doc_id and page.
    """
    ship_package(pages.sparkSession)
    turns = TURNS if angles else TURNS[:1]
    named = _rows(templates.where("template_id is not null"), "template_id")
    n = named.count()
    some = named.orderBy(F.xxhash64("template_id"), "template_id").limit(SAMPLE).select("density").collect()
    centroids = _fit([r.density for r in some], max(1, min(MOST_GROUPS, math.isqrt(n))))
    grouped = materialize(_grouped(named, centroids), "templates")
    whole = F.when(F.size("colour") == 3, F.col("colour"))
    ranges = [f(F.when(F.col("aspect") > 0, F.col("aspect"))).alias(k) for f, k in ((F.min, "low"), (F.max, "high"))] + [F.array(*[f(F.get(whole, k)) for k in range(3)]).alias(name) for f, name in ((F.min, "c_low"), (F.max, "c_high"))]
    sizes = materialize(grouped.groupBy("grp").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), *ranges), "groups")
    bounds = Bounds(centroids, {r.grp: r.asDict() for r in sizes.collect()}, turns)
    p = materialize(_rows(pages, "doc_id", "page"), "pages")
    first = materialize(_visits(p, bounds, False), "visits")
    near = materialize(_best(_compared(p, grouped, first, sizes.select("grp", "n"), turns)), "near")
    known = p.join(near.select("doc_id", "page", "score"), ["doc_id", "page"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    then = materialize(_visits(known, bounds, True), "visits")
    found = _best(near.unionByName(_compared(p, grouped, then, sizes.select("grp", "n"), turns)))
    return found.select("doc_id", "page", "template_id", "angle", "score"), first.union(then)
