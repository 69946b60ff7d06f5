"""The transform that carries located anchors onto a template, fitted per page from sums that Spark computes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..cluster import ship_package
from ..config import EngineConfig


def fit_similarity(pairs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, page, n, kind, scale, angle, dx, dy, residual from pairs of points (src_x, src_y, dst_x, dst_y).

    One pair gives a translation, more the least-squares similarity. A scale outside 0.25 to 4, or with three
    pairs or more a residual above the limit (root mean square over the extent of the targets), gives kind ``none``.
    All is made of sums, so any number of pairs is a plain aggregate.
    """
    sums = pairs.groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("src_x", "src_y", "dst_x", "dst_y")],
        F.sum(F.col("src_x") * F.col("src_x") + F.col("src_y") * F.col("src_y")).alias("ss"), F.sum(F.col("dst_x") * F.col("dst_x") + F.col("dst_y") * F.col("dst_y")).alias("tt"),
        F.sum(F.col("src_x") * F.col("dst_x") + F.col("src_y") * F.col("dst_y")).alias("dot"), F.sum(F.col("src_x") * F.col("dst_y") - F.col("src_y") * F.col("dst_x")).alias("cross"),
        F.greatest(F.max("dst_x") - F.min("dst_x"), F.max("dst_y") - F.min("dst_y")).alias("extent"),
    )
    c = F.col
    vs = c("ss") - c("n") * (c("m_src_x") * c("m_src_x") + c("m_src_y") * c("m_src_y"))
    vt = c("tt") - c("n") * (c("m_dst_x") * c("m_dst_x") + c("m_dst_y") * c("m_dst_y"))
    a0 = c("dot") - c("n") * (c("m_src_x") * c("m_dst_x") + c("m_src_y") * c("m_dst_y"))
    b0 = c("cross") - c("n") * (c("m_src_x") * c("m_dst_y") - c("m_src_y") * c("m_dst_x"))
    fit = sums.withColumn("a", F.when((c("n") > 1) & (vs > 0), a0 / vs).otherwise(1.0)).withColumn("b", F.when((c("n") > 1) & (vs > 0), b0 / vs).otherwise(0.0))
    fit = fit.withColumn("scale", F.hypot("a", "b")).withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), vt - (c("a") * c("a") + c("b") * c("b")) * vs) / c("n")) / F.greatest(c("extent"), F.lit(1e-9)))
    sane = c("scale").between(0.25, 4.0) & ((c("n") < 3) | (c("residual") <= config.anchor_fit_max_error))
    return fit.select(
        "doc_id", "page", "n", F.when(~sane, "none").when(c("n") == 1, "translation").otherwise("similarity").alias("kind"), "scale", F.degrees(F.atan2("b", "a")).alias("angle"),
        (c("m_dst_x") - c("a") * c("m_src_x") + c("b") * c("m_src_y")).alias("dx"), (c("m_dst_y") - c("b") * c("m_src_x") - c("a") * c("m_src_y")).alias("dy"), F.when(c("n") > 1, c("residual")).otherwise(0.0).alias("residual"),
    )


#: A pair is left out whose residual under the first fit is above this many pixels and this many times the (upper) median.
OFF, OFF_TIMES = 3.0, 2.0
_SUMS = {"sx": "p.src_x", "sy": "p.src_y", "sxx": "p.src_x * p.src_x", "sxy": "p.src_x * p.src_y", "syy": "p.src_y * p.src_y", "su": "p.dst_x", "sv": "p.dst_y", "sxu": "p.src_x * p.dst_x", "syu": "p.src_y * p.dst_x", "sxv": "p.src_x * p.dst_y", "syv": "p.src_y * p.dst_y"}
_MINORS = {"m11": "syy * m - sy * sy", "m12": "sx * sy - sxy * m", "m13": "sxy * sy - syy * sx", "m22": "sxx * m - sx * sx", "m23": "sxy * sx - sxx * sy", "m33": "sxx * syy - sxy * sxy"}
_AFFINE = {
    "a": "(m11 * sxu + m12 * syu + m13 * su) / det", "b": "(m12 * sxu + m22 * syu + m23 * su) / det", "tx": "(m13 * sxu + m23 * syu + m33 * su) / det",
    "c": "(m11 * sxv + m12 * syv + m13 * sv) / det", "d": "(m12 * sxv + m22 * syv + m23 * sv) / det", "ty": "(m13 * sxv + m23 * syv + m33 * sv) / det",
}
_SIMILAR = {"ra": "(m * (sxu + syv) - (sx * su + sy * sv)) / spread", "rb": "(m * (sxv - syu) - (sx * sv - sy * su)) / spread"}
#: Squares of a pair's residuals under the affine transform, and under the similarity.
_OFF_AFFINE = "(a * p.src_x + b * p.src_y + tx - p.dst_x) * (a * p.src_x + b * p.src_y + tx - p.dst_x) + (c * p.src_x + d * p.src_y + ty - p.dst_y) * (c * p.src_x + d * p.src_y + ty - p.dst_y)"
_OFF_SIMILAR = "(ra * p.src_x - rb * p.src_y + rx - p.dst_x) * (ra * p.src_x - rb * p.src_y + rx - p.dst_x) + (rb * p.src_x + ra * p.src_y + ry - p.dst_y) * (rb * p.src_x + ra * p.src_y + ry - p.dst_y)"


def _sane(config: EngineConfig) -> str:
    """Whether an affine transform can be that of the same form: no mirror image, scales of 0.1 to 6, bounded anisotropy, shear and, from four pairs on, residual."""
    return f"""coalesce(sy_ > 0 and sx_ between 0.1 and 6.0 and sy_ between 0.1 and 6.0 and greatest(sx_, sy_) <= {config.anchor_max_anisotropy} * least(sx_, sy_)
        and abs(a * b + c * d) <= {config.anchor_max_shear} * sx_ * sx_ and (m < 4 or off_a <= {config.anchor_fit_max_error}), false)"""


def _kind(config: EngineConfig) -> str:
    return f"case when m = 1 then 'translation' when {_sane(config)} then 'affine' when sqrt(ra * ra + rb * rb) between 0.25 and 4.0 and (m < 3 or off_r <= {config.anchor_fit_max_error}) then 'similarity' else 'none' end"


_PARTS = {"sx_": "sqrt(a * a + c * c)", "sy_": "(a * d - b * c) / nullif(sqrt(a * a + c * c), 0)"}
_RESULT = {
    "scale": "case kind when 'affine' then (sx_ + sy_) / 2 when 'similarity' then sqrt(ra * ra + rb * rb) when 'translation' then 1 end", "angle": "case kind when 'affine' then degrees(atan2(c, a)) when 'similarity' then degrees(atan2(rb, ra)) when 'translation' then 0 end",
    "residual": "case kind when 'affine' then off_a when 'similarity' then off_r when 'translation' then 0 end",
}


def fit_anchors(pairs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id, page, n, n_used, kind, scale, angle, residual and matrix of the transform that carries pairs of points (src_x, src_y to dst_x, dst_y).

    Three pairs or more: the least-squares affine transform; pairs far off it (see OFF) are left out once and it is fitted
    again. If it isn't sane, and for two pairs, the least-squares similarity, unless its scale or residual is out of bounds: then
    kind is ``none``. One pair gives a translation. A page's anchors are few; they are gathered and fitted by sums over them.
    """
    point = F.struct(*[F.col(c).cast("double").alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")])
    pages = pairs.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(point)).alias("ps"), F.count("*").alias("n"))
    first = _fitted(pages)
    off = "transform(ps, p -> sqrt(" + _OFF_AFFINE + "))"
    first = first.withColumn("off", F.expr(f"if(a is null, null, {off})")).withColumn("most", F.expr(f"greatest({OFF}D, {OFF_TIMES}D * get(array_sort(off), cast(floor(size(off) / 2) as int)))"))
    used = first.select("doc_id", "page", "n", F.expr("if(off is null, ps, filter(ps, (p, i) -> off[i] <= most))").alias("ps"))
    fit = _fitted(used)
    mean = lambda e: f"sqrt(aggregate(ps, 0D, (s, p) -> s + {e}) / m) / nullif(extent, 0)"
    side = lambda c: f"(array_max(transform(ps, p -> p.{c})) - array_min(transform(ps, p -> p.{c})))"
    fit = fit.withColumn("extent", F.expr(f"sqrt({side('dst_x')} * {side('dst_x')} + {side('dst_y')} * {side('dst_y')})"))
    fit = fit.withColumn("off_a", F.expr(mean(_OFF_AFFINE))).withColumn("off_r", F.expr(mean(_OFF_SIMILAR)))
    fit = fit.withColumns({k: F.expr(v) for k, v in _PARTS.items()}).withColumn("kind", F.expr(_kind(config)))
    fit = fit.withColumns({k: F.expr(v).cast("double") for k, v in _RESULT.items()})
    matrix = F.expr("case kind when 'affine' then array(array(a, b, tx), array(c, d, ty)) when 'similarity' then array(array(ra, -rb, rx), array(rb, ra, ry)) when 'translation' then array(array(1D, 0D, su - sx), array(0D, 1D, sv - sy)) end")
    return fit.select("doc_id", "page", "n", F.col("m").cast("long").alias("n_used"), "kind", "scale", "angle", "residual", matrix.alias("matrix"))


def _fitted(pages: DataFrame) -> DataFrame:
    """With both transforms of the points ps: null where they say nothing."""
    out = pages.withColumns({k: F.expr(f"aggregate(ps, 0D, (s, p) -> s + {e})") for k, e in _SUMS.items()}).withColumn("m", F.size("ps").cast("double"))
    out = out.withColumns({k: F.expr(e) for k, e in _MINORS.items()})
    out = out.withColumn("det", F.expr("if(m >= 3, nullif(sxx * m11 + sxy * m12 + sx * m13, 0), null)")).withColumn("spread", F.expr("nullif(m * (sxx + syy) - sx * sx - sy * sy, 0)"))
    out = out.withColumns({k: F.expr(e) for k, e in (_AFFINE | _SIMILAR).items()})
    return out.withColumn("rx", F.expr("(su - ra * sx + rb * sy) / m")).withColumn("ry", F.expr("(sv - rb * sx - ra * sy) / m"))


#: Squared distances from a page's pairs that are computed at a time.
AT_ONCE = 1 << 20
_STEPS = {"x2": "q.src_x - p.src_x", "y2": "q.src_y - p.src_y", "u2": "q.dst_x - p.dst_x", "v2": "q.dst_y - p.dst_y", "x3": "r.src_x - p.src_x", "y3": "r.src_y - p.src_y", "u3": "r.dst_x - p.dst_x", "v3": "r.dst_y - p.dst_y"}
_THROUGH = [  # the affine transform through three pairs p, q, r, and the similarity through p and q
    {"area": "nullif(x2 * y3 - x3 * y2, 0)", "long": "nullif(x2 * x2 + y2 * y2, 0)"},
    {"a": "(u2 * y3 - u3 * y2) / area", "b": "(x2 * u3 - x3 * u2) / area", "c": "(v2 * y3 - v3 * y2) / area", "d": "(x2 * v3 - x3 * v2) / area", "ra": "(x2 * u2 + y2 * v2) / long", "rb": "(x2 * v2 - y2 * u2) / long"},
    {"tx": "p.dst_x - a * p.src_x - b * p.src_y", "ty": "p.dst_y - c * p.src_x - d * p.src_y", "rx": "p.dst_x - ra * p.src_x + rb * p.src_y", "ry": "p.dst_y - rb * p.src_x - ra * p.src_y"},
]


#: How far an affine transform is from a similarity.
_BENT = "round(coalesce(abs(a - d) + abs(b + c), 0), 3)"


def _samples(n: int, most: int) -> Iterator[np.ndarray]:
    """Triples of places i < j < k among n pairs in their order, up to about ``most`` at a time."""
    some, size = [], 0
    for i in range(n - 2):
        for j in range(i + 1, n - 1):
            k = np.arange(j + 1, n)
            some.append(np.stack([np.full_like(k, i), np.full_like(k, j), k]))
            size += len(k)
            if size >= most:
                yield np.concatenate(some, 1)
                some, size = [], 0
    if some:
        yield np.concatenate(some, 1)


@lru_cache(maxsize=32)
def _all_samples(n: int) -> list[np.ndarray]:
    return list(_samples(n, AT_ONCE))


class _Best:
    """The sample with most votes of each page, of as many the least bent one, then the first; and which pairs agree with it."""

    def __init__(self, pages: int, n: int):
        self.votes, self.bent, self.agree = np.full(pages, -1), np.full(pages, np.inf), np.zeros((pages, n), bool)

    def add(self, rows: slice, known: np.ndarray, bent: np.ndarray, near: np.ndarray) -> None:
        votes = np.where(known, near.sum(2), -1)
        top = votes.max(1)
        least = np.where(votes == top[:, None], np.where(np.isfinite(bent), bent, np.finfo(float).max), np.inf)
        at, one = least.argmin(1), np.arange(len(top))
        better = (top > self.votes[rows]) | ((top == self.votes[rows]) & (top >= 0) & (least[one, at] < self.bent[rows]))
        self.votes[rows] = np.where(better, top, self.votes[rows])
        self.bent[rows] = np.where(better, least[one, at], self.bent[rows])
        self.agree[rows] = np.where(better[:, None], near[one, at], self.agree[rows])


def _near(m: tuple, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of pages (rows) and transforms (columns) which pairs are within OFF."""
    a, b, tx, c, d, ty = (e[..., None] for e in m)
    off_x, off_y = a * x[:, None] + b * y[:, None] + tx - u[:, None], c * x[:, None] + d * y[:, None] + ty - v[:, None]
    return off_x * off_x + off_y * off_y <= OFF * OFF


def _bent(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """_BENT: in thousandths, halves up."""
    thousandths = (np.abs(a - d) + np.abs(b + c)) * 1000
    whole = np.floor(thousandths)
    return (whole + (thousandths - whole >= 0.5)) / 1000


def _winners(points: np.ndarray) -> tuple[_Best, _Best]:
    """Of pages (rows) of as many pairs (columns) the best affine transform through three pairs, and the best similarity through the first two of any three, or through two."""
    pages, n, _ = points.shape
    affine, similar = _Best(pages, n), _Best(pages, n)
    samples = [np.array([[0], [1], [-1]])] if n == 2 else _all_samples(n) if n <= 40 else _samples(n, max(1, AT_ONCE // n))
    for i, j, k in samples if n > 1 else []:
        pair = np.flatnonzero((k == j + 1) | (k < 0))  # one sample of each i and j
        step = max(1, AT_ONCE // (len(i) * n))
        for lo in range(0, pages, step):
            rows = slice(lo, lo + step)
            x, y, u, v = np.moveaxis(points[rows], 2, 0)
            with np.errstate(all="ignore"):
                if n > 2:
                    (px, x2, x3), (py, y2, y3), (pu, u2, u3), (pv, v2, v3) = ((c[:, i], c[:, j] - c[:, i], c[:, k] - c[:, i]) for c in (x, y, u, v))
                    area = x2 * y3 - x3 * y2
                    a, b, c, d = (u2 * y3 - u3 * y2) / area, (x2 * u3 - x3 * u2) / area, (v2 * y3 - v3 * y2) / area, (x2 * v3 - x3 * v2) / area
                    near = _near((a, b, pu - a * px - b * py, c, d, pv - c * px - d * py), x, y, u, v)
                    affine.add(rows, (area != 0) & ~np.isnan(a + b + c + d), _bent(a, b, c, d), near)
                if len(pair):
                    (px, x2), (py, y2), (pu, u2), (pv, v2) = ((c[:, i[pair]], c[:, j[pair]] - c[:, i[pair]]) for c in (x, y, u, v))
                    long = x2 * x2 + y2 * y2
                    a, b = (x2 * u2 + y2 * v2) / long, (x2 * v2 - y2 * u2) / long
                    near = _near((a, -b, pu - a * px + b * py, b, a, pv - b * px - a * py), x, y, u, v)
                    similar.add(rows, (long != 0) & ~np.isnan(a + b), np.zeros(a.shape), near)
    return affine, similar


def _agreeing(pages: DataFrame) -> DataFrame:
    """With agree_a and agree_r: the pairs of each page (ps) that agree with its best affine transform and with its best similarity; null where no sample says anything."""
    ship_package(pages.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ps"))
            sizes = lists.value_lengths().to_numpy()
            points = np.stack([c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()], 1)
            start, agree = np.cumsum(sizes) - sizes, [[None] * len(sizes), [None] * len(sizes)]
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                for out, best in zip(agree, _winners(points[start[at][:, None] + np.arange(n)])):
                    for row, votes, near in zip(at, best.votes, best.agree):
                        out[row] = np.flatnonzero(near) if votes >= 0 else None
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(a, pa.list_(pa.int32())) for a in agree)], names=[*batch.schema.names, "agree_a", "agree_r"])

    some = ArrayType(IntegerType())
    found = pages.mapInArrow(vote, StructType([*pages.schema.fields, StructField("agree_a", some), StructField("agree_r", some)]))
    return found.withColumns({c: F.transform(c, lambda i: F.get("ps", i)) for c in ("agree_a", "agree_r")})


def consensus_fit(pairs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """What :func:`fit_anchors` returns, by consensus: right with up to two fifths of the pairs off, wherever these lie.

    Minimal samples, all of them however many a page has, are the affine transform through three pairs and the
    similarity through the first two of them. Each counts the page's pairs within OFF of it; of both kinds the one with most votes wins, of affine ones with as many the one
    nearest to a similarity (any three pairs agree, so with few pairs votes alone say little), then the first, and the least-squares fit of its pairs is the result: the affine transform if it is sane, else the similarity if that is, else ``none``. n_used is how
    many pairs agree. A page is gathered once, and its samples are never rows; n pairs have about n^3 / 6 of them. One pair gives a translation; samples in a line say nothing.
    """
    point = F.struct(*[F.col(c).cast("double").alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")])
    pages = pairs.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(point)).alias("ps"), F.count("*").cast("int").alias("n"))
    won = _agreeing(pages).withColumnRenamed("ps", "all")
    mean = lambda e: f"sqrt(aggregate(ps, 0D, (s, p) -> s + {e}) / m) / nullif(extent, 0)"
    side = lambda c: f"(array_max(transform(ps, p -> p.{c})) - array_min(transform(ps, p -> p.{c})))"

    def refined(df: DataFrame, points: str) -> DataFrame:
        fit = _fitted(df.withColumn("ps", F.expr(points)))
        fit = fit.withColumn("extent", F.expr(f"sqrt({side('dst_x')} * {side('dst_x')} + {side('dst_y')} * {side('dst_y')})"))
        return fit.withColumn("off_a", F.expr(mean(_OFF_AFFINE))).withColumn("off_r", F.expr(mean(_OFF_SIMILAR))).withColumns({k: F.expr(v) for k, v in _PARTS.items()})

    affine = refined(won, "coalesce(agree_a, all)").withColumn("sane", F.expr(f"m >= 3 and {_sane(config)}"))
    kept = F.when(F.col("sane"), F.struct(F.lit("affine").alias("kind"), F.expr(_RESULT["scale"].replace("case kind", "case 'affine'")).cast("double").alias("scale"), F.expr("degrees(atan2(c, a))").alias("angle"), F.col("off_a").alias("residual"), F.col("m").cast("long").alias("n_used"), F.expr("array(array(a, b, tx), array(c, d, ty))").alias("matrix")))
    similar = refined(affine.select("doc_id", "page", "n", "all", "agree_r", kept.alias("kept")), "coalesce(agree_r, all)")
    # with the affine transform out of the way what is left is a similarity, a translation or nothing
    similar = similar.withColumns({"sx_": F.lit(None).cast("double"), "sy_": F.lit(None).cast("double")}).withColumn("kind", F.expr(_kind(config))).withColumns({k: F.expr(v).cast("double") for k, v in _RESULT.items()})
    matrix = F.expr("case kind when 'similarity' then array(array(ra, -rb, rx), array(rb, ra, ry)) when 'translation' then array(array(1D, 0D, su - sx), array(0D, 1D, sv - sy)) end")
    other = F.struct("kind", "scale", "angle", "residual", F.col("m").cast("long").alias("n_used"), matrix.alias("matrix"))
    return similar.withColumn("best", F.coalesce("kept", other)).select("doc_id", "page", F.col("n").cast("long").alias("n"), "best.n_used", "best.kind", "best.scale", "best.angle", "best.residual", "best.matrix")


def _alias(d: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {k}" for k, e in d.items())


def _fitted_sql(name: str, source: str) -> str:
    sums = ", ".join(f"sum({e}) AS {k}" for k, e in _SUMS.items())
    return f"""{name}0 AS (SELECT doc_id, page, CAST(count(*) AS DOUBLE) AS m, {sums}, sqrt(pow(max(p.dst_x) - min(p.dst_x), 2) + pow(max(p.dst_y) - min(p.dst_y), 2)) AS extent FROM {source} p GROUP BY doc_id, page),
        {name}1 AS (SELECT *, {_alias(_MINORS)} FROM {name}0), {name}2 AS (SELECT *, CASE WHEN m >= 3 THEN nullif(sxx * m11 + sxy * m12 + sx * m13, 0) END AS det, nullif(m * (sxx + syy) - sx * sx - sy * sy, 0) AS spread FROM {name}1),
        {name}3 AS (SELECT *, {_alias(_AFFINE)}, {_alias(_SIMILAR)} FROM {name}2), {name} AS (SELECT *, (su - ra * sx + rb * sy) / m AS rx, (sv - rb * sx - ra * sy) / m AS ry FROM {name}3)"""


def fit_sql(points: str, config: EngineConfig = EngineConfig()) -> str:
    """The same in SQL over points with a number i, as table expressions that end in ``fitted``."""
    fitted, alias = _fitted_sql, _alias
    return f"""WITH pts AS ({points}), {fitted('f', 'pts')}, o AS (SELECT p.*, a IS NULL AS plain, sqrt({_OFF_AFFINE}) AS off FROM pts p JOIN f USING (doc_id, page)),
        med AS (SELECT doc_id, page, count(*) AS n, list_sort(list(off))[len(list(off)) // 2 + 1] AS mid FROM o GROUP BY ALL),
        used AS (SELECT o.*, n FROM o JOIN med USING (doc_id, page) WHERE plain OR off <= greatest({OFF}, {OFF_TIMES} * mid)), {fitted('g', 'used')},
        e AS (SELECT doc_id, page, any_value(n) AS n, sqrt(sum({_OFF_AFFINE}) / any_value(m)) / nullif(any_value(extent), 0) AS off_a, sqrt(sum({_OFF_SIMILAR}) / any_value(m)) / nullif(any_value(extent), 0) AS off_r FROM used p JOIN g USING (doc_id, page) GROUP BY ALL),
        h AS (SELECT *, {alias(_PARTS)} FROM g JOIN e USING (doc_id, page)), k AS (SELECT *, {_kind(config)} AS kind FROM h),
        fitted AS (SELECT doc_id, page, n, CAST(m AS BIGINT) AS n_used, kind, {alias(_RESULT)} FROM k)"""


def consensus_sql(points: str, config: EngineConfig = EngineConfig()) -> str:
    """:func:`consensus_fit` in SQL, as table expressions that end in ``fitted``."""
    through = "".join(f", s{n + 1} AS (SELECT *, {_alias(step)} FROM s{n})" for n, step in enumerate((_STEPS, *_THROUGH)))

    def won(name: str, off: str, known: str, bent: str) -> str:
        return f"""{name}v AS (SELECT s.doc_id, s.page, s.i, s.j, s.k, any_value(s.{known}) IS NOT NULL AS known, any_value({bent}) AS bent, count(*) FILTER ({off} <= {OFF * OFF}) AS votes FROM (SELECT * EXCLUDE (p, q, r) FROM s4) s JOIN pts p USING (doc_id, page) GROUP BY ALL),
        {name}w AS (SELECT * FROM {name}v WHERE known QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY votes DESC, bent, i, j, k) = 1),
        {name}u AS (SELECT p.* FROM {name}w w JOIN (SELECT * EXCLUDE (p, q, r) FROM s4) s ON (s.doc_id, s.page, s.i, s.j) = (w.doc_id, w.page, w.i, w.j) AND s.k IS NOT DISTINCT FROM w.k JOIN pts p ON p.doc_id = w.doc_id AND p.page = w.page WHERE {off} <= {OFF * OFF} UNION ALL SELECT p.* FROM pts p ANTI JOIN {name}w w USING (doc_id, page)),
        {_fitted_sql(name, name + 'u')}, {name}e AS (SELECT doc_id, page, sqrt(sum({_OFF_AFFINE}) / any_value(m)) / nullif(any_value(extent), 0) AS off_a, sqrt(sum({_OFF_SIMILAR}) / any_value(m)) / nullif(any_value(extent), 0) AS off_r FROM {name}u p JOIN {name} USING (doc_id, page) GROUP BY ALL),
        {name}h AS (SELECT *, {_alias(_PARTS)} FROM {name} JOIN {name}e USING (doc_id, page))"""

    return f"""WITH raw AS ({points}), pts AS (SELECT doc_id, page, src_x, src_y, dst_x, dst_y, row_number() OVER (PARTITION BY doc_id, page ORDER BY src_x, src_y, dst_x, dst_y) - 1 AS i FROM raw), c AS (SELECT doc_id, page, count(*) AS n FROM pts GROUP BY ALL),
        s0 AS (SELECT p.doc_id, p.page, p.i AS i, q.i AS j, r.i AS k, p, q, r FROM pts p JOIN pts q ON p.doc_id = q.doc_id AND p.page = q.page AND p.i < q.i JOIN c ON c.doc_id = p.doc_id AND c.page = p.page LEFT JOIN pts r ON r.doc_id = p.doc_id AND r.page = p.page AND q.i < r.i WHERE c.n = 2 OR r.i IS NOT NULL){through},
        {won('x', _OFF_AFFINE, 'a', _BENT)}, {won('z', _OFF_SIMILAR, 'ra', '0')},
        x9 AS (SELECT *, m >= 3 AND {_sane(config)} AS sane FROM xh), z9 AS (SELECT * REPLACE (NULL::DOUBLE AS sx_, NULL::DOUBLE AS sy_) FROM zh), z10 AS (SELECT *, {_kind(config)} AS kind FROM z9),
        chosen AS (SELECT doc_id, page, m, 'affine' AS kind, a, b, c, d, ra, rb, sx_, sy_, off_a, off_r FROM x9 WHERE sane UNION ALL SELECT doc_id, page, m, kind, a, b, c, d, ra, rb, sx_, sy_, off_a, off_r FROM z10 ANTI JOIN (SELECT * FROM x9 WHERE sane) USING (doc_id, page)),
        fitted AS (SELECT doc_id, page, c.n, CAST(m AS BIGINT) AS n_used, kind, {_alias(_RESULT)} FROM chosen JOIN c USING (doc_id, page))"""
