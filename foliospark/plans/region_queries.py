"""Queries of regions, anchors and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import band_sql
from ..operators import anchors, extract, lines, matching, transforms
from .queries import CONFIG, FIELDS_SQL, ONE, BEST_SQL, REGIONS, WORDS, _forms, _matching_sql, _pages, _regions, _templates, fields, pages, query, read, words

def _box():
    return F.struct("x", "y", "w", "h")


def _flat(df, keys: list[str], *boxes: str):
    return df.select(*keys, *[F.col(f"{b}.{c}").alias(b + c) for b in boxes for c in "xywh"])


OLD = "1000 + k % 7 * 500 AS ox, 2000 + k % 5 * 300 AS oy, 60000 + k % 11 * 1000 AS ow, 70000 + k % 13 * 1000 AS oh"
NEW = "500 + n % 3 * 700 AS nx, 900 + n % 4 * 300 AS ny, 50000 + k % 17 * 1000 AS nw, 60000 + k % 19 * 1000 AS nh"


@query(f"""WITH r AS (SELECT *, {OLD}, {NEW} FROM ({REGIONS})), i AS (SELECT *, ox + (2 * x * ow + 100000) // 200000 AS ix, oy + (2 * y * oh + 100000) // 200000 AS iy, (2 * w * ow + 100000) // 200000 AS iw, (2 * h * oh + 100000) // 200000 AS ih FROM r)
    SELECT k, n, CAST(floor((200000 * (ix - nx) + nw) / (2 * nw)) AS BIGINT) AS bx, CAST(floor((200000 * (iy - ny) + nh) / (2 * nh)) AS BIGINT) AS by, (200000 * iw + nw) // (2 * nw) AS bw, (200000 * ih + nh) // (2 * nh) AS bh FROM i""")
def rebase_fields(spark, sf):
    r = _regions(spark, sf).selectExpr("*", *[e.replace(" AS ", " as ") for e in (OLD + ", " + NEW).split(", ")])
    border = lambda p: F.struct(*[F.col(p + c).alias(c) for c in "xywh"])
    return _flat(r.withColumn("b", g.rebased(_box(), border("o"), border("n"))), ["k", "n"], "b")


@query(f"""SELECT k, n, w > 0 AND h > 0 AND w::DOUBLE * h / 100000 / 100000 BETWEEN 0.15 AND 0.995 AS valid FROM (SELECT k, n, w * 2 - 20000 AS w, h * 3 - 30000 AS h FROM ({REGIONS}))""")
def border_valid(spark, sf):
    r = _regions(spark, sf).select("k", "n", F.struct("x", "y", (F.col("w") * 2 - 20_000).alias("w"), (F.col("h") * 3 - 30_000).alias("h")).alias("b"))
    return r.select("k", "n", g.valid_border(F.col("b")).alias("valid"))


@query(f"""WITH r AS (SELECT k, n, 2 * x - 20000 AS x, 2 * y - 20000 AS y, w, h, 90 + k % 40 AS pw, 120 + n AS ph FROM ({REGIONS})),
    c AS (SELECT *, greatest(0, least(CAST(floor(x * pw / 100000) AS BIGINT), pw - 1)) AS l, greatest(0, least(CAST(floor(y * ph / 100000) AS BIGINT), ph - 1)) AS t FROM r)
    SELECT k, n, l AS "left", t AS top, greatest(l + 1, least(CAST(floor((x + w) * pw / 100000) AS BIGINT), pw)) AS "right", greatest(t + 1, least(CAST(floor((y + h) * ph / 100000) AS BIGINT), ph)) AS bottom FROM c""")
def pixel_crops(spark, sf):
    r = _regions(spark, sf).selectExpr("k", "n", "2 * x - 20000 as x", "2 * y - 20000 as y", "w", "h", "90 + k % 40 as pw", "120 + n as ph")
    return r.select("k", "n", g.pixel_crop(_box(), F.col("pw"), F.col("ph")).alias("c")).select("k", "n", "c.*")


@query(f"""WITH r AS (SELECT k, n, x, y, CASE WHEN k % 5 = 0 THEN 0 ELSE w END AS w, h FROM ({REGIONS}))
    SELECT k, n, CASE WHEN w > 0 THEN greatest(0, x - (8 * w + 10) // 20) END AS cx, CASE WHEN w > 0 THEN greatest(0, y - (8 * h + 10) // 20) END AS cy, CASE WHEN w > 0 THEN least(100000, (36 * w + 10) // 20) END AS cw, CASE WHEN w > 0 THEN least(100000, (36 * h + 10) // 20) END AS ch FROM r""")
def preview_crops(spark, sf):
    r = _regions(spark, sf).withColumn("w", F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("w")))
    return _flat(r.withColumn("c", g.preview_crop(_box())), ["k", "n"], "c")


@query(f"""WITH r AS (SELECT *, ['nw', 'ne', 'sw', 'se'][k % 4 + 1] AS c, (k * 37) % 110000 - 5000 AS px, (n * 13001) % 110000 - 5000 AS py FROM ({REGIONS})),
    m AS (SELECT *, CASE WHEN c IN ('nw', 'sw') THEN least(px, x + w - 1000) ELSE x END AS nx, CASE WHEN c IN ('nw', 'ne') THEN least(py, y + h - 1000) ELSE y END AS ny FROM r),
    d AS (SELECT k, n, nx AS dx, ny AS dy, CASE WHEN c IN ('nw', 'sw') THEN x + w - nx ELSE greatest(1000, px - x) END AS dw, CASE WHEN c IN ('nw', 'ne') THEN y + h - ny ELSE greatest(1000, py - y) END AS dh FROM m)
    SELECT k, n, dx, dy, dw, dh, least(100000, greatest(0, dx)) AS cx, least(100000, greatest(0, dy)) AS cy, least(100000, greatest(0, dw)) AS cw, least(100000, greatest(0, dh)) AS ch FROM d""")
def dragged_boxes(spark, sf):
    corner = F.element_at(F.array(*[F.lit(c) for c in ("nw", "ne", "sw", "se")]), (F.col("k") % 4 + 1).cast("int"))
    r = _regions(spark, sf).withColumn("d", g.dragged(_box(), corner, F.col("k") * 37 % 110_000 - 5000, F.col("n") * 13_001 % 110_000 - 5000))
    return _flat(r.withColumn("c", g.clamped(F.col("d"))), ["k", "n"], "d", "c")


@query(f"""WITH r AS (SELECT *, CASE WHEN k % 6 = 0 THEN 0 ELSE 2000 + k % 9 * 2000 END AS ew, 3000 + n * 1000 AS eh FROM ({REGIONS})),
    a AS (SELECT *, w > 0 AND h > 0 AND w::DOUBLE * h <= 0.12 * 100000 * 100000 AND (ew <= 0 OR w <= 4 * ew + 5000) AND h <= 4 * eh + 5000 AS ok, CASE WHEN ew > 0 THEN ew ELSE w END AS aw FROM r)
    SELECT k, n, CASE WHEN ok THEN greatest(0, CAST(floor((2 * x + w - aw + 1) / 2) AS BIGINT)) END AS ax, CASE WHEN ok THEN greatest(0, CAST(floor((2 * y + h - eh + 1) / 2) AS BIGINT)) END AS ay, CASE WHEN ok THEN aw END AS aw, CASE WHEN ok THEN eh END AS ah FROM a""")
def accepted_regions(spark, sf):
    r = _regions(spark, sf).withColumn("ew", F.when(F.col("k") % 6 == 0, 0).otherwise(2000 + F.col("k") % 9 * 2000)).withColumn("eh", 3000 + F.col("n") * 1000)
    return _flat(r.withColumn("a", g.accepted_region(_box(), F.col("ew"), F.col("eh"))), ["k", "n"], "a")


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 4) * 90 - 90 AS ratio, (l_suppkey % 4) * 90 AS txt, l_quantity % 30 / 10 AS conf, CAST(l_partkey % 720 - 360 AS DOUBLE) AS a FROM lineitem)
    SELECT k, n, CAST(CASE WHEN conf >= CASE WHEN ((ratio + 360) % 360) % 180 = txt % 180 THEN 1.0 ELSE 2.0 END THEN txt ELSE (ratio + 360) % 360 END AS BIGINT) AS turn,
        CASE WHEN abs(a - round(a / 90) * 90) <= 20 THEN (CAST(round(a / 90) * 90 AS INTEGER) % 360 + 360) % 360 ELSE 0 END AS snapped FROM r""")
def quarter_turns(spark, sf):
    r = read(spark, sf, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as n", "(l_partkey % 4) * 90 - 90 as ratio", "(l_suppkey % 4) * 90 as txt", "cast(l_quantity as double) % 30 / 10 as conf", "cast(l_partkey % 720 - 360 as double) as a")
    return r.select("k", "n", g.cardinal(F.col("ratio"), F.col("txt"), F.col("conf")).alias("turn"), g.snapped(F.col("a")).alias("snapped"))


@query(f"""{WORDS}, {FIELDS_SQL}, p AS (SELECT DISTINCT doc_id, page FROM words),
    inside AS (SELECT w.doc_id, w.page, key, string_agg(text, ' ' ORDER BY y, x, word_no) AS value FROM words w JOIN fields f ON f.template_id = (w.doc_id + w.page) % 3
        AND 2 * x + w BETWEEN 2 * fx AND 2 * (fx + fw) AND 2 * y + h BETWEEN 2 * fy AND 2 * (fy + fh) GROUP BY ALL)
    SELECT p.doc_id, p.page, f.key, coalesce(value, '') AS value FROM p JOIN fields f ON f.template_id = (p.doc_id + p.page) % 3 LEFT JOIN inside USING (doc_id, page, key)""")
def text_in_regions(spark, sf):
    return extract.text_in_regions(pages(spark, sf).withColumn("template_id", F.pmod(F.col("doc_id") + F.col("page"), F.lit(3))), fields(spark))


@query(f"""{WORDS}, {FIELDS_SQL}, p AS (SELECT DISTINCT doc_id, page, 1.25::DOUBLE AS a, (doc_id % 3) / 32.0::DOUBLE AS b, CAST(page % 5 * 16 AS DOUBLE) AS tx, -(doc_id % 2) / 64.0::DOUBLE AS c, 0.75::DOUBLE AS d, -8.0::DOUBLE AS ty, doc_id % 4 > 0 AS moved FROM words),
    q AS (SELECT p.*, f.key, f.fx, f.fy, f.fw, f.fh, fx * 1024 / 100000.0::DOUBLE AS x0, (fx + fw) * 1024 / 100000.0::DOUBLE AS x1, fy * 2048 / 100000.0::DOUBLE AS y0, (fy + fh) * 2048 / 100000.0::DOUBLE AS y1 FROM p JOIN fields f ON f.template_id = (doc_id + page) % 3),
    r AS (SELECT *, CAST(floor(least(a * x0 + b * y0 + tx, a * x0 + b * y1 + tx, a * x1 + b * y0 + tx, a * x1 + b * y1 + tx) / 1024 * 100000 + 0.5) AS BIGINT) AS lx, CAST(floor(greatest(a * x0 + b * y0 + tx, a * x0 + b * y1 + tx, a * x1 + b * y0 + tx, a * x1 + b * y1 + tx) / 1024 * 100000 + 0.5) AS BIGINT) AS hx,
        CAST(floor(least(c * x0 + d * y0 + ty, c * x0 + d * y1 + ty, c * x1 + d * y0 + ty, c * x1 + d * y1 + ty) / 2048 * 100000 + 0.5) AS BIGINT) AS ly, CAST(floor(greatest(c * x0 + d * y0 + ty, c * x0 + d * y1 + ty, c * x1 + d * y0 + ty, c * x1 + d * y1 + ty) / 2048 * 100000 + 0.5) AS BIGINT) AS hy FROM q),
    b AS (SELECT doc_id, page, key, CASE WHEN moved THEN lx ELSE fx END AS bx, CASE WHEN moved THEN ly ELSE fy END AS by_, CASE WHEN moved THEN hx - lx ELSE fw END AS bw, CASE WHEN moved THEN hy - ly ELSE fh END AS bh FROM r),
    i AS (SELECT b.doc_id, b.page, b.key, string_agg(text, ' ' ORDER BY {band_sql('y')}, x, word_no) AS value, count(*) AS n FROM b JOIN words w ON w.doc_id = b.doc_id AND w.page = b.page AND 100 * (2 * x + w) BETWEEN 200 * bx - 2 * greatest(8 * bw, 60000) AND 200 * (bx + bw) + 2 * greatest(8 * bw, 60000)
        AND 100 * (2 * y + h) BETWEEN 200 * by_ - 2 * greatest(15 * bh, 100000) AND 200 * (by_ + bh) + 2 * greatest(15 * bh, 100000) GROUP BY ALL)
    SELECT b.doc_id, b.page, b.key, coalesce(value, '') AS value, coalesce(n, 0) AS n_words FROM b LEFT JOIN i USING (doc_id, page, key)""")
def transformed_fields(spark, sf):
    """Fields on pages that a transform carries the template onto."""
    w = extract.page_words(pages(spark, sf).withColumn("template_id", F.pmod(F.col("doc_id") + F.col("page"), F.lit(3))), "template_id")
    matrix = F.expr("if(doc_id % 4 > 0, array(array(1.25D, (doc_id % 3) / 32D, cast(page % 5 * 16 as double)), array(-(doc_id % 2) / 64D, 0.75D, -8D)), null)")
    return extract.transformed_fields(w.select("doc_id", "page", "template_id", "ws", matrix.alias("matrix"), F.lit(1024).alias("width"), F.lit(2048).alias("height")), fields(spark))


JITTER = "(word_no * 7919 + doc_id * 31) % 2600"


@query(f"""WITH RECURSIVE {WORDS.removeprefix('WITH ')}, j AS (SELECT doc_id, page, text, x, y + {JITTER} AS y, w, h, conf, row_number() OVER (PARTITION BY doc_id, page ORDER BY y + {JITTER}, x, w, h, conf, text) AS r FROM words),
    l AS (SELECT doc_id, page, r, y AS y0, 0 AS line FROM j WHERE r = 1 UNION ALL SELECT j.doc_id, j.page, j.r, CASE WHEN j.y - y0 < 1000 THEN y0 ELSE j.y END, line + CASE WHEN j.y - y0 < 1000 THEN 0 ELSE 1 END FROM l JOIN j ON j.doc_id = l.doc_id AND j.page = l.page AND j.r = l.r + 1)
    SELECT doc_id, page, CAST(line AS BIGINT) AS line, string_agg(text, ' ' ORDER BY x, y, text) AS text FROM l JOIN j USING (doc_id, page, r) GROUP BY ALL""")
def group_lines_jittered(spark, sf):
    """Lines where each word's y is off by up to a row and more, so that only the first word of a line tells where it ends."""
    w = pages(spark, sf).withColumn("ws", F.transform("ws", lambda v: v.withField("y", v["y"] + (v["word_no"] * 7919 + F.col("doc_id") * 31) % 2600)))
    return lines.line_texts(lines.group_lines(w))


# Anchors


@query("""SELECT l_orderkey AS doc_id, CAST(0 AS BIGINT) AS page, 2 * l_partkey + 10 AS src_x, 2 * l_suppkey + 20 AS src_y, 2 * (l_partkey + 5) + 10 AS dst_x, 2 * (l_suppkey + 7) + 20 AS dst_y FROM lineitem WHERE l_linenumber % 3 > 0 AND l_suppkey % 5 > 0""")
def anchor_pairs(spark, sf):
    l = read(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "0L as page", "l_linenumber % 3 > 0 as found", "named_struct('x', l_partkey, 'y', l_suppkey, 'w', 10, 'h', 20) as source", "if(l_suppkey % 5 > 0, named_struct('x', l_partkey + 5, 'y', l_suppkey + 7, 'w', 10, 'h', 20), null) as target")
    return anchors.anchor_pairs(l)


@query("""WITH l AS (SELECT l_orderkey AS doc_id, (l_linenumber % 4) * 90 AS angle, l_returnflag <> 'A' AS found, greatest(0, CASE WHEN round(l_tax * 100 - 2) = 0 THEN 1 ELSE round(l_tax * 100 - 2) END) AS w FROM lineitem),
    s AS (SELECT doc_id, angle, coalesce(sum(CASE WHEN found THEN w ELSE 0 END) / nullif(sum(w), 0), 0.0) AS score FROM l GROUP BY ALL)
    SELECT doc_id, 0 AS page, angle, floor(score * 10000 + 0.5) / 10000 AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, angle) = 1""")
def text_orientation(spark, sf):
    return anchors.text_orientation(read(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "0 as page", "l_linenumber % 4 * 90 as angle", "l_returnflag <> 'A' as found", "cast(round(l_tax * 100 - 2) as double) as weight"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, c AS candidate, CAST((l_partkey + c * 7) % 11 AS BIGINT) AS score FROM lineitem, (VALUES (0), (90), (180), (270)) v(c) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_partkey + c * 7) % 11 DESC, c) = 1""")
def try_candidates(spark, sf):
    """The best of four angles by a function that the caller gives."""
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey")
    return anchors.best_candidate(items, [0, 90, 180, 270], lambda c: (F.col("l_partkey") + c * 7) % 11, "k", "n")


@query("""SELECT l_orderkey AS doc_id, list_sort(list(l_partkey))[len(list(l_partkey)) // 2 + 1] AS middle, count(*) FILTER (l_returnflag = 'N') AS n_found, count(*) AS n, bool_and(l_returnflag = 'N') AS all_found FROM lineitem GROUP BY 1""")
def located_summary(spark, sf):
    l = read(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "0 as page", "l_returnflag = 'N' as found", "l_partkey")
    middle = l.groupBy("doc_id").agg(anchors.upper_median(F.collect_list("l_partkey")).alias("middle"))
    return anchors.located_summary(l).drop("page").join(middle, "doc_id")


LOCATED = "SELECT DISTINCT s.doc_id, s.page, t.template_id FROM (SELECT DISTINCT doc_id, page FROM pairs) s JOIN (SELECT DISTINCT template_id FROM pairs) t ON t.template_id IN ((s.doc_id * 7) % 40, (s.doc_id * 7 + 11) % 40, (s.doc_id * 7 + 22) % 40)"


@query(f"""{_matching_sql(ONE)}, best AS {BEST_SQL}, located AS ({LOCATED}),
    tried AS (SELECT l.*, p.score AS base, ((l.doc_id * 7 + l.template_id * 13) % 101) / 100.0::DOUBLE AS anchor FROM located l JOIN pairs p USING (doc_id, page, template_id)),
    c AS (SELECT s.doc_id, s.page, b.template_id AS c_id, coalesce(b.score, 0.0) AS c_score FROM (SELECT DISTINCT doc_id, page FROM pairs) s LEFT JOIN best b USING (doc_id, page)),
    a AS (SELECT doc_id, page, template_id, floor((0.5::DOUBLE * CASE WHEN template_id = c_id THEN c_score ELSE base END + 0.5::DOUBLE * anchor) * 10000 + 0.5) / 10000 AS total, c_score FROM tried JOIN c USING (doc_id, page)),
    w AS (SELECT * FROM a WHERE total > c_score QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY total DESC, template_id) = 1)
    SELECT doc_id, page, coalesce(w.template_id, c_id) AS template_id, coalesce(w.total, c.c_score) AS score FROM c LEFT JOIN w USING (doc_id, page)""")
def anchor_selection(spark, sf):
    """Templates with anchors located on a page may replace the one that its signature chose."""
    pages, templates = _pages(words(spark, sf)), _templates(spark, sf)
    chosen = pages.select("doc_id", "page").join(matching.best_of_templates(pages, templates), ["doc_id", "page"], "left")
    t = templates.select("template_id", *[F.col(c).alias(f"t_{c}") for c in ("aspect", "colour", "density")])
    tried = pages.withColumn("template_id", F.explode(F.array_distinct(F.array(*[(F.col("doc_id") * 7 + k) % 40 for k in (0, 11, 22)])))).join(t, "template_id")
    base = matching.similarity({c: F.col(c) for c in ("aspect", "colour", "density")}, {c: F.col(f"t_{c}") for c in ("aspect", "colour", "density")})
    tried = tried.select("doc_id", "page", "template_id", base.alias("base"), ((F.col("doc_id") * 7 + F.col("template_id") * 13) % 101 / 100.0).alias("anchor"))
    return matching.anchor_selection(chosen, tried, CONFIG)


@query(f"""{_matching_sql(ONE)} SELECT doc_id, page, template_id, CASE WHEN doc_id % 3 = 0 THEN score ELSE floor(((1 - 0.6::DOUBLE) * score + 0.6::DOUBLE * ((doc_id % 3) / 3.0::DOUBLE)) * 10000 + 0.5) / 10000 END AS score FROM {BEST_SQL}""")
def combined_similarity(spark, sf):
    best = matching.best_of_templates(_pages(words(spark, sf)), _templates(spark, sf))
    return best.select("doc_id", "page", "template_id", matching.combined(F.col("score"), F.col("doc_id") % 3 / 3.0, CONFIG).alias("score"))


# Transforms

POINTS = """SELECT l_orderkey AS doc_id, 0 AS page, l_linenumber AS i, CAST((l_partkey * 37) % 1000 AS DOUBLE) AS src_x, CAST((l_suppkey * 61 + l_linenumber * 97) % 1400 AS DOUBLE) AS src_y, l_orderkey % 5 AS form, l_linenumber % 7 = 3 AS off FROM lineitem"""
MOVED = f"""SELECT doc_id, page, i, src_x, src_y, CASE WHEN form = 0 THEN 2 * src_x + 10 WHEN form = 1 THEN src_x + 40 * src_y ELSE 1.5 * src_x - 0.25 * src_y + 30 END + CASE WHEN off AND form = 3 THEN 900 ELSE 0 END AS dst_x,
    CASE WHEN form = 0 THEN src_y - 20 WHEN form = 1 THEN src_y ELSE 0.25 * src_x + 1.5 * src_y - 7 END + CASE WHEN off AND form = 3 THEN -700 ELSE 0 END AS dst_y FROM ({POINTS})"""


@query(f"{transforms.fit_sql(MOVED)} SELECT doc_id, page, n, n_used, kind, round(scale, 3) AS scale, round(angle, 2) + 0.0 AS angle, round(residual, 3) AS residual FROM fitted")
def fit_anchors(spark, sf):
    """Affine or similarity transforms of located anchors, some of them far off."""
    fit = transforms.fit_anchors(_points(spark, sf), CONFIG)
    return fit.select("doc_id", "page", "n", "n_used", "kind", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("scale", 3), ("angle", 2), ("residual", 3))])


SCATTERED = MOVED.replace("off AND form = 3", "i % 4 = 2 AND form > 1").replace("THEN 900", "THEN 900 + 61 * i").replace("THEN -700", "THEN -700 - 43 * i")


@query(f"{transforms.consensus_sql(SCATTERED)} SELECT doc_id, page, n, n_used, kind, round(scale, 3) AS scale, round(angle, 2) + 0.0 AS angle, round(residual, 3) AS residual FROM fitted")
def fit_anchors_by_consensus(spark, sf):
    """Transforms of located anchors, up to two of five of which are off, each its own way."""
    fit = transforms.consensus_fit(_points(spark, sf, True), CONFIG)
    return fit.select("doc_id", "page", "n", "n_used", "kind", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("scale", 3), ("angle", 2), ("residual", 3))])


def _points(spark, sf, scattered: bool = False):
    p = read(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "0 as page", "cast((l_partkey * 37) % 1000 as double) as src_x", "cast((l_suppkey * 61 + l_linenumber * 97) % 1400 as double) as src_y", "l_orderkey % 5 as form", "l_linenumber as i", "l_linenumber % 4 = 2 and l_orderkey % 5 > 1 as off" if scattered else "l_linenumber % 7 = 3 and l_orderkey % 5 = 3 as off")
    by_x, by_y = ("900 + 61 * i", "-700 - 43 * i") if scattered else ("900", "-700")
    return p.selectExpr(
        "doc_id", "page", "src_x", "src_y", f"case when form = 0 then 2 * src_x + 10 when form = 1 then src_x + 40 * src_y else 1.5D * src_x - 0.25D * src_y + 30 end + if(off, {by_x}, 0) as dst_x",
        f"case when form = 0 then src_y - 20 when form = 1 then src_y else 0.25D * src_x + 1.5D * src_y - 7 end + if(off, {by_y}, 0) as dst_y",
    )
