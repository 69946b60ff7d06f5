"""Boxes on a page, as integers in units of 1e-5 of its width or height.

Coordinates are rounded to five decimals wherever they are stored, so integers lose
nothing and results agree between engines to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 100_000
#: Whether a y that lies half-way between two hundredths rounds up when its decimal is rounded as a binary double.
HALF_UP = [int(round(round((1000 * q + 500) / PAGE, 2) * 100)) > q for q in range(100)]


def band(y: Column) -> Column:
    """The reading-order band of y: its decimal rounded to hundredths, ties as binary doubles round."""
    q, r = F.floor(y / 1000), F.pmod(y, F.lit(1000))
    up = F.element_at(F.array(*[F.lit(b) for b in HALF_UP]), (F.pmod(q, F.lit(100)) + 1).cast("int"))
    return (q + F.when((r > 500) | ((r == 500) & up), 1).otherwise(0)).cast("long")


def band_sql(y: str) -> str:
    """The same in SQL."""
    ups = ", ".join(str(q) for q, u in enumerate(HALF_UP) if u)
    return f"({y} // 1000 + CASE WHEN {y} % 1000 > 500 OR ({y} % 1000 = 500 AND ({y} // 1000) % 100 IN ({ups})) THEN 1 ELSE 0 END)"


def div_round(a: Column, b: Column) -> Column:
    """a / b rounded half up, for integers with b > 0."""
    return F.floor((2 * a + b) / (2 * b)).cast("long")


def to_image(f: Column, border: Column) -> Column:
    """A box relative to a border, in the image; a null border is the whole page."""
    b = F.coalesce(border, F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(PAGE).alias("w"), F.lit(PAGE).alias("h")))
    page = F.lit(PAGE)
    return F.struct(
        (b["x"] + div_round(f["x"] * b["w"], page)).alias("x"), (b["y"] + div_round(f["y"] * b["h"], page)).alias("y"),
        div_round(f["w"] * b["w"], page).alias("w"), div_round(f["h"] * b["h"], page).alias("h"),
    )


def to_border(r: Column, border: Column) -> Column:
    """A box of the image, relative to a border whose sides count as one unit at least."""
    b = F.coalesce(border, F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(PAGE).alias("w"), F.lit(PAGE).alias("h")))
    w, h = F.greatest(b["w"], F.lit(1)), F.greatest(b["h"], F.lit(1))
    return F.struct(
        div_round((r["x"] - b["x"]) * PAGE, w).alias("x"), div_round((r["y"] - b["y"]) * PAGE, h).alias("y"),
        div_round(r["w"] * PAGE, w).alias("w"), div_round(r["h"] * PAGE, h).alias("h"),
    )


def contains_centre(word: Column, box: Column, padded: bool = True) -> Column:
    """Whether the centre of a word lies in a closed box, by default padded by 8 % of its width (0.006 at least) and 15 % of its height (0.010 at least)."""
    px = F.greatest(8 * box["w"], F.lit(60_000)) if padded else F.lit(0)
    py = F.greatest(15 * box["h"], F.lit(100_000)) if padded else F.lit(0)
    cx, cy = 100 * (2 * word["x"] + word["w"]), 100 * (2 * word["y"] + word["h"])
    return (cx >= 200 * box["x"] - 2 * px) & (cx <= 200 * (box["x"] + box["w"]) + 2 * px) & (cy >= 200 * box["y"] - 2 * py) & (cy <= 200 * (box["y"] + box["h"]) + 2 * py)


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Areas of the intersection and of the union of two boxes."""
    ix = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = ix * iy
    return inter, a["w"] * a["h"] + b["w"] * b["h"] - inter


def same_region(a: Column, b: Column) -> Column:
    """Whether intersection over union is one half or more."""
    inter, union = overlap(a, b)
    return (inter > 0) & (union > 0) & (2 * inter >= union)


def transformed(box: Column, matrix: Column, width: Column, height: Column) -> Column:
    """The box around the four corners of a box, mapped in pixels by an affine matrix [[a, b, tx], [c, d, ty]]."""
    xs = [box["x"] * width / PAGE, (box["x"] + box["w"]) * width / PAGE]
    ys = [box["y"] * height / PAGE, (box["y"] + box["h"]) * height / PAGE]
    px = [matrix[0][0] * x + matrix[0][1] * y + matrix[0][2] for x in xs for y in ys]
    py = [matrix[1][0] * x + matrix[1][1] * y + matrix[1][2] for x in xs for y in ys]
    unit = lambda v, side: F.floor(v / side * PAGE + 0.5).cast("long")
    x0, y0, x1, y1 = unit(F.least(*px), width), unit(F.least(*py), height), unit(F.greatest(*px), width), unit(F.greatest(*py), height)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def border_of(box: Column) -> Column:
    """A transformed page as border: x and y clamped to the page, sides to at least 0.05 and to what is left of it."""
    x, y = F.least(F.greatest(box["x"], F.lit(0)), F.lit(PAGE)), F.least(F.greatest(box["y"], F.lit(0)), F.lit(PAGE))
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(5000), F.least(box["w"], PAGE - x)).cast("long").alias("w"), F.greatest(F.lit(5000), F.least(box["h"], PAGE - y)).cast("long").alias("h"))


def valid_border(box: Column) -> Column:
    """Positive sides and an area of 0.15 to 0.995 of the page."""
    area = box["w"].cast("double") * box["h"] / PAGE / PAGE
    return (box["w"] > 0) & (box["h"] > 0) & area.between(0.15, 0.995)


def affine_parts(m: Column) -> Column:
    """Scales, shear and angle (degrees) of a 2x3 matrix."""
    sx = F.hypot(m[0][0], m[1][0])
    det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    shear = (m[0][0] * m[0][1] + m[1][0] * m[1][1]) / F.when(sx > 0, sx * sx)
    return F.struct(sx.alias("scale_x"), (det / F.when(sx > 0, sx)).alias("scale_y"), shear.alias("shear"), F.degrees(F.atan2(m[1][0], m[0][0])).alias("angle"))


def snapped(angle: Column) -> Column:
    """The nearest quarter turn if it is within 20 degrees, else 0."""
    near = F.round(angle / 90) * 90
    return F.when(F.abs(angle - near) <= 20, F.pmod(near.cast("int"), F.lit(360))).otherwise(0)


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def rebased(box: Column, old: Column, new: Column) -> Column:
    """A box relative to an old border, relative to a new one: its place in the image stays."""
    return to_border(to_image(box, old), new)


def pixel_crop(box: Column, width: Column, height: Column) -> Column:
    """left, top, right, bottom in pixels: cut off to whole pixels, inside the image, one pixel wide and high at least."""
    at = lambda v, side: F.floor(v * side / PAGE).cast("long")
    inside = lambda v, least, most: F.greatest(F.lit(least) if isinstance(least, int) else least, F.least(v, most))
    left, top = inside(at(box["x"], width), 0, width - 1), inside(at(box["y"], height), 0, height - 1)
    right, bottom = at(box["x"] + box["w"], width), at(box["y"] + box["h"], height)
    return F.struct(left.alias("left"), top.alias("top"), inside(right, left + 1, width).alias("right"), inside(bottom, top + 1, height).alias("bottom"))


def preview_crop(box: Column) -> Column:
    """A box with a margin of 40 % of its sides all around, for a preview; null for an empty one."""
    x, y = (F.greatest(F.lit(0), box[p] - div_round(4 * box[s], F.lit(10))) for p, s in ("xw", "yh"))
    w, h = (F.least(F.lit(PAGE), div_round(18 * box[s], F.lit(10))) for s in "wh")
    return F.when((box["w"] > 0) & (box["h"] > 0), _box(x, y, w, h))


def dragged(box: Column, corner: Column, px: Column, py: Column, least: int = 1000) -> Column:
    """A box after one corner (nw, ne, sw, se) was dragged to a point: the opposite one stays and sides keep ``least``."""
    west, north = corner.isin("nw", "sw"), corner.isin("nw", "ne")
    right, bottom = box["x"] + box["w"], box["y"] + box["h"]
    x, y = F.when(west, F.least(px, right - least)).otherwise(box["x"]), F.when(north, F.least(py, bottom - least)).otherwise(box["y"])
    return _box(x, y, F.when(west, right - x).otherwise(F.greatest(F.lit(least), px - box["x"])), F.when(north, bottom - y).otherwise(F.greatest(F.lit(least), py - box["y"])))


def clamped(box: Column) -> Column:
    """Every number of a box within the page."""
    return _box(*[F.least(F.lit(PAGE), F.greatest(F.lit(0), box[c])) for c in "xywh"])


def accepted_region(found: Column, want_w: Column, want_h: Column) -> Column:
    """A region that a search for a patch found, at the patch's own size (0: unknown) around the centre found; null where it can't be right.

    It must have positive sides, at most 0.12 of the page's area, and no side above four times the patch's plus 0.05.
    """
    area = found["w"].cast("double") * found["h"] <= 0.12 * PAGE * PAGE
    side = lambda c, want: (want <= 0) | (found[c] <= 4 * want + 5000)
    own = lambda c, want: F.when(want > 0, want).otherwise(found[c])
    at = lambda p, s, want: F.greatest(F.lit(0), F.floor((2 * found[p] + found[s] - own(s, want) + 1) / 2))
    good = (found["w"] > 0) & (found["h"] > 0) & area & side("w", want_w) & side("h", want_h)
    return F.when(good, _box(at("x", "w", want_w), at("y", "h", want_h), own("w", want_w), own("h", want_h)))


def cardinal(by_ratio: Column, by_text: Column, confidence: Column) -> Column:
    """The quarter turn that sets a page upright, from its proportions and from the orientation of its text.

    Where both agree on the axis the text decides if it is known with a confidence of 1, otherwise with one of 2.
    """
    ratio, text = F.pmod(by_ratio, F.lit(360)), F.pmod(by_text, F.lit(360))
    return F.when(confidence >= F.when(ratio % 180 == text % 180, 1.0).otherwise(2.0), text).otherwise(ratio)
