"""Pixel operators: array functions on one image, applied to columns in Arrow batches.

An image is a struct of height, width, channels and data (row by row, 8 bits, RGB or
grey). Rotation detection by lines, feature matching and text recognition need other
libraries; they are providers, see ``sources.providers``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"
BORDER_LEVEL = 40


def grey(a: np.ndarray) -> np.ndarray:
    """Luma, with the usual weights."""
    return a if a.ndim == 2 else np.rint(a[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu(a: np.ndarray) -> np.ndarray:
    """Black and white at the threshold with the greatest variance between both sides."""
    g = grey(a)
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return np.where(g > np.nanargmax(np.nan_to_num(between, nan=-1)), 255, 0).astype(np.uint8)


def _kernel(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blurred(g: np.ndarray, size: int, sigma: float) -> np.ndarray:
    k, r = _kernel(size, sigma), size // 2
    p = np.pad(g.astype(float), r, mode="edge")
    rows = sum(k[i] * p[i : i + g.shape[0]] for i in range(size))
    return sum(k[i] * rows[:, i : i + g.shape[1]] for i in range(size))


def adaptive(a: np.ndarray, block: int = 31, c: float = 10) -> np.ndarray:
    """White where a pixel exceeds the Gaussian mean around it less c."""
    block += 1 - block % 2
    g = grey(a)
    return np.where(g > blurred(g, block, 0.3 * ((block - 1) / 2 - 1) + 0.8) - c, 255, 0).astype(np.uint8)


def sharpen(a: np.ndarray, strength: float = 1.0) -> np.ndarray:
    g = grey(a).astype(float)
    return np.clip(np.rint(g + strength * (g - blurred(g, 19, 3.0))), 0, 255).astype(np.uint8)


def equalise(a: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Local contrast: clipped histograms of a grid of equal tiles, interpolated between their centres; the image is mirrored at its end to fill them."""
    g = grey(a)
    h, w = g.shape
    full = np.pad(g, ((0, -h % grid), (0, -w % grid)), mode="reflect" if min(h, w) > grid else "edge")
    th, tw = full.shape[0] // grid, full.shape[1] // grid
    tile = (np.arange(full.shape[0]) // th * grid)[:, None] + np.arange(full.shape[1]) // tw
    n = np.bincount((tile * 256 + full).ravel(), minlength=grid * grid * 256).reshape(-1, 256).astype(float)
    top = np.maximum(1.0, clip * n.sum(1, keepdims=True) / 256)
    n = np.minimum(n, top) + np.maximum(n - top, 0).sum(1, keepdims=True) / 256
    table = (np.cumsum(n, 1) / n.sum(1, keepdims=True) * 255).reshape(grid, grid, 256)
    ty, tx = (np.clip((np.arange(s) + 0.5) / t - 0.5, 0, grid - 1) for s, t in ((h, th), (w, tw)))
    y0, x0 = ty.astype(int), tx.astype(int)
    y1, x1 = np.minimum(y0 + 1, grid - 1), np.minimum(x0 + 1, grid - 1)
    fy, fx = (ty - y0)[:, None], (tx - x0)[None]
    at = lambda y, x: table[y[:, None], x[None], g]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _window(g: np.ndarray, size: int, pick: Callable, fill: int) -> np.ndarray:
    """The smallest or largest value under a square of ``size``."""
    before = (size - 1) // 2
    p = np.pad(g, ((before, size - 1 - before), (before, size - 1 - before)), constant_values=fill)
    rows = pick.reduce([p[i : i + g.shape[0]] for i in range(size)])
    return pick.reduce([rows[:, i : i + g.shape[1]] for i in range(size)])


def closed(g: np.ndarray, size: int) -> np.ndarray:
    return _window(_window(g, size, np.maximum, 0), size, np.minimum, 255)


def opened(g: np.ndarray, size: int) -> np.ndarray:
    return _window(_window(g, size, np.minimum, 255), size, np.maximum, 0)


def clean(a: np.ndarray) -> np.ndarray:
    """Black and white, small gaps closed and specks removed."""
    return opened(closed(otsu(a), 2), 2)


def denoise(a: np.ndarray) -> np.ndarray:
    """The median of each 3 x 3 square; non-local means is left to a provider."""
    g = grey(a)
    p = np.pad(g, 1, mode="edge")
    return np.median([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)], axis=0).astype(np.uint8)


FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"grayscale": grey, "binary_otsu": otsu, "adaptive": adaptive, "clahe": equalise, "sharpen": sharpen, "denoise": denoise, "morphology": clean}
FILTERS["binary"] = otsu


def quality(a: np.ndarray) -> dict[str, float]:
    """Sharpness, contrast, noise and brightness."""
    g = grey(a).astype(float)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    edge = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return {"sharpness": round(float(edge.var()), 2), "contrast": round(float(g.std()), 2), "noise": round(float((g - blurred(g, 5, 1.1)).std()), 2), "brightness": round(float(g.mean()), 2)}


def background(a: np.ndarray) -> list[int]:
    """The median colour along the four edges."""
    a = a[..., None] if a.ndim == 2 else a
    b = max(2, min(a.shape[:2]) // 50)
    edge = np.concatenate([x.reshape(-1, a.shape[2]) for x in (a[:b], a[-b:], a[:, :b], a[:, -b:])])
    return np.median(edge, axis=0).astype(int).tolist()


def largest_region(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, w, h of the connected region with the largest box; neighbours touch at sides or corners."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        grown = np.where(mask, _window(label, 3, np.maximum, 0), 0)
        if (grown == label).all():
            break
        label = grown
    best = None
    ys, xs = np.nonzero(label)
    _, at = np.unique(label[ys, xs], return_inverse=True)
    for k in range(at.max() + 1 if len(at) else 0):
        y, x = ys[at == k], xs[at == k]
        box = (int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1)
        if best is None or box[2] * box[3] > best[2] * best[3]:
            best = box
    return best


def border(a: np.ndarray) -> tuple[int, int, int, int]:
    """The document on its background, in units of 1e-5; the whole page where its area is below 15 % or above 99.5 %."""
    a = a[..., None] if a.ndim == 2 else a
    off = np.minimum(np.abs(a.astype(int) - np.array(background(a))).sum(2), 255) > BORDER_LEVEL
    mask = off.astype(np.uint8)
    for _ in range(2):
        mask = closed(mask, 11)
    h, w = mask.shape
    box = largest_region(mask > 0)
    if box is None or not 0.15 <= box[2] * box[3] / (w * h) <= 0.995:
        return 0, 0, 100_000, 100_000
    return tuple(round(v / s * 100_000) for v, s in zip(box, (w, h, w, h)))


def rectified(a: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The quadrilateral (tl, tr, br, bl in pixels) as an upright rectangle of its longest sides, ten pixels at least."""
    q = np.array(quad, float)
    side = lambda i, j: float(np.hypot(*(q[i] - q[j])))
    w, h = (max(10, round(max(side(*p), side(*r)))) for p, r in (((0, 1), (3, 2)), ((0, 3), (1, 2))))
    to = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)
    rows = [r for (u, v), (x, y) in zip(to, q) for r in ([u, v, 1, 0, 0, 0, -x * u, -x * v, x], [0, 0, 0, u, v, 1, -y * u, -y * v, y])]
    m = np.array(rows)
    c = np.append(np.linalg.solve(m[:, :8], m[:, 8]), 1).reshape(3, 3)
    v, u = np.mgrid[0:h, 0:w]
    p = np.tensordot(c, np.stack([u, v, np.ones_like(u)]), 1)
    x, y = np.clip(np.rint(p[0] / p[2]), 0, a.shape[1] - 1).astype(int), np.clip(np.rint(p[1] / p[2]), 0, a.shape[0] - 1).astype(int)
    return a[y, x]


def matched(doc: np.ndarray, template: np.ndarray, least: float = 0.3) -> tuple[int, int, float] | None:
    """Where a template correlates best with a page (x, y, score), by Fourier transform; None below ``least``."""
    d, t = grey(doc).astype(float), grey(template).astype(float)
    if t.shape[0] > d.shape[0] or t.shape[1] > d.shape[1]:
        return None
    t = t - t.mean()
    shape = [a + b - 1 for a, b in zip(d.shape, t.shape)]
    top = np.fft.irfft2(np.fft.rfft2(d, shape) * np.fft.rfft2(t[::-1, ::-1], shape), shape)[t.shape[0] - 1 : d.shape[0], t.shape[1] - 1 : d.shape[1]]
    total = lambda a: (s := np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))))[t.shape[0] :, t.shape[1] :] - s[: -t.shape[0], t.shape[1] :] - s[t.shape[0] :, : -t.shape[1]] + s[: -t.shape[0], : -t.shape[1]]
    spread = np.sqrt(np.maximum(total(d * d) - total(d) ** 2 / t.size, 1e-9) * max((t * t).sum(), 1e-9))
    score = top / spread
    y, x = np.unravel_index(score.argmax(), score.shape)
    return (int(x), int(y), round(float(score[y, x]), 4)) if score[y, x] >= least else None


def _array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a


def _row(a: np.ndarray) -> dict:
    return {"height": a.shape[0], "width": a.shape[1], "channels": 1 if a.ndim == 2 else a.shape[2], "data": np.ascontiguousarray(a).tobytes()}


def per_image(image: Column, f: Callable[[np.ndarray], dict], result: str) -> Column:
    """f over a column of images; null for a null image and for one that f can't handle."""

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, c, d in zip(b["height"], b["width"], b["channels"], b["data"]):
                try:
                    out.append(f(_array(int(h), int(w), int(c), d)))
                except (ValueError, TypeError):
                    out.append({})
            yield pd.DataFrame(out, columns=[x.split(":")[0] for x in result.removeprefix("struct<").removesuffix(">").split(",")])

    return run(image)


#: Filters that a page goes through by default, and named chains of filters for several readings.
DEFAULT = ["grayscale", "clahe", "sharpen"]
VARIANTS = {
    "grayscale": ["grayscale"],
    "binary": ["binary_otsu"],
    "clahe": ["clahe"],
    "denoise_clahe": ["denoise", "clahe"],
    "adaptive": ["adaptive"],
    "sharpen_binary": ["sharpen", "binary_otsu"],
    "morph_clean": ["morphology"],
}


def _through(a: np.ndarray, steps: list[str]) -> dict:
    for step in steps:
        a = FILTERS[step](a) if step in FILTERS else a
    return _row(a)


def filtered(image: Column, steps: list[str] | None = None) -> Column:
    """The named filters one after another, by default DEFAULT; unknown names are passed over."""
    return per_image(image, lambda a: _through(a, DEFAULT if steps is None else steps), IMAGE)


def variants(df: DataFrame, image: str, names: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each named chain of filters, by default VARIANTS: variant and the filtered image. The images are read once."""
    chains = VARIANTS if names is None else names

    @F.pandas_udf(IMAGE)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for variant, b in batches:
            out = []
            for n, h, w, c, d in zip(variant, b["height"], b["width"], b["channels"], b["data"]):
                try:
                    out.append(_through(_array(int(h), int(w), int(c), d), chains[n]))
                except (ValueError, TypeError):
                    out.append({})
            yield pd.DataFrame(out, columns=["height", "width", "channels", "data"])

    return df.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in chains]))).withColumn(image, run("variant", image))


def image_quality(image: Column) -> Column:
    return per_image(image, quality, "struct<sharpness:double,contrast:double,noise:double,brightness:double>")


def image_border(image: Column) -> Column:
    return per_image(image, lambda a: dict(zip("xywh", border(a))), "struct<x:int,y:int,w:int,h:int>")


def turned(image: Column, quarters: int) -> Column:
    """Turned clockwise by quarters."""
    return per_image(image, lambda a: _row(np.rot90(a, -quarters)), IMAGE)
