"""Main text of pages: a recurrent network reads all blocks of a page and labels each as article or other."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast
from .html_blocks import HASHED, Block, Element, blocks, place

#: Pages that the network is fitted on, the first by a hash of url and html; larger pages are not used to fit, so at most FIT_PAGES * FIT_BYTES (19 MB) go to the driver.
FIT_PAGES, FIT_BYTES = 300, 1 << 16
#: Layouts made of the texts of these pages, besides the pages themselves.
FIT_LAYOUTS, ROUNDS, AT_ONCE, SEED = 1500, 8, 32, 7
#: The share of layouts with very many blocks, and of those with hardly more than an article; that of blocks read without their words while fitting; how fast vectors of words fade meanwhile.
LONG, BARE, SILENT, FADE = 0.06, 0.25, 0.5, 0.002
#: Sizes of the vectors of a path and of words, and of the state in each direction.
PATH, WORDS, SHAPE, STATE = 24, 8, 5, 24
#: Pages that are read by the network together, and numbers of a step of theirs.
TOGETHER, NUMBERS = 256, 1 << 22

# Words in names of elements, by what such an element holds.
MAIN = "article content post entry main story body text page blog single prose".split()
OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs links topnav toc pagination pager tabs".split(),
    "header": "header masthead top topbar banner logo branding hero title site".split(),
    "footer": "footer foot copyright colophon bottom legal site imprint".split(),
    "aside": "sidebar aside widget related rail secondary recommended popular trending more side teaser box".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay privacy message warning paywall announcement".split(),
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion adslot banner commercial".split(),
    "form": "form search login signup newsletter subscribe contact register subscription".split(),
    "comments": "comment comments discussion replies reply disqus respond thread reader user feedback reviews commentlist".split(),
    "share": "share social sharing follow buttons tags byline meta author".split(),
}
#: Names and tags that tell without doubt, from which pages are labelled to fit.
SURE_OTHER = frozenset("nav menu navbar navigation breadcrumbs masthead footer copyright colophon sidebar widget related cookie cookies consent notice gdpr ad ads advert advertisement sponsored promo newsletter login signup comment comments discussion replies disqus share social".split())
SELF_EVIDENT = frozenset("nav header footer aside form".split())
OTHER_TAGS, MAIN_TAGS = frozenset("nav aside footer form button select label".split()), frozenset(("article", "main"))


def labels_of(page: list[Block]) -> list[bool] | None:
    """Which blocks are article text, where the page marks its article; None where it doesn't."""
    marks = []
    for b in page:
        main = other = False
        e: Element | None = b.element
        while e is not None and not other:
            main |= e.tag in MAIN_TAGS
            other = e.tag in OTHER_TAGS or (e.tag == "header" and not main) or not SURE_OTHER.isdisjoint(e.names)
            e = e.parent
        marks.append(main and not other)
    return marks if any(marks) else None


def shape(page: list[Block]) -> np.ndarray:
    """Length, share of links, share of digits, how it ends, and words of each block."""
    out = np.zeros((len(page), SHAPE), np.float32)
    for i, b in enumerate(page):
        n = len(b.text)
        out[i] = (math.log1p(n) / 6, b.linked / n, sum(map(str.isdigit, b.text[:200])) / min(n, 200), b.text[-1] in ".!?…。", math.log1p(b.text.count(" ")) / 5)
    return out


class Rows:
    """Bags of hashed things, one a row, as flat arrays."""

    def __init__(self, bags: list[dict[int, float]]):
        self.n = len(bags)
        self.row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        self.at = np.fromiter((k for b in bags for k in b), np.int64, len(self.row))
        self.weight = np.fromiter((w for b in bags for w in b.values()), np.float32, len(self.row))

    def of(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), np.float32)
        np.add.at(out, self.row, table[self.at] * self.weight[:, None])
        return out

    def back(self, table: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros_like(table)
        np.add.at(out, self.at, d[self.row] * self.weight[:, None])
        return out


def word_bag(text: str) -> dict[int, float]:
    """Places of a block's words, weighing 1 together."""
    words = text.lower().split()
    out: dict[int, float] = {}
    for w in words:
        k = place(w)
        out[k] = out.get(k, 0.0) + 1 / len(words)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _steps(x: np.ndarray, w: np.ndarray, alive: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of an LSTM over x (step, page, number); ``alive`` is how many pages, the longest first, have a block at each step."""
    h = np.zeros((x.shape[1], STATE), np.float32)
    c, out = h.copy(), np.zeros((*x.shape[:2], STATE), np.float32)
    w_in, w_state, bias = w[: x.shape[2]], w[x.shape[2] : -1], w[-1]
    for t in range(len(x)):
        k = alive[t]
        z = x[t, :k] @ w_in + h[:k] @ w_state + bias
        gates, g = _sigmoid(z[:, : 3 * STATE]), np.tanh(z[:, 3 * STATE :])
        i, f, o = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
        before, h_before = c[:k], h[:k]
        c = f * before + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t, :k] = h
        if keep is not None:
            keep.append((h_before, before, i, f, o, g, tc))
    return out


def _steps_back(x: np.ndarray, w: np.ndarray, alive: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of :func:`_steps` for w and x."""
    n = x.shape[2]
    w_in, w_state = w[:n], w[n:-1]
    dw, dx = np.zeros_like(w), np.zeros_like(x)
    dh = dc = np.zeros((0, STATE), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h_before, before, i, f, o, g, tc = kept[t]
        k = alive[t]
        grow = lambda a: np.concatenate([a, np.zeros((k - len(a), STATE), np.float32)])
        dh, dc = grow(dh) + d_out[t, :k], grow(dc)
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
        dw[:n] += x[t, :k].T @ dz
        dw[n:-1] += h_before.T @ dz
        dw[-1] += dz.sum(0)
        dx[t, :k] = dz @ w_in.T
        dh, dc = dz @ w_state.T, dc * f
    return dw, dx


class BlockLabeller:
    """A bidirectional LSTM over the blocks of a page. Each block is read as the vector of its path, that of its words and its shape."""

    def __init__(self, seed: int = SEED):
        rng, n = np.random.default_rng(seed), PATH + WORDS + SHAPE
        start = lambda *size: (rng.standard_normal(size) / math.sqrt(size[0])).astype(np.float32)
        # vectors start at zero, so that names and words never met in fitting say nothing
        self.p = {"path": np.zeros((HASHED, PATH), np.float32), "words": np.zeros((HASHED, WORDS), np.float32), "on": start(n + STATE + 1, 4 * STATE), "back": start(n + STATE + 1, 4 * STATE), "out": start(2 * STATE + n, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        for side in ("on", "back"):
            self.p[side][-1] = 0
            self.p[side][-1, STATE : 2 * STATE] = 1  # remember at first

    def _flat(self, vectors: np.ndarray, words: np.ndarray, shapes: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is read of each block, how many pages each step has, and where each block stands in (step, page), forwards and backwards. Pages come longest first."""
        page, step = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])
        back = np.repeat(sizes, sizes) - 1 - step
        return np.concatenate([vectors, words, shapes], 1), np.bincount(step), step * len(sizes) + page, back * len(sizes) + page

    def _laid(self, flat: np.ndarray, at: np.ndarray, steps: int, width: int) -> np.ndarray:
        x = np.zeros((steps * width, flat.shape[1]), np.float32)
        x[at] = flat
        return x.reshape(steps, width, -1)

    def logits(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """One number a block, above 0 for article text."""
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
        out = [np.zeros(0, np.float32)] * len(pages)
        while order:
            width = max(1, min(TOGETHER, len(order), NUMBERS // (len(pages[order[0]]) * (STATE + PATH))))
            some, order = order[:width], order[width:]
            sizes = [len(pages[i]) for i in some]
            read = [b for i in some for b in pages[i]]
            elements: dict[int, Element] = {id(b.element): b.element for b in read}
            number = {k: j for j, k in enumerate(elements)}
            vectors = Rows([e.path for e in elements.values()]).of(self.p["path"])[[number[id(b.element)] for b in read]]
            flat, alive, *at = self._flat(vectors, self._word_vectors(read), np.concatenate([shape(pages[i]) for i in some]), sizes)
            result = flat @ self.p["out"][2 * STATE :] + self.p["bias"]
            for k, side in enumerate(("on", "back")):
                h = _steps(self._laid(flat, at[k], sizes[0], width), self.p[side], alive).reshape(-1, STATE)[at[k]]
                result = result + h @ self.p["out"][k * STATE : (k + 1) * STATE]
            for i, r in zip(some, np.split(result, np.cumsum(sizes)[:-1])):
                out[i] = r
        return out

    def _word_vectors(self, page: list[Block]) -> np.ndarray:
        return np.concatenate([Rows([word_bag(b.text) for b in page[i : i + 512]]).of(self.p["words"]) for i in range(0, len(page), 512)])

    def fit(self, pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS, rate: float = 0.01) -> None:
        """Adam over the cross entropy of all blocks."""
        rng = np.random.default_rng(SEED)
        ready = [([b.element.path for b in p], [word_bag(b.text) for b in p], shape(p), np.array(y, np.float32)) for p, y in pages if p]
        first, second, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        steps = rounds * -(-len(ready) // AT_ONCE)
        for _ in range(rounds):
            # pages of about one length are read together
            dealt = np.argsort([len(r[0]) * rng.uniform(0.7, 1.4) for r in ready])
            for lo in rng.permutation(np.arange(0, len(dealt), AT_ONCE)):
                some = sorted((ready[i] for i in dealt[lo : lo + AT_ONCE]), key=lambda r: -len(r[0]))
                t += 1
                now = rate * min(1, t / 10) * (1 - 0.9 * t / steps)
                for k, g in self._gradients(some, rng).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, some: list, rng: np.random.Generator) -> dict[str, np.ndarray]:
        sizes = [len(r[0]) for r in some]
        paths, words = Rows([b for r in some for b in r[0]]), Rows([b for r in some for b in r[1]])
        words.weight *= (rng.random(words.n) >= SILENT)[words.row]
        y = np.concatenate([r[3] for r in some])
        flat, alive, on, back = self._flat(paths.of(self.p["path"]), words.of(self.p["words"]), np.concatenate([r[2] for r in some]), sizes)
        steps, width, w_out = sizes[0], len(some), self.p["out"]
        sides, parts = [], []
        for side, at in (("on", on), ("back", back)):
            x, kept = self._laid(flat, at, steps, width), []
            h = _steps(x, self.p[side], alive, kept)
            parts.append(h.reshape(-1, STATE)[at])
            sides.append((side, at, x, kept))
        seen = np.concatenate([*parts, flat], 1)
        d = ((_sigmoid(seen @ w_out + self.p["bias"]) - y) / len(y)).astype(np.float32)
        grads = {"out": seen.T @ d, "bias": d.sum(keepdims=True)}
        d_flat = d[:, None] * w_out[2 * STATE :]
        for k, (side, at, x, kept) in enumerate(sides):
            d_h = self._laid(d[:, None] * w_out[k * STATE : (k + 1) * STATE], at, steps, width)
            grads[side], d_x = _steps_back(x, self.p[side], alive, kept, d_h)
            d_flat = d_flat + d_x.reshape(-1, flat.shape[1])[at]
        grads["path"], grads["words"] = paths.back(self.p["path"], d_flat[:, :PATH]), words.back(self.p["words"], d_flat[:, PATH : PATH + WORDS]) + FADE * self.p["words"]
        return grads


class Layouts:
    """Pages put together at random from given texts, with the label of each block."""

    def __init__(self, texts: list[str], seed: int = SEED):
        self.rng, self.texts = random.Random(seed), texts or ["A text of some words.", "And another one, a little longer than the first."]

    def _text(self, most: int) -> str:
        words = self.rng.choice(self.texts).split()
        n = self.rng.randint(1, most)
        i = self.rng.randrange(max(1, len(words) - n + 1))
        return " ".join(words[i : i + n]) or "word"

    def _open(self, parent: Element, kind: str | None, tags: list[str], main: bool = False) -> Element:
        """An element named for what it holds; now and then its name says nothing."""
        r, names = self.rng, []
        if kind and r.random() < (0.75 if main else 0.93):
            names = r.sample(MAIN if main else OTHER[kind], r.choice((1, 1, 1, 2)))
            names += r.sample(("container", "wrap", "inner", "block", "section", "list", "item", "area", "wrapper", "x", "c"), r.choice((0, 0, 0, 1)))
        elif r.random() < 0.3:
            names = r.sample(("container", "wrap", "inner", "row", "col", "grid", "x", "c"), 1)
        return Element(r.choice(tags), names, parent)

    def _other(self, kind: str, parent: Element) -> list[tuple[Block, bool]]:
        r = self.rng
        tags = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div", "section"], "aside": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ul", "ol", "article"]}.get(kind, ["div", "div", "section", "p", "aside"])
        box, out = self._open(parent, kind, tags), []
        if box.tag not in SELF_EVIDENT and set(box.names).isdisjoint(OTHER[kind]):
            box = Element(box.tag, [*box.names, r.choice(OTHER[kind])], parent)
        if r.random() < 0.3:
            box = Element("div", r.sample(("container", "inner", "wrap"), 1) * r.randint(0, 1), box)
        n = {"nav": r.randint(2, 12), "footer": r.randint(1, 6), "aside": r.randint(1, 8), "comments": r.randint(1, 12), "form": r.randint(1, 5)}.get(kind, r.randint(1, 3))
        inner = {"nav": ["li", "li", "div"], "aside": ["li", "p", "div", "h3"], "footer": ["p", "li", "div", None], "form": ["label", "button", "p", "option"], "comments": ["p", "p", "div", "li", "article"], "notice": ["p", "div", "button", None], "ad": [None, "p", "div"], "header": ["h1", "div", "p", None, "h2"], "share": ["li", "div", None, "p"]}[kind]
        tag = r.choice(inner)
        for k in range(n):
            if kind == "form":
                tag = r.choice(inner)
            e = Element(tag, r.sample(OTHER[kind], 1) if kind == "comments" and tag != "p" and r.random() < 0.4 else [], box) if tag else box
            if kind == "comments" and tag in ("article", "li", "div") and (tag == "article" or r.random() < 0.5):
                e = Element("p", [], e)
            if k == 0 and kind in ("aside", "comments", "form") and r.random() < 0.5:
                e = Element(r.choice(("h2", "h3", "h4")), [], box)
            text = self._text(40 if kind in ("comments", "notice", "ad") else 12 if kind != "nav" else 3)
            linked = len(text) if kind == "nav" or (kind in ("aside", "footer", "share") and r.random() < 0.6) else 0
            out.append((Block(text, e, linked), False))
        return out

    def page(self) -> tuple[list[Block], list[bool]]:
        r = self.rng
        body: Element = Element("html", [], None)
        if r.random() < 0.8:
            body = Element("body", [], body)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = Element("div", r.sample(("page", "wrapper", "site", "container", "layout", "root"), r.randint(0, 1)), body)
        out: list[tuple[Block, bool]] = []
        bare = r.random() < BARE
        for kind in [] if bare else r.sample(("nav", "header", "notice", "ad", "form", "aside"), r.randint(0, 4)):
            out += self._other(kind, body)
        outer = body
        if r.random() < 0.3:
            outer = self._open(body, "main", ["main", "div", "section"], True)
        main = self._open(outer, "main", ["article", "article", "article", "main", "div", "div", "section"], True)
        if main.tag in ("div", "section") and outer.tag != "main" and set(main.names).isdisjoint(MAIN):
            main = Element(main.tag, [r.choice(MAIN)], outer)
        n, same = r.choice((0, 1, 2, 3, 5, 8, 12, 20)), self._text(5) if r.random() < 0.15 else None
        if r.random() < LONG:
            n = r.randint(30, 250)
        usual = r.choice(("p", "p", "p", "li", "div"))
        inside = r.sample(("ad", "share", "aside", "form", "notice", "nav"), r.choice((0, 0, 1, 2)))
        if r.random() < 0.7 or not n:
            out.append((Block(self._text(10), Element("h1", [], main if r.random() < 0.8 else Element("header", [], main)), 0), True))
        for k in range(n):
            tag = r.choice((usual,) * (12 if n < 30 else 120) + ("h2", "h3", "li", "blockquote", "pre", "td", "figcaption", "div", None))
            e = main if tag is None else Element(tag, [], Element("ul", [], main) if tag == "li" else main)
            if tag == "blockquote" and r.random() < 0.5:
                e = Element("p", [], e)
            text = same if same and r.random() < 0.9 else self._text(r.choice((1, 4, 12, 60, 150)))
            out.append((Block(text, e, r.choice((0, 0, 0, 0, len(text) // 3, len(text)))), True))
            if inside and r.random() < 2 / (n + 2):
                out += self._other(inside.pop(), main)
        for kind in inside:
            out += self._other(kind, main)
        if r.random() < 0.4:
            out += self._other("comments", r.choice((main, outer, body)))
        for kind in [] if bare else r.sample(("aside", "footer", "ad", "share", "notice", "form", "nav", "footer"), r.randint(0, 4)):
            out += self._other(kind, body)
        return [b for b, _ in out], [y for _, y in out]


def fit(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> BlockLabeller:
    """Fit on at most FIT_PAGES different pages that mark their article, and on FIT_LAYOUTS layouts of the same texts.

    Pages are drawn by a hash, about three times FIT_PAGES of all there are, so that no more than these are sorted; equal ones count once.
    """
    draw = F.pmod(F.xxhash64(url_col, html_col), F.lit(1 << 30))
    some = pages.where(F.col(html_col).isNotNull() & (F.octet_length(html_col) <= FIT_BYTES)).select(draw.alias("draw"), F.col(html_col).alias("page"))
    drawn = some.where(F.col("draw") * F.lit(pages.count()) < F.lit(3 * FIT_PAGES << 30)).groupBy("draw").agg(F.min("page").alias("page"))
    read = [blocks(r.page) for r in drawn.orderBy("draw").limit(FIT_PAGES).collect()]
    named = [(p, y) for p in read if p and (y := labels_of(p))]
    layouts = Layouts([b.text for p in read for b in p])
    model = BlockLabeller()
    model.fit(named + [layouts.page() for _ in range(FIT_LAYOUTS)])
    return model


def main_text(pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text and n_chars (code points).

    The leaf blocks (:func:`blocks`) that the network labels as article, in page order, joined by a line feed. Whole
    pages are read; a null, empty or textless html has an empty text. Null identifiers and urls are
    kept, repeated rows give one row each, other columns are not read, and an empty table gives an empty result.
    """
    shared = broadcast(pages, model)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                read = [blocks(p or "") for p in part.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, x in zip(p, z) if x > 0) for p, z in zip(read, shared.value.logits(read))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
