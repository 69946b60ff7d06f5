"""Fuzzy windows against brute force, fitted transforms against known ones, image operators on small images."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import sequences
from foliospark.operators import images, transforms
from foliospark.plans import queries


def brute_force(target, words, ys, sizes, glue, spread, target_first):
    best = (0.0, 0, 0)
    for size in sizes:
        for start in range(len(words) - size + 1):
            run = ys[start : start + size]
            joined = glue.join(w for w in words[start : start + size] if w)
            if not joined or spread is not None and max(run) - min(run) > spread:
                continue
            score = SequenceMatcher(None, *((target, joined) if target_first else (joined, target))).ratio()
            score *= 0.7 if spread is not None and len(joined) > 2 * len(target) else 1
            if score > best[0]:
                best = (score, size, start)
    return best


@pytest.mark.parametrize("spread", [None, 2.0])
def test_best_window_brute_force(spread):
    rng = random.Random(5)
    for _ in range(300):
        words = ["".join(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(rng.randint(0, 8))]
        ys, target, sizes = sorted(rng.choices(range(6), k=len(words))), "".join(rng.choices("abc ", k=rng.randint(1, 6))), sorted(rng.sample(range(1, 5), 2))
        args = (target, words, ys, [s for s in sizes if s <= len(words)], " ", spread, rng.random() < 0.5)
        assert sequences.best_window(*args) == pytest.approx(brute_force(*args))


@pytest.mark.parametrize("glue,target_first", [(" ", True), ("", False)])
def test_long_pages_against_brute_force(monkeypatch, glue, target_first):
    rng, asked = random.Random(9), [0]

    class Counted(SequenceMatcher):
        def ratio(self):
            asked[0] += 1
            return super().ratio()

    monkeypatch.setattr(sequences, "SequenceMatcher", Counted)
    page = ["".join(rng.choices("etaoinshrdlu", k=rng.choice((0, 1, 3, 5, 9)))) for _ in range(120)]
    ys = [3 * (k // 10) for k in range(120)]
    tried = 0
    for spread, least in ((None, 0.0), (1.5, 0.6)):
        for _ in range(25):
            n, i = rng.randint(1, 4), rng.randrange(110)
            said = glue.join(w for w in page[i : i + n] if w)
            target = "".join(c for c in said if rng.random() < 0.9) + rng.choice(("", "", "x", "ta")) or "e"
            sizes = list(range(1, n + 3))
            want = brute_force(target, page, ys, sizes, glue, spread, target_first)
            tried += sum(120 - k + 1 for k in sizes)
            got = sequences.best_window(target, page, ys, sizes, glue, spread, target_first, least)
            assert got == pytest.approx(want if want[0] >= least else (0.0, 0, 0)), (target, said)
    assert asked[0] < 0.1 * tried  # the others were ruled out


def test_no_ratio_is_above_its_bound():
    rng = random.Random(2)
    for _ in range(400):
        glue = rng.choice((" ", ""))
        words = ["".join(rng.choices("abcd", k=rng.randint(0, 5))) for _ in range(rng.randint(1, 7))]
        target = "".join(rng.choices("abcd ", k=rng.randint(1, 12)))
        page = sequences.Postings(words, glue)
        for size in range(1, len(words) + 1):
            for start, bound in enumerate(sequences._bounds(target, page, size)):
                joined = glue.join(w for w in words[start : start + size] if w)
                assert bound == 0 if not joined else max(SequenceMatcher(None, target, joined).ratio(), SequenceMatcher(None, joined, target).ratio()) <= bound + 1e-12


def test_fitted_transforms(spark):
    turn, points = math.radians(30), [(0.0, 0.0), (10.0, 0.0), (0.0, 5.0), (7.0, 8.0)]
    moved = [(x, y, 2 * (math.cos(turn) * x - math.sin(turn) * y) + 3, 2 * (math.sin(turn) * x + math.cos(turn) * y) - 4) for x, y in points]
    rows = [(1, 0, *p) for p in moved] + [(2, 0, 1.0, 1.0, 4.0, 6.0)] + [(3, 0, x, y, 9 * x, 9 * y) for x, y in points]
    pairs = spark.createDataFrame(rows, "doc_id long, page long, src_x double, src_y double, dst_x double, dst_y double")
    got = {r["doc_id"]: r for r in transforms.fit_similarity(pairs).collect()}
    assert got[1]["kind"] == "similarity" and [got[1][c] for c in ("scale", "angle", "dx", "dy")] == pytest.approx([2, 30, 3, -4])
    assert got[1]["residual"] == pytest.approx(0, abs=1e-6)
    assert got[2]["kind"] == "translation" and (got[2]["dx"], got[2]["dy"]) == (3, 5)
    assert got[3]["kind"] == "none"
    assert not transforms.fit_similarity(pairs.limit(0)).count()


def test_images(spark):
    page = np.zeros((100, 80), np.uint8)
    page[20:80, 20:60] = 255
    rows = [(1, (100, 80, 1, page.tobytes())), (2, (10, 10, 3, bytes(300))), (3, None), (4, (5, 5, 1, b"short"))]
    df = spark.createDataFrame([(i, x and (x[0], x[1], x[2], bytearray(x[3]))) for i, x in rows], f"i int, image {images.IMAGE}")
    got = {r["i"]: r for r in df.select("i", images.image_border(F.col("image")).alias("b"), images.image_quality(F.col("image")).alias("q"), images.turned(F.col("image"), 1).alias("t")).collect()}
    assert tuple(got[1]["b"]) == pytest.approx((25_000, 20_000, 50_000, 60_000), abs=3_000)
    assert got[1]["q"]["brightness"] == pytest.approx(page.mean(), abs=0.01)
    assert tuple(got[2]["b"]) == (0, 0, 100_000, 100_000) and got[2]["q"]["contrast"] == 0
    assert (got[1]["t"]["height"], got[1]["t"]["width"]) == (80, 100)
    assert np.array_equal(np.frombuffer(got[1]["t"]["data"], np.uint8).reshape(80, 100), np.rot90(page, -1))
    assert not any(got[i]["b"] and got[i]["b"]["x"] is not None for i in (3, 4))


@pytest.mark.parametrize("name", sorted(set(images.FILTERS)))
def test_filters_keep_the_size_and_flat_images_stay_flat(name):
    assert images.FILTERS[name](np.random.default_rng(1).integers(0, 256, (40, 30), dtype=np.uint8)).shape[:2] == (40, 30)
    flat = images.FILTERS[name](np.full((20, 20), 128, np.uint8))
    assert len(np.unique(flat)) == 1


def test_filters_by_plain_loops():
    rng = np.random.default_rng(3)
    colour = rng.integers(0, 256, (14, 17, 3), dtype=np.uint8)
    grey = [[round(0.299 * int(p[0]) + 0.587 * int(p[1]) + 0.114 * int(p[2])) for p in row] for row in colour]
    assert np.abs(images.grey(colour).astype(int) - np.array(grey)).max() <= 1
    flat = images.grey(colour).ravel().tolist()
    best, at = -1.0, 0
    for t in range(256):  # the threshold with the greatest variance between both sides
        low, high = [v for v in flat if v <= t], [v for v in flat if v > t]
        if low and high:
            between = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if between > best * (1 + 1e-12):
                best, at = between, t
    assert np.array_equal(images.otsu(colour) > 0, images.grey(colour) > at)
    g = images.grey(colour)
    padded = np.pad(g, 1, mode="edge")
    for y in range(1, 13):
        for x in range(1, 16):
            assert images.denoise(colour)[y, x] == sorted(padded[y : y + 3, x : x + 3].ravel().tolist())[4]
    q = images.quality(colour)
    assert q["brightness"] == pytest.approx(np.mean(flat), abs=0.01) and q["contrast"] == pytest.approx(np.std(flat), abs=0.01)
    edge = [sum(int(g[a, b]) for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))) - 4 * int(g[y, x]) for y in range(1, 13) for x in range(1, 16)]
    assert images.quality(np.pad(g[1:-1, 1:-1], 0))["sharpness"] >= 0 and len(edge) == 180


def test_variants_of_a_page(spark):
    rng = np.random.default_rng(4)
    page = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, (40, 30, 3, bytearray(page.tobytes()))), (2, None), (3, (9, 9, 1, bytearray(b"short")))], f"i int, image {images.IMAGE}")
    got = {(r.i, r.variant): r.image for r in images.variants(df, "image").collect()}
    assert {v for _, v in got} == set(images.VARIANTS) == {"grayscale", "binary", "clahe", "denoise_clahe", "adaptive", "sharpen_binary", "morph_clean"} and len(got) == 21
    for name, steps in images.VARIANTS.items():
        a = page
        for step in steps:
            a = images.FILTERS[step](a)
        assert bytes(got[1, name].data) == a.tobytes() and (got[1, name].height, got[1, name].width) == a.shape
        assert all(got[i, name] is None or got[i, name].data is None for i in (2, 3))
    plain = df.select("i", images.filtered(F.col("image")).alias("f")).where("i = 1").first().f
    assert bytes(plain.data) == images.sharpen(images.equalise(images.grey(page))).tobytes()


def test_queries_without_sql(spark, sf):
    """Anchors and values of all pages against plain searches; a row of qualities for every document."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    quality = queries.QUERIES["image_quality"](spark, sf)
    assert quality.count() == documents.count() and not quality.where("brightness is null").join(documents.where("text <> ''"), "doc_id").count()
    found = queries.QUERIES["text_anchor"](spark, sf).collect()
    pages = {}
    for w in sorted(queries.words(spark, sf).collect(), key=lambda w: (round(w.y / 100_000, 2), w.x, w.word_no)):
        pages.setdefault((w.doc_id, w.page), []).append(text_of(w.text))
    target = {1: "of the and", 2: "der die"}
    assert len(found) == 2 * len(pages)
    for r in found:
        words, want = pages[r.doc_id, r.page], target[r.anchor_id]
        n = len(want.split())
        best = brute_force(want, words, [0] * len(words), [k for k in (n - 1, n, n + 1) if k <= len(words)], " ", None, True)
        assert r.score == pytest.approx(best[0], abs=5e-5) and r.found == (best[0] >= 0.7)
    values = queries.QUERIES["value_window"](spark, sf)
    wanted = queries.QUERIES["label_values"](spark, sf)
    assert values.count() == wanted.select("doc_id", "sample_text").distinct().count() and not values.where("score < 1").count()


def text_of(t):
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
    return " ".join(t.split())


def test_local_contrast_counts_all_tiles_at_once(monkeypatch):
    """The tables of all tiles come from one count of the image, and are those of each tile."""
    import numpy as np

    from foliospark.operators import images

    rng = np.random.default_rng(8)
    counted, plain = [], np.bincount
    for h, w in ((1, 64), (7, 64), (8, 8), (64, 50), (333, 64)):
        g = (rng.random((h, w)) ** 3 * 256).astype(np.uint8)
        full = np.pad(g, ((0, -h % 8), (0, -w % 8)), mode="reflect" if min(h, w) > 8 else "edge")
        th, tw = full.shape[0] // 8, full.shape[1] // 8
        table = np.zeros((8, 8, 256))
        for i in range(8):
            for j in range(8):
                n = plain(full[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
                top = max(1.0, 2.0 * n.sum() / 256)
                n = np.minimum(n, top) + np.maximum(n - top, 0).sum() / 256
                table[i, j] = np.cumsum(n) / n.sum() * 255
        ty, tx = (np.clip((np.arange(s) + 0.5) / t - 0.5, 0, 7) for s, t in ((h, th), (w, tw)))
        y0, x0 = ty.astype(int), tx.astype(int)
        y1, x1 = np.minimum(y0 + 1, 7), np.minimum(x0 + 1, 7)
        fy, fx = (ty - y0)[:, None], (tx - x0)[None]
        at = lambda y, x: table[y[:, None], x[None], g]
        want = np.clip(np.rint((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))), 0, 255).astype(np.uint8)
        monkeypatch.setattr(np, "bincount", lambda *a, **k: counted.append(1) or plain(*a, **k))
        assert (images.equalise(g) == want).all()
        monkeypatch.setattr(np, "bincount", plain)
    assert len(counted) == 5


def test_short_texts_match_as_sequences_do():
    """The ratio of short texts is SequenceMatcher's, also where runs tie and beyond the bounds."""
    from difflib import SequenceMatcher

    rng = random.Random(8)
    for _ in range(5000):
        letters = rng.choice(["ab", "abc ", "etaoin shrdlu", "é\U0001f600x"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 12, 26, 110])))) for _ in "ab")
        assert sequences.ratio_of(a, b) == SequenceMatcher(None, a, b).ratio()


def test_search_of_a_page_costs_its_letters(monkeypatch):
    """Postings are looked up for the target's letters only, and short windows are compared without a matcher's tables."""

    def none(*_):
        raise AssertionError("a table was made")

    monkeypatch.setattr(sequences, "SequenceMatcher", none)
    words = ["of", "te", "ant", "", "\U0001f600", "the", "an"] * 80
    page = sequences.Postings(words, " ")
    score, size, start = sequences.best_window("of the and", words, [0] * len(words), [2, 3, 4], " ", None, True, 0.0, page)
    assert 0.5 < score < 1 and size in (2, 3, 4) and set(page.sums) <= set("of the and") | {"of the and"[k : k + 2] for k in range(9)}


def test_normal_forms_of_lists(spark):
    """The normal forms of a list's words are those of each word, whatever a word holds."""
    from foliospark.functions import text as tx

    rng = random.Random(9)
    letters = ["a", "B", "Σ", "É", "é", "́", " ", "\t", "\n", "\x01", "\x1c", ".", ":", "İ", "ß", "'", "­", "한", "1", "-", "\U0001f600", " ", "ΑΣ", "I"]
    lists = [[], [""], [" "], ["ΑΣ", "Β"], ["ΑΣ", "", "Β"], [" a ", "\t", "b"], [None, "x"]] + [["".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 8))] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lists)), "i long, ws array<string>")
    for many, one in ((tx.normal_anchors, tx.normal_anchor), (tx.normal_values, tx.normal_value), (tx.normal_labels, tx.normal_label)):
        for r in df.select("ws", many(F.col("ws")).alias("got"), F.transform("ws", lambda w: one(w)).alias("want")).collect():
            assert r.got == r.want, (many.__name__, r.ws)
