"""Codes and clusters of integer vectors against plain loops: ties, huge components, repeated rows, odd rows and hot groups."""

import hashlib
import math
import random

import numpy as np
import pytest

from foliospark.llm import clustering, vector_codes as codes_module
from foliospark.llm.clustering import KdTree, cluster_vectors
from foliospark.llm.integer_vectors import Sums
from foliospark.llm.vector_codes import nearest, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, v int, code string, n int, entry int, cluster int"


def frame(spark, rows):
    """Vectors with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3, 4) for i, v, label in rows], VECTORS).repartition(3)


def some_rows(seed, n=300, width=64, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, scale), 1) for _ in range(width)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(i, list(rows[7][1]), 1) for i in range(n, n + 60)]  # copies
    rows += [(5, list(rows[9][1]), 2), (5, list(rows[5][1]), None), (None, list(rows[11][1]), 2)]  # repeated and null identifiers
    return rows


BAD = [(-1, None, 0), (-2, [], 0), (-3, [0.5] * 63 + [None], 0), (-4, [0.5] * 63 + [math.nan], 1), (-5, [0.5] * 63 + [math.inf], 1), (-6, [1e300] + [0.5] * 63, 1), (-7, [0.5] * 17, 1)]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def whole(v):
    return [math.floor(256 * x) for x in v]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def rounds_of(points, entries, rounds):
    """Plain rounds of assigning and replacing: final entries, and the nearest of each point."""
    def assign():
        return [min(range(len(entries)), key=lambda k: (far(p, entries[k]), k)) for p in points]

    for _ in range(rounds):
        near = assign()
        for k in set(near):
            mine = [p for p, c in zip(points, near) if c == k]
            entries[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return entries, assign()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = by_id([(i, whole(v), label) for i, v, label in rows])
    width = len(rows[0][1]) // parts
    books, code, error = [], [""] * len(rows), [0] * len(rows)
    for p in range(parts):
        points = [r[1][p * width : (p + 1) * width] for r in rows]
        book, near = rounds_of(points, points[:entries], rounds)
        books += book
        code = [c + f"{k:02x}" for c, k in zip(code, near)]
        error = [e + far(x, book[k]) for e, x, k in zip(error, points, near)]
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b).encode()).hexdigest()
    total = {label: sum(e for e, r in zip(error, rows) if r[2] == label) for label in {r[2] for r in rows}}
    return [(r[0], c, e, total[r[2]], sha) for r, c, e in zip(rows, code, error)]


def plain_clusters(rows, k=40, rounds=5):
    rows = [(i, whole(v)) for i, v, _ in rows]
    name = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    first = sorted(rows, key=lambda r: (r[0] is None, "" if r[0] is None else name(r[0]), r[1]))[:k]
    centres, near = rounds_of([v for _, v in rows], [v for _, v in first], rounds)
    error = [far(v, centres[c]) for (_, v), c in zip(rows, near)]
    inertia = {c: sum(e for e, n in zip(error, near) if n == c) for c in near}
    return [(i, c, e, inertia[c], sum(error), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), c, e in zip(rows, near, error)]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 50)])
def test_codes_equal_plain_loops(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(codes_module, "HOT_ROWS", hot)
    rows = some_rows(seed)
    assert got(vector_codes(frame(spark, rows + BAD))[0], *CODES) == sorted(plain_codes(rows), key=str)


def test_codes_of_few_and_long_and_huge_vectors(spark):
    few = [(3, [0.1 * k for k in range(32)], None), (1, [-0.1 * k for k in range(32)], None)]
    assert got(vector_codes(frame(spark, few + [(9, [0.1] * 64, 1)]))[0], *CODES) == sorted(plain_codes(few), key=str)
    huge = [(i, [1e7 * (-1) ** (i * k) + i + k for k in range(16)], i % 2) for i in range(70)]
    assert got(vector_codes(frame(spark, huge))[0], *CODES) == sorted(plain_codes(huge), key=str)
    beyond = [(i, [(-1) ** i * 2.0**43] * 16, 0) for i in range(3)] + [(i, [i * 2.0**37] * 16, 0) for i in range(3, 90)]
    out = {r.vec_id: r for r in vector_codes(frame(spark, beyond))[0].collect()}
    assert len(out) == 90 and out[0].label_error is None  # the sum leaves 64 bits


def test_no_vectors(spark):
    for rows in ([], BAD[:6]):
        assert vector_codes(frame(spark, rows))[0].count() == 0
        assert cluster_vectors(frame(spark, rows)).count() == 0


@pytest.mark.parametrize("big", [1, 1 << 40])
def test_nearest_is_the_lowest_of_the_nearest(big):
    rng = np.random.default_rng(5)
    for width in (1, 4):
        x, book = rng.integers(-3, 4, (200, width)) * big, rng.integers(-3, 4, (64, width)) * big
        entry, least = nearest(x, book)
        all_far = ((x[:, None].astype(object) - book[None]) ** 2).sum(2)
        assert entry.tolist() == [int(min(range(64), key=lambda k: (f[k], k))) for f in all_far]
        assert [int(v) for v in least] == [min(f) for f in all_far.tolist()]


@pytest.mark.parametrize("tree,leaf", [(1024, 16), (50, 3)])
def test_clusters_equal_plain_loops(spark, monkeypatch, tree, leaf):
    monkeypatch.setattr(clustering, "TREE", tree)
    monkeypatch.setattr(clustering, "LEAF", leaf)
    rows = some_rows(tree, scale=0.2) + [(1000 + i, [0.1 * (i % 3)] * 64, 0) for i in range(30)]
    assert got(cluster_vectors(frame(spark, rows + BAD)), *CLUSTERS) == sorted(plain_clusters(rows), key=str)


def test_clusters_of_few_vectors(spark):
    rows = [(i, [float(i % 3)] * 64, None) for i in range(5)]
    assert got(cluster_vectors(frame(spark, rows)), *CLUSTERS) == sorted(plain_clusters(rows), key=str)


def test_trees_assign_whole_nodes_and_lose_nothing():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-5, 5, (150, 64)) + 1000 * k for k in range(4)] + [np.full((100, 64), 7)])
    tree, centroids = KdTree.build(points), np.concatenate([np.array([[1000 * k] * 64 for k in range(4)]), np.full((1, 64), 500), np.full((1, 64), 500)])
    node, at, _ = tree.assign(centroids)
    assert sum(tree.last[n] - tree.first[n] for n, _ in node) + len(at) == len(points) and len(at) < 60  # most are assigned whole
    sums = Sums(1, 6, 64)
    tree.add_to(sums, centroids)
    near = ((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
    assert sums.n[0].tolist() == np.bincount(near, minlength=6).tolist()
    assert all((sums.total[0, k] == points[near == k].sum(0)).all() for k in range(6))


@pytest.mark.parametrize("big", [1, 1 << 30, 1 << 50])
def test_trees_are_exact_for_integers_of_any_size(big):
    rng = np.random.default_rng(1)
    points = rng.integers(-4, 5, (300, 64)) * big + rng.integers(0, 2, (300, 64))
    centroids = points[rng.choice(300, 40, replace=False)].copy()
    centroids[7] = centroids[3]
    tree = KdTree.build(points)
    cluster, least = tree.clusters(centroids)
    all_far = ((tree.points.astype(object)[:, None] - centroids.astype(object)[None]) ** 2).sum(2).tolist()
    assert cluster.tolist() == [min(range(40), key=lambda k: (row[k], k)) for row in all_far]
    assert [int(x) for x in least] == [min(row) for row in all_far]
