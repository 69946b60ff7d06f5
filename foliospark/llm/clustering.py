"""Centroids of integer vectors, found by filtering kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, materialize
from .integer_vectors import SUMS, Sums, as_long, exact, integer_vectors, matrix, means

COMPONENTS, CENTROIDS, ROUNDS = 64, 40, 5
#: Vectors in a tree, and in a leaf.
TREE, LEAF = 1024, 16
#: Bytes of a row group of trees: readers hold a row group's trees at a time.
ROW_GROUP = 16 << 20
BLOCKS = "vec_ids array<long>, points binary, first array<int>, last array<int>, child array<int>, low binary, high binary, total binary"


def _narrow(a: np.ndarray) -> bytes:
    """Integers in as few bytes as hold the largest; the first byte tells how many."""
    most = int(np.abs(a).max()) if a.size else 0
    kind = next(k for k in ("i2", "i4", "i8") if most < 1 << (8 * int(k[1]) - 1))
    return kind[1].encode() + a.astype("<" + kind).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).astype(np.int64).reshape(-1, width)


class KdTree:
    """A kd-tree over integer vectors. Each node has a range of points, the sums of their components and their box.

    A node is split at the median of its widest dimension; one with at most LEAF points, or with equal ones, is a leaf. ``child`` is the
    first of a node's two children, which follow one another, and 0 for leaves.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, first, last, child, low, high, total):
        self.points, self.order = points, order
        self.first, self.last, self.child, self.low, self.high, self.total = first, last, child, low, high, total

    @classmethod
    def build(cls, points: np.ndarray) -> KdTree:
        order, first, last, child, low, high, total = np.arange(len(points)), [0], [len(points)], [0], [], [], []
        at = 0
        while at < len(first):
            a, b = first[at], last[at]
            some = points[order[a:b]]
            low.append(some.min(0))
            high.append(some.max(0))
            total.append(some.sum(0))
            wide = high[at] - low[at]
            if b - a > LEAF and wide.any():
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(some[:, wide.argmax()], middle)]
                child[at] = len(first)
                first += [a, a + middle]
                last += [a + middle, b]
                child += [0, 0]
            at += 1
        return cls(points[order], order, *(np.array(x, np.int64) for x in (first, last, child, low, high, total)))

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(node, centroid) of nodes that are assigned whole, and the points left, with their centroids.

        From the root down, each node keeps the centroids that can be nearest to a point of its box. The
        one nearest to the middle of the box, z, rules another one out if that is strictly farther than z even at
        the corner of the box most in its favour; one that is as near anywhere stays. A node with a single centroid left is assigned whole;
        points of leaves with several are compared with all of these. All steps of a level are products of arrays of integers.
        """
        c, low, high, points = exact(centroids, self.low, self.high, self.points)
        square = (c**2).sum(1)
        whole, left, choice = [], [], []
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(nodes):
            lo, hi = low[nodes], high[nodes]
            middle = 4 * square[None] - 4 * ((lo + hi) @ c.T)  # four times the squared distance to the middle, less a constant
            z = np.where(may, middle, np.inf).argmin(1)
            u = c[None] - c[z][:, None]
            farther = square[None] - square[z][:, None] - 2 * ((np.maximum(u, 0) * hi[:, None] + np.minimum(u, 0) * lo[:, None]).sum(2))
            may &= ~(farther > 0).astype(bool)
            single = may.sum(1) == 1
            whole += zip(nodes[single].tolist(), may[single].argmax(1).tolist())
            leaf = ~single & (self.child[nodes] == 0)
            if leaf.any():
                counts = (self.last - self.first)[nodes[leaf]]
                at = np.concatenate([np.arange(self.first[i], self.last[i]) for i in nodes[leaf]])
                far = square[None] - 2 * (points[at] @ c.T)
                left.append(at)
                choice.append(np.where(np.repeat(may[leaf], counts, axis=0), far, np.inf).argmin(1))
            inner = ~single & ~leaf
            nodes = np.concatenate([self.child[nodes[inner]], self.child[nodes[inner]] + 1])
            may = np.concatenate([may[inner], may[inner]])
        none = np.zeros(0, np.int64)
        return whole, np.concatenate([none, *left]), np.concatenate([none, *choice])

    def add_to(self, sums: Sums, centroids: np.ndarray) -> None:
        """Add all points to the sums of their centroids; nodes assigned whole by their own count and sums."""
        whole, at, choice = self.assign(centroids)
        for node, z in whole:
            sums.n[0, z] += self.last[node] - self.first[node]
            sums.total[0, z] += self.total[node]
        sums.add(0, choice, self.points[at])

    def clusters(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each point, in the order of ``points``, and the squared distance to it."""
        whole, at, choice = self.assign(centroids)
        cluster = np.zeros(len(self.points), np.int64)
        cluster[at] = choice
        for node, z in whole:
            cluster[self.first[node] : self.last[node]] = z
        points, c = exact(self.points, centroids)
        return cluster, ((points - c[cluster]) ** 2).sum(1)


def _trees(rows: DataFrame) -> DataFrame:
    """Rows of BLOCKS: a tree for each TREE vectors of a partition, written once and read in each round."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, TREE - n)
                held.append(some)
                n, batch = n + some.num_rows, batch.slice(some.num_rows)
                if n == TREE:
                    yield _block(held)
                    held, n = [], 0
        if n:
            yield _block(held)

    return rows.select("vec_id", "v").mapInArrow(built, BLOCKS)


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids = pa.concat_arrays([b.column(0) for b in held])
    tree = KdTree.build(np.concatenate([matrix(b.column(1)) for b in held]))
    cells = [ids.take(pa.array(tree.order)).to_pylist(), _narrow(tree.points), *(x.tolist() for x in (tree.first, tree.last, tree.child)), *(_narrow(x) for x in (tree.low, tree.high, tree.total))]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [longs, pa.binary(), ints, ints, ints, pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[list, KdTree]]:
    for r in batch.to_pylist():
        first, last, child = (np.array(r[k], np.int64) for k in ("first", "last", "child"))
        yield r["vec_ids"], KdTree(_wide(r["points"], COMPONENTS), None, first, last, child, *(_wide(r[k], COMPONENTS) for k in ("low", "high", "total")))


def starting_centroids(rows: DataFrame) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``2:<vec_id>``, in that order; null identifiers come last."""
    named = rows.withColumn("h", F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256))
    some = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(CENTROIDS).select("v").collect()
    return np.array([r.v for r in some], np.int64).reshape(1, len(some), COMPONENTS)


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cluster vectors of COMPONENTS components around at most CENTROIDS centroids, all in integers floor(256 * x).

    Vectors are gathered into kd-trees of TREE vectors within their partitions, which are written once and filtered
    in each of ROUNDS rounds (:meth:`KdTree.assign`). Tasks return counts and sums of clusters; centroids alone pass through the driver. A centroid without
    vectors stays.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, one row per row kept. Dropped are rows whose vector is null, has another number of
    components, or holds null or non-finite ones or ones of 2^44 or more. A null identifier is kept but starts a centroid last. Repeated identifiers count each, in
    ascending order of vectors; fewer than CENTROIDS vectors make as many centroids; of equal distances the smaller number counts. A sum beyond 64 bits is null. Other columns are not read; an
    empty table gives an empty result.
    """
    rows = integer_vectors(vectors, {id_col: "vec_id"}, vector_col).where(F.size("v") == COMPONENTS).withColumn("vec_id", F.col("vec_id").cast("long"))
    centroids = starting_centroids(rows)
    broadcast(rows, None)  # the tasks can import this package, and get batches of bounded size
    trees = materialize(_trees(rows), "trees", {"parquet.block.size": str(ROW_GROUP)})
    for _ in range(ROUNDS if centroids.shape[1] else 0):
        shared = broadcast(trees, centroids)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(*shared.value.shape)
            for batch in batches:
                for _, tree in _read(batch):
                    tree.add_to(sums, shared.value[0])
            yield sums.rows()

        centroids = means(trees.mapInArrow(summed, SUMS), centroids)

    final = broadcast(trees, centroids)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids[0]]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _read(batch):
                cluster, far = tree.clusters(final.value[0])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array([Decimal(int(x)) for x in far], pa.decimal128(38, 0)), pa.array([digests[k] for k in cluster], pa.string())], names=["vec_id", "cluster", "distance", "centroid_sha256"])

    found = materialize(trees.mapInArrow(assigned, "vec_id long, cluster int, distance decimal(38,0), centroid_sha256 string"), "clusters")
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row a centroid
    inertia = F.lit(sum((r.cluster_inertia for r in per), Decimal(0))).cast("decimal(38,0)")
    own = F.element_at(F.create_map(*[x for r in per for x in (F.lit(r.cluster), F.lit(r.cluster_inertia).cast("decimal(38,0)"))]), F.col("cluster")) if per else F.lit(None).cast("decimal(38,0)")
    return found.select("vec_id", "cluster", as_long(F.col("distance")).alias("distance"), as_long(own).alias("cluster_inertia"), as_long(inertia).alias("inertia"), "centroid_sha256")
