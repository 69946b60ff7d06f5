"""An inverted file of examples by centroids, for exact top-k where both sides are large."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package
from ..storage import materialize, small_enough

#: Examples that centroids are fitted on, the first by a hash of their identifier (at 64 components 10 MB); all examples are indexed.
SAMPLE, ROUNDS, SEED = 20_000, 8, 5
#: Most lists, lists that each query reads first, examples or queries that meet in a task (and bytes of the vectors of either), scores that are computed at a time,
#: and columns of scores of which the greatest one is looked at first.
MOST_LISTS, FIRST, BLOCK, BLOCK_BYTES, AT_ONCE, STRIDE = 32, 2, 65_536, 32 << 20, 1 << 22, 32
#: Most groups (templates, or bundles of lists) whose sizes are sent to every task.
MOST_BLOCKS = 200_000
#: Scores are rounded to so many digits; a list is skipped only if its bound is farther off than that.
DIGITS, SLACK = 6, 2e-6
ROWS = "id long, template string, size int, vector array<double>, norm double, list int, angle double"


class Centroids:
    """Unit vectors by length of vector, and which of them an angle is measured to."""

    def __init__(self, by_size: dict[int, np.ndarray]):
        self.by_size, at = by_size, 0
        self.start = {}
        for d in sorted(by_size):
            self.start[d] = at
            at += len(by_size[d])
        self.n = at

    def angles(self, x: np.ndarray) -> np.ndarray:
        """Of unit vectors of one length to the centroids of that length."""
        return np.arccos(np.clip(x @ self.by_size[x.shape[1]].T, -1, 1))


def _fit(some: list[list[float]], lists: int) -> Centroids:
    by_size: dict[int, list] = {}
    for v in some:
        by_size.setdefault(len(v), []).append(v)
    rng, out = np.random.default_rng(SEED), {}
    for d, rows in by_size.items():
        x = np.array(rows)
        x /= np.linalg.norm(x, axis=1)[:, None]
        k = max(1, min(len(x), round(lists * len(x) / len(some))))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1)
            c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], c)
        out[d] = c
    return Centroids(out)


def _placed(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """ROWS: each row's vector, its nearest centroid (-1 for vectors without direction, and lengths that no example has) and the angle to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v or [], float) for v in batch.column(2).to_pylist()]
            norm = np.array([np.linalg.norm(v) for v in vectors])
            where, angle, size = np.full(len(vectors), -1), np.zeros(len(vectors)), np.array([len(v) for v in vectors])
            for d in np.unique(size):
                at = np.flatnonzero((size == d) & (norm > 0) & np.isfinite(norm))
                if d in shared.value.by_size and len(at):
                    far = shared.value.angles(np.array([vectors[i] / norm[i] for i in at]))
                    where[at], angle[at] = far.argmin(1) + shared.value.start[d], far.min(1)
            raw = pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), raw, pa.array(norm), pa.array(where, pa.int32()), pa.array(angle)], names=["id", "template", "size", "vector", "norm", "list", "angle"])

    return rows.mapInArrow(place, ROWS)


def _visits(queries: DataFrame, centroids: Centroids, radius: np.ndarray, found: bool) -> DataFrame:
    """query, list: the FIRST lists nearest to each query; or, once its k-th score (``least``) is known, all others whose bound reaches that.

    By the triangle inequality no example of a list is nearer to a query than its centroid is, less the list's radius.
    """
    shared = queries.sparkSession.sparkContext.broadcast((centroids, radius))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, r = shared.value
        for batch in batches:
            size, norm = batch.column("size").to_numpy(), batch.column("norm").to_numpy()
            asked, lists = [], []
            for d in np.unique(size):
                at = np.flatnonzero((size == d) & (norm > 0) & np.isfinite(norm))
                if d not in c.by_size or not len(at):
                    continue
                x = np.array([batch.column("vector")[int(i)].as_py() for i in at]) / norm[at][:, None]
                far = c.angles(x)
                first = np.argsort(far, axis=1, kind="stable")[:, :FIRST]
                chosen = np.zeros(far.shape, bool)
                np.put_along_axis(chosen, first, True, 1)
                if found:
                    best = np.cos(np.maximum(0, far - r[c.start[d] : c.start[d] + far.shape[1]]))
                    chosen = ~chosen & (best >= batch.column("least").to_numpy()[at][:, None] - SLACK)
                i, j = np.nonzero(chosen)
                asked.append(at[i])
                lists.append(j + c.start[d])
            ids = batch.column("id").to_numpy()
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate([none, *asked])]), pa.array(np.concatenate([none, *lists]), pa.int32())], names=["query", "list"])

    columns = ["id", "size", "vector", "norm", *(["least"] if found else [])]
    return queries.select(*columns).mapInArrow(choose, "query long, list int")


def _bundles(counts: dict[int, int], lists: int, block: int) -> list[str]:
    """Of each list the bundle that it is in: neighbouring lists of about ``block`` examples in all."""
    out, before = [], 0
    for at in range(lists):
        out.append(str(before // block))
        before += counts.get(at, 0)
    return out


def _compared(queries: DataFrame, examples: DataFrame, visits: DataFrame, k: int, by_template: bool, bundles: list[str], block: int) -> DataFrame:
    """query_id, example_id, score of the best k of each query in each block of the lists that it visits.

    A query is sent once to each bundle of lists, however many of these it visits, or if only its template counts to that. Bundles and templates, and the queries for one, are
    cut into blocks of about ``block`` rows, so that no task holds more than two of these, however hot one is, and a row is sent as often as the other side has blocks. Queries with a known k-th score (``least``) get no lower ones.
    """
    bundle = lambda c: F.get(F.array(*[F.lit(b) for b in bundles]), c)
    by_query = visits.groupBy("query").agg(F.collect_list("list").alias("lists"))
    if by_template:
        asked = by_query.select("query").join(queries.select(F.col("id").alias("query"), F.col("template").alias("grp")), "query")
    else:
        asked = visits.select("query", bundle(F.col("list")).alias("grp")).distinct()
    e = examples.withColumn("grp", F.col("template") if by_template else bundle(F.col("list")))
    asked = asked.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks")).join(e.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("e_blocks")), "grp")
    asked = materialize(asked, "blocks")  # a row a group
    asked = F.broadcast(asked) if small_enough(asked, MOST_BLOCKS) else asked
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    least = F.col("least") if "least" in queries.columns else F.lit(-2.0).alias("least")
    q = by_query.join(queries.select(F.col("id").alias("query"), F.col("template").alias("grp"), "vector", "norm", least), "query")
    if not by_template:
        q = q.withColumn("grp", F.explode(F.array_distinct(F.transform("lists", bundle))))
    q = q.join(asked, "grp").withColumn("q_part", part("query", "q_blocks")).withColumn("e_part", all_of("e_blocks")).select("query", "vector", "norm", "least", "lists", "grp", "q_part", "e_part")
    e = e.join(asked, "grp").withColumn("e_part", part("id", "e_blocks")).withColumn("q_part", all_of("q_blocks")).select("id", "vector", "norm", "list", "grp", "q_part", "e_part")

    def best(x: np.ndarray, own_norms: np.ndarray, floor: np.ndarray, ids: np.ndarray, y: np.ndarray, norms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, identifiers of examples and scores of the best k of some queries in one list, ordered by identifier."""
        near_x, near_y = (x / own_norms[:, None]).astype(np.float32), (y / norms[:, None]).astype(np.float32)
        slack = 2 * SLACK + 2.4e-7 * (x.shape[1] + 2)  # twice what single precision is off, and the rounding
        wide, step = -(-len(y) // STRIDE), max(1, AT_ONCE // len(y))
        for lo in range(0, len(x), step):
            s = near_x[lo : lo + step] @ near_y.T
            # the k greatest of some disjoint groups are no greater than the k greatest of all
            tops = np.full((len(s), STRIDE * wide), -2, np.float32)
            tops[:, : s.shape[1]] = s
            tops = tops.reshape(len(s), STRIDE, wide).max(1)
            bar = np.partition(tops, -k, axis=1)[:, -k] if wide > k else np.full(len(s), -2, np.float32)
            i, j = np.nonzero(s >= (np.maximum(bar, floor[lo : lo + step]) - slack)[:, None])
            exact = np.round(np.einsum("ij,ij->i", x[lo + i], y[j]) / (own_norms[lo + i] * norms[j]), DIGITS)
            yield from _first(lo + i, ids[j], exact, k)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "example_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        flat = lambda t: (np.asarray(t.column("vector").combine_chunks().flatten(), float), np.r_[0, np.cumsum(np.asarray(t.column("vector").combine_chunks().value_lengths()))])
        (xs, x_at), (ys, y_at) = flat(left), flat(right)
        ids, where, norms = (right.column(c).to_numpy() for c in ("id", "list", "norm"))
        asked_ids, own_norms, floor = (left.column(c).to_numpy() for c in ("query", "norm", "least"))
        lists = left.column("lists").combine_chunks()
        read, reader = np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        some = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))]
        for at in np.unique(where):
            rows, askers = np.flatnonzero(where == at), reader[read == at]
            if not len(askers):
                continue
            rows = rows[np.argsort(ids[rows], kind="stable")]
            d = y_at[rows[0] + 1] - y_at[rows[0]]  # a list holds vectors of one length
            y, x = ys[y_at[rows][:, None] + np.arange(d)], xs[x_at[askers][:, None] + np.arange(d)]
            some += [(askers[i], e, s) for i, e, s in best(x, own_norms[askers], floor[askers], ids[rows], y, norms[rows])]
        i, found, exact = next(_first(*map(np.concatenate, zip(*some)), k))
        return pa.table(dict(zip(none.column_names, (asked_ids[i], found, exact))))

    key = ["grp", "q_part", "e_part"]
    return q.groupBy(*key).cogroup(e.groupBy(*key)).applyInArrow(score, "query_id long, example_id long, score double")


def _first(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k highest scores of each query, of equal ones the smaller identifier."""
    by = np.lexsort((ids, -scores, i))
    i, ids, scores = i[by], ids[by], scores[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    yield i[keep], ids[keep], scores[keep]


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "example_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _without_direction(q: DataFrame, e: DataFrame, k: int, by_template: bool) -> DataFrame:
    """The pairs that score 0 because lengths differ or a vector has no direction: the first k by identifier for each query, from the first k of each length."""
    flat = lambda d: F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), d)
    scope = ["template"] if by_template else []
    classes = e.select("id", flat(F.col("size")).alias("d"), "template")
    order = Window.partitionBy(*scope, "d").orderBy("id")
    first = classes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy(*scope, "d").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    scoped = F.col("template") if by_template else F.lit("all")
    per = (first if by_template else first.withColumn("template", scoped)).groupBy("template").agg(F.collect_list(F.struct("d", "ids")).alias("all"))  # the lengths there are
    asked = q.select(F.col("id").alias("query_id"), flat(F.col("size")).alias("qd"), scoped.alias("template"))
    both = asked.join(per if by_template else F.broadcast(per), "template")
    other = F.filter("all", lambda c: c["d"].isNull() | F.col("qd").isNull() | (c["d"] != F.col("qd")))
    ids = F.slice(F.array_sort(F.flatten(F.transform(other, lambda c: c["ids"]))), 1, k)
    return both.select("query_id", F.explode(ids).alias("example_id"), F.lit(0.0).alias("score"))


def top_examples_indexed(queries: DataFrame, examples: DataFrame, k: int, by_template: bool = True) -> tuple[DataFrame, DataFrame]:
    """What :func:`foliospark.operators.retrieval.top_examples` returns (query_id, example_id, score, rank), and the lists that queries read (query, list).

    Examples are dealt into lists by the nearest of some centroids (about the square root of their number, MOST_LISTS at most), which are fitted on SAMPLE of
    them. Each query reads its FIRST nearest lists; its k-th score rules out all lists whose bound is below that, and it reads the others. So results are
    exact, and how much is read depends on how well the vectors cluster. No pair of query and list, let alone example, is ever a row unless the query reads the list.
    """
    ship_package(queries.sparkSession)
    side = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("template").cast("string").alias("template"), F.col("vector").cast("array<double>").alias("vector"))
    named = "id is not null" + (" and template is not null" if by_template else "")
    e = side(examples.where(f"size(vector) > 0 and {named}"))
    n = e.count()
    lists = max(1, min(MOST_LISTS, math.isqrt(n)))
    some = e.where(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v) > 0).where("forall(vector, v -> v is not null and not isnan(v) and abs(v) < 1e100)")
    of_length = some.groupBy(F.size("vector").alias("d")).agg(F.min_by("vector", "id").alias("vector")).collect()  # no length without a centroid
    centroids = _fit([r.vector for r in some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()] + [r.vector for r in of_length], lists)
    e = materialize(_placed(e, centroids), "examples")
    q = materialize(_placed(side(queries.where(named)), centroids), "queries")
    listed = e.where("list >= 0")
    counts = materialize(listed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")), "lists")
    radius = np.full(max(1, centroids.n), -np.inf)  # an empty list is never read
    sizes = counts.collect()
    for r in sizes:
        radius[r["list"]] = r["radius"] + 1e-7
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * max([1, *centroids.by_size]))))
    bundles = _bundles({r["list"]: r["n"] for r in sizes}, max(1, centroids.n), block)
    zero = _without_direction(q, e, k, by_template)
    first = materialize(_visits(q, centroids, radius, False), "visits")
    near = materialize(_best(_compared(q, listed, first, k, by_template, bundles, block).unionByName(zero), k), "near")
    least = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = q.join(least, F.col("id") == F.col("query_id"), "left").withColumn("least", F.when(F.col("n") == k, F.col("least")).otherwise(-2.0))
    then = materialize(_visits(known, centroids, radius, True), "visits")
    found = _best(near.drop("rank").unionByName(_compared(known, listed, then, k, by_template, bundles, block)), k)
    return found, first.union(then)
