"""Near-duplicate vectors by randomised-rotation binary codes and exact recomputation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..cluster import ship_package
from .common import connected_components, materialize, small_enough

COSINE = 0.95
#: The chance, for a pair just at COSINE, that no band of its codes agrees.
MISS = 1e-4
#: Code bits that estimates are made from, and standard errors that their confidence bounds are wide.
BITS, SIGMAS = 512, 6.0
#: Codes compared with one another at a time; the codes of longer runs of equal bands all go into one canopy.
RUN = 1024
#: Most keys of long runs that are broadcast; beyond that the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Vectors in a block of a canopy.
BLOCK = 1024
SEED = 20240607
_turns: dict[tuple[int, int], np.ndarray] = {}


def bands(n: int) -> tuple[int, int]:
    """How many bits a band has, and how many bands: random vectors share a band with about one other, and a pair at COSINE misses all bands with a chance of MISS."""
    k = max(8, math.ceil(math.log2(max(2, n))))
    equal = (1 - math.acos(COSINE) / math.pi) ** k
    return k, math.ceil(math.log(MISS) / math.log(1 - equal))


def rotation(dim: int, bits: int) -> np.ndarray:
    """Stacked random rotations, scaled so that a unit vector stays one: at least ``bits`` rows."""
    if (dim, bits) not in _turns:
        rng = np.random.default_rng([SEED, dim])
        parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
        _turns[dim, bits] = np.vstack(parts).astype(np.float32) / np.float32(math.sqrt(len(parts)))
    return _turns[dim, bits]


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # very large or small components neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _kind(vectors: DataFrame, vector_col: str) -> str:
    """The form of components: floats stay floats, other numbers are kept as doubles."""
    return "<f4" if vectors.select(F.col(vector_col)).schema[0].dataType.elementType == FloatType() else "<f8"


def _factor(y: np.ndarray) -> np.ndarray:
    """The inner product of each rotated vector with its code, which corrects the estimates made from the code."""
    return np.abs(y).sum(1) / math.sqrt(y.shape[1])


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, sig and vec (little-endian components) of vectors that can link."""
    v, kind = F.col("v"), _kind(vectors, vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind) + 0  # no negative zeros
            raw = [flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "sig", "vec"])

    return rows.mapInArrow(packed, "vec_id long, sig binary, vec binary")


def _codes(reps: DataFrame, k: int, n_bands: int, kind: str) -> DataFrame:
    """rep, code (at least BITS bits), factor, and the keys of the bands."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, width = (1 << np.arange(k, dtype=np.int64))[::-1], np.dtype(kind).itemsize
        for batch in batches:
            vec, rep = batch.column("vec").to_pylist(), batch.column("rep").to_numpy()
            size = np.array([len(x) for x in vec])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                x, dim = _unit([vec[i] for i in at], kind).astype(np.float32), int(s) // width
                bit = x @ rotation(dim, max(BITS, k * n_bands)).T > 0
                y = x @ rotation(dim, BITS).T
                part = bit[:, : k * n_bands].reshape(len(at), n_bands, k) @ weight
                key = (part + (np.arange(n_bands, dtype=np.int64) << 40) + (dim << 50)).ravel()  # k is below 40, bands below 1024
                lists = pa.ListArray.from_arrays(np.arange(0, len(key) + 1, n_bands, dtype=np.int32), key)
                code = [c.tobytes() for c in np.packbits(y > 0, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(code, pa.binary()), pa.array(_factor(y).astype(float)), lists], names=["rep", "code", "factor", "keys"])

    return reps.select("rep", "vec").mapInArrow(coded, "rep long, code binary, factor double, keys array<long>")


def _candidates(keyed: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the codes of each key which are close enough for a link.

    Keys of up to RUN codes are compared within a task. Codes of longer runs are all
    tied to the smallest one by a join, so that no task gathers such a run and none of its
    pairs is torn apart; the canopy's pairs of blocks then tell which of them link.
    """
    long = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("root")).where(F.col("n") > RUN).select("key", "root")
    long = materialize(long, "runs")
    short, edges = keyed, None
    if not long.isEmpty():
        tied = keyed.join(F.broadcast(long) if small_enough(long, BROADCAST_KEYS) else long, "key", "left")
        edges = tied.where("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b")).distinct()
        short = tied.where("root is null")
    near = short.repartition("key").sortWithinPartitions("key").select("key", "rep", "code").mapInArrow(_near, "a long, b long")
    return near.union(edges) if edges is not None else near


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the codes of each run of equal keys which are close enough for a link; a run has at most RUN codes."""
    key, run = None, []
    for batch in batches:
        for k, r, c in zip(batch.column("key").to_pylist(), batch.column("rep").to_pylist(), batch.column("code").to_pylist()):
            if k != key:
                if len(run) > 1:
                    yield _edges(run)
                key, run = k, []
            run.append((r, c))
    if len(run) > 1:
        yield _edges(run)


def near_codes(bits: int) -> float:
    """The most bits in which the codes of a pair at COSINE differ, but for a chance of SIGMAS standard errors."""
    p = math.acos(COSINE) / math.pi
    return bits * p + SIGMAS * math.sqrt(bits * p * (1 - p))


def _edges(run: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Edges that connect codes within the distance of a link; codes connected already are not compared again."""
    rep = np.array([r for r, _ in run])
    code = np.frombuffer(b"".join(c for _, c in run), np.uint8).reshape(len(run), -1)
    code = np.pad(code, ((0, 0), (0, -code.shape[1] % 8))).view(np.uint64)
    bound = near_codes(code.shape[1] * 64)
    out: list[tuple[int, int]] = []
    label = np.arange(len(rep))
    for i in range(len(rep) - 1):
        far = np.bitwise_count(code[i + 1 :] ^ code[i]).sum(1)
        for j in np.flatnonzero((far <= bound) & (label[i + 1 :] != label[i])) + i + 1:
            if label[j] != label[i]:
                out.append((int(rep[i]), int(rep[j])))
                label[label == label[j]] = label[i]
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _link(table: pa.Table, kind: str = "<f4") -> pa.Table:
    """The links of one pair of blocks: for each vector how many vectors it is linked to, and a spanning forest.

    Inner products are estimated from the codes of one side and the rotated vectors of
    the other; a pair whose upper confidence bound reaches COSINE is computed in double precision.
    """
    order = np.argsort(table.column("rep").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    x = _unit(table.column("vec").to_pylist(), kind)
    f = table.column("factor").to_numpy()
    y = (x.astype(np.float32) @ rotation(x.shape[1], BITS).T)
    d = y.shape[1]
    sign = np.unpackbits(np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(rep), -1), axis=1)[:, :d].astype(np.float32) * 2 - 1
    error = SIGMAS * np.sqrt((1 - np.minimum(f, 1) ** 2) / f**2 / (d - 1))
    same = table.column("p")[0].as_py() == table.column("q")[0].as_py()
    block = table.column("i").to_numpy()
    links, label, edges = np.zeros(len(rep), np.int64), np.arange(len(rep)), []
    for lo in range(0, len(rep), 256):
        rows = np.arange(lo, min(lo + 256, len(rep)))
        maybe = (sign[rows] @ y.T) / (math.sqrt(d) * f[rows])[:, None] + error[rows, None] >= COSINE
        maybe &= (rows[:, None] != np.arange(len(rep))[None]) if same else (block[rows, None] != block[None])
        if maybe.mean() > 0.02:
            linked = maybe & (x[rows] @ x.T >= COSINE)
        else:
            a, b = np.nonzero(maybe)
            linked = np.zeros_like(maybe)
            linked[a, b] = np.einsum("ij,ij->i", x[rows[a]], x[b]) >= COSINE
        links[rows] = linked @ copies
        for r, line in zip(rows, linked):
            for j in np.flatnonzero(line & (label != label[r])):
                if label[j] != label[r]:
                    edges.append((int(rep[r]), int(rep[j])))
                    label[label == label[j]] = label[r]
    a = [*rep[links > 0].tolist(), *(e[0] for e in edges)]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([None] * int((links > 0).sum()) + [e[1] for e in edges], pa.int64()), "links": pa.array([*links[links > 0].tolist(), *([0] * len(edges))], pa.int64())})


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors with a cosine of COSINE or more.

    Equal vectors collapse into one. Each is turned by random rotations and keeps the signs
    (its code) and the inner product of code and turned vector (its correction factor).
    Bands of the code are join keys; codes that share a band and are
    close enough for a link, within confidence bounds, are connected into canopies. The vectors of a canopy are
    compared block by block: an unbiased estimate from code and factor with its
    confidence bound rules a pair out, all others are computed exactly. Tasks return
    counts and a spanning forest, never all pairs.

    Every link returned is exact. A pair at the threshold goes unseen with a chance of
    about MISS, closer ones with much less; the tests measure recall against brute force.

    Returns one row per input row: vec_id, n_links, component_id, kept. A vector that is
    null, empty or zero, or holds null or non-finite components, links with nothing, and
    vectors of different lengths don't link. Floats and doubles are read as they are. Repeated rows and equal vectors link with
    one another. A row with a null identifier links with nothing, has a null component_id
    and isn't kept. Other input columns are not read; an empty table gives an empty result.
    """
    ship_package(vectors.sparkSession)
    rows = materialize(_valid(vectors, id_col, vector_col), "vectors")
    reps = materialize(rows.groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "distinct")
    k, n_bands = bands(reps.count())
    kind = _kind(vectors, vector_col)
    codes = materialize(_codes(reps, k, n_bands, kind), "codes")
    keyed = codes.select("rep", "code", F.explode("keys").alias("key"))
    canopy = connected_components(_candidates(keyed)).select(F.col("node").alias("rep"), F.col("component").alias("canopy"))
    size = canopy.groupBy("canopy").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    dealt = canopy.join(size, "canopy").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("nb")))
    pairs = dealt.select("rep", "canopy", "i", F.explode(F.expr("transform(sequence(0L, nb - 1), j -> struct(least(i, j) as p, greatest(i, j) as q))")).alias("k")).select("rep", "canopy", "i", "k.p", "k.q")
    found = pairs.join(reps.select("rep", "copies", "vec"), "rep").join(codes.select("rep", "code", "factor"), "rep").groupBy("canopy", "p", "q").applyInArrow(lambda t: _link(t, kind), "a long, b long, links long")
    found = materialize(found, "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("b is not null"))
    per = (
        reps.select("sig", "rep", "copies").join(links, F.col("rep") == F.col("a"), "left").join(component, F.col("rep") == F.col("node"), "left")
        .select("sig", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    linked = rows.select("vec_id", "sig").join(per, "sig").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    return _with_the_rest(ids, linked)


def _with_the_rest(ids: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows that have no valid vector link with nothing; as many rows come out as went in."""
    many = ids.groupBy("id").count().join(linked.groupBy("vec_id").count().withColumnRenamed("count", "valid"), F.col("id").eqNullSafe(F.col("vec_id")), "left")
    rest = many.select("id", F.explode(F.sequence(F.lit(0), (F.col("count") - F.coalesce("valid", F.lit(0))).cast("int"))).alias("k")).where("k > 0")
    rest = rest.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
