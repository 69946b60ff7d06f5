"""Packing documents into sequences by patterns of a few lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package
from .common import materialize
from .word_tokens import encoder

WIDTH, END_ID = 4096, 1
#: Patterns are made of up to DEPTH lengths, in steps of UNIT tokens.
DEPTH, UNIT = 4, 64
#: Rows of a length are numbered in runs of at most about RUN rows, and of no more than one in LEAST_RUNS of all rows, so that a very common length is not a single task.
RUN, LEAST_RUNS = 1_000_000, 1024


def pieces(docs: DataFrame, tokenizer: str, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and cut what is longer than ``width``.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32. A null text counts as empty.
    """
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode(batch.column(1).fill_null("").to_pylist())):
                raw = memoryview(ids + end)
                for k, at in enumerate(range(0, len(raw), 4 * width)):
                    part = raw[at : at + 4 * width]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(total: int, depth: int) -> list[tuple[int, ...]]:
    """All descending tuples of 1 to ``depth`` positive integers with this sum."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, head[-1] if head else left), 0, -1):
                grow((*head, x), left - x)

    grow((), total)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set."""
    gram, target = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(6 * len(b)):
        gain = np.where(free, -np.inf, target - gram @ x)
        k = int(gain.argmax())
        if gain[k] <= tol:
            break
        free[k] = True
        while True:
            z = np.zeros_like(x)
            at = np.flatnonzero(free)
            z[at] = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            low = at[z[at] <= tol / 1e3]
            if not len(low):
                x = z
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            free &= x > 1e-12 * max(1.0, x.max())
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times)]): how many sequences hold which lengths.

    Lengths rounded up to units form a coarse histogram; the repeat counts of the patterns of a few lengths
    are fitted to it by non-negative least squares and rounded down. Each
    pattern is then drawn from the true lengths, its last length being the largest that
    still fits, and what is left of a sequence is filled up with the largest lengths
    that fit. Pieces that no pattern used are packed in the same way, the longest
    first. A drawn pattern is repeated until one of its lengths runs out, so the
    plan has about as many entries as there are different lengths, whatever the number
    of documents.
    """
    left = np.zeros(width + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def largest(cap: int, used: Counter) -> int:
        at = np.flatnonzero(left[1 : cap + 1]) + 1
        for n in at[::-1]:
            if left[n] > used[int(n)]:
                return int(n)
        return 0

    def fill(used: Counter, gap: int) -> None:
        while gap > 0:
            if left[gap] > used[gap]:
                used[gap] += 1
                return
            free = left[: gap + 1].copy()
            for n, c in used.items():
                if n <= gap:
                    free[n] -= c
            two = np.flatnonzero((free[1:gap] > 0) & (free[gap - 1 : 0 : -1] > 0)) + 1
            two = two[(two * 2 != gap) | (free[two] > 1)]
            if len(two):
                n = int(two[-1])
                used[n] += 1
                used[gap - n] += 1
                return
            n = largest(gap, used)
            if not n:
                return
            used[n] += 1
            gap -= n

    def draw(used: Counter, most: int) -> int:
        times = min([most, *(int(left[n]) // c for n, c in used.items())])
        for n, c in used.items():
            left[n] -= times * c
        out.append((times, sorted(used.items(), reverse=True)))
        return times

    if left[width]:
        draw(Counter({width: 1}), int(left[width]))
    if left.any():
        levels = -(-width // UNIT)
        coarse = np.bincount(-(-np.arange(width + 1) // UNIT), weights=left, minlength=levels + 1)[1:]
        shapes = [p for p in patterns(levels, DEPTH) if len(p) > 1]
        a = np.zeros((levels, len(shapes)))
        for j, p in enumerate(shapes):
            for x in p:
                a[x - 1, j] += 1
        repeat = np.floor(nonnegative_least_squares(a, coarse.astype(float)) + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(repeat), key=lambda j: shapes[j], reverse=True):
            todo = int(repeat[j])
            while todo > 0:
                used: Counter = Counter()
                gap = width
                for x in shapes[j][:-1]:
                    n = largest(min(x * UNIT, gap), used)
                    if n <= (x - 1) * UNIT:
                        break
                    used[n] += 1
                    gap -= n
                else:
                    fill(used, gap)
                    todo -= draw(used, todo)
                    continue
                break  # the bucket is used up; the rest is packed below
    while left.any():
        used = Counter()
        n = largest(width, used)
        used[n] += 1
        fill(used, width - n)
        draw(used, int(left[n]))
    return out


def pack(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Give each row of :func:`pieces` its sequence_id and its offset there.

    Only the histogram of lengths (at most ``width`` rows) is seen by the driver.
    Rows of each length are dealt into runs of about RUN rows, fewer where the table is
    small, numbered within their run behind the runs before, and looked up in the
    plan, whose size depends on ``width`` alone.

    Every row is placed, repeated ones too; ties in length are numbered by doc_id and
    piece (nulls first). Sequences have no gaps, and an empty table gives an empty
    result.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    run = min(RUN, max(1, sum(histogram.values()) // LEAST_RUNS))
    runs = spark.createDataFrame([(n, -(-c // run)) for n, c in histogram.items()], "of long, runs long")
    rows = rows.join(F.broadcast(runs), F.col("length") == F.col("of")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("runs")))
    counts = materialize(rows.groupBy("length", "salt").count(), "lengths")
    steps, taken, base = [], Counter(), 0
    for times, lengths in plan(histogram, width):
        offset = 0
        for n, c in lengths:
            steps.append((n, taken[n], taken[n] + times * c, c, base, offset))
            taken[n] += times * c
            offset += n * c
        base += times
    columns = ["of_length", "lo", "hi", "times", "base", "at"]
    steps = spark.createDataFrame(pa.table([pa.array([s[i] for s in steps], pa.int64()) for i in range(6)], names=columns))
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(order), F.lit(0)).alias("first"))  # a row for each run
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    numbered = numbered.join(first, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("k", F.col("k") + F.col("first"))
    placed = numbered.join(F.broadcast(steps), (F.col("length") == F.col("of_length")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    within = F.col("k") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(within / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + (within % F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
