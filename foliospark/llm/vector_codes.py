"""Product codes of vectors, found by partial-distance search in integers."""

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

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A label with more rows than this, and than one in MOST_HOT of all, has its total broadcast, so that its rows aren't gathered for the join.
HOT_ROWS, MOST_HOT = 10_000, 10_000


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest entry of ``book``, the lowest of equals, and its squared distance.

    Dimensions are taken in descending order of the book's variance. After the first one the entry with the least
    distance so far is completed; an entry is dropped once its distance so far strictly exceeds that of the best complete one, so no
    nearest entry ever is.
    """
    x, book = exact(x, book)
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    so_far = (x[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = ((x - book[so_far.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(so_far <= best[:, None])
    so_far = so_far[row, entry]
    for d in order[1:]:
        so_far = so_far + (x[row, d] - book[entry, d]) ** 2
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(so_far, start) if len(start) else so_far
    hit = np.flatnonzero(so_far == least[row])
    first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[first], least


def _starting_books(rows: DataFrame) -> np.ndarray:
    """(part, entry, place): the parts of the vectors with the smallest identifiers; no entries if there are no vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v")
    head = first.limit(1).collect()
    if not head:
        return np.zeros((PARTS, 0, 1), np.int64)
    width = len(head[0].v)
    some = [r.v for r in first.where(F.size("v") == width).limit(ENTRIES).collect()]
    return np.array(some, np.int64).reshape(len(some), PARTS, width // PARTS).transpose(1, 0, 2)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of integer vectors by PARTS codebooks of ENTRIES entries, and the codebooks (part, entry, place).

    Components x become floor(256 * x). Codebooks start as the parts of the vectors with the smallest identifiers; each of ROUNDS rounds
    assigns all parts by :func:`nearest` and replaces every entry that has parts by the floor of their mean. Tasks return counts and sums of entries, so
    codebooks alone pass through the driver.

    The frame has vec_id, code (two hex digits a part), error (squared distance over all parts), label_error (error summed
    over rows of equal labels, nulls together) and codebooks_sha256, one row per row kept. Dropped are rows whose vector is null or empty, holds null or non-finite
    components or ones of 2^44 or more, is no multiple of PARTS long, or is of another length than that with the smallest identifier. A null
    identifier is the largest. Repeated identifiers count each, in ascending order of vectors; with fewer than ENTRIES vectors there are as many entries.
    A sum beyond 64 bits is null. Other columns are not read; an empty table gives an empty result.
    """
    rows = integer_vectors(vectors, {id_col: "vec_id", label_col: "label"}, vector_col).where((F.size("v") > 0) & (F.size("v") % PARTS == 0))
    books = _starting_books(rows)
    width = books.shape[2]
    rows = rows.where(F.size("v") == width * PARTS)

    for _ in range(ROUNDS if books.shape[1] else 0):
        shared = broadcast(rows, books)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(*shared.value.shape)
            for batch in batches:
                v = matrix(batch.column(0)).reshape(-1, PARTS, width)
                for p in range(PARTS):
                    sums.add(p, nearest(v[:, p], shared.value[p])[0], v[:, p])
            yield sums.rows()

        books = means(rows.select("v").mapInArrow(summed, SUMS), books)

    final = broadcast(rows, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2)).reshape(-1, PARTS, width)
            found = [nearest(v[:, p], final.value[p]) for p in range(PARTS)]
            code = np.array([e for e, _ in found], np.uint8).T
            error = [Decimal(int(x)) for x in sum(far.astype(object) for _, far in found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.decimal128(38, 0))], names=["vec_id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    codes = rows.mapInArrow(coded, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error decimal(38,0)")
    text = ",".join(str(int(x)) for x in books.ravel())
    out = _with_label_errors(materialize(codes, "codes"))
    return out.select("vec_id", "code", as_long(F.col("error")).alias("error"), as_long(F.col("label_error")).alias("label_error"), F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")), books


def _with_label_errors(codes: DataFrame) -> DataFrame:
    """label_error added; rows of hot labels aren't moved."""
    totals = materialize(codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "labels")
    limit = max(HOT_ROWS, (totals.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(totals.where(F.col("rows") > limit).select("l", F.col("label_error").alias("hot_error")))
    dealt = codes.join(hot, F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    known, rest = dealt.where("hot_error is not null"), dealt.where("hot_error is null").drop("hot_error")
    joined = rest.join(totals.where(F.col("rows") <= limit).drop("rows"), F.col("label").eqNullSafe(F.col("l"))).drop("l")
    return joined.unionByName(known.withColumnRenamed("hot_error", "label_error"))
