"""Vectors as integers, and sums over them that come to the driver at a fixed size."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components from here on count like non-finite ones: SCALE times them leaves the range of exact integers.
TOO_LARGE = 2.0**44
#: Products of integers below this, summed over a vector, are exact as doubles; larger ones are Python's own integers.
EXACT = 1 << 21
#: Most components of a vector for which EXACT holds.
MOST_COMPONENTS = 1024
SUMS = "part int, entry int, place int, n long, total decimal(38,0)"


def integer_vectors(vectors: DataFrame, keep: dict[str, str], vector_col: str) -> DataFrame:
    """The columns named by ``keep`` (old name to new) and v: floor(SCALE * x) of each component.

    Rows whose vector is null or holds a null, non-finite or too large component are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE)
    return vectors.where(F.col(vector_col).isNotNull() & F.forall(v, good)).select(*[F.col(old).alias(new) for old, new in keep.items()], whole.alias("v"))


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where all arithmetic on them is exact, else as Python integers."""
    small = all(a.size == 0 or int(np.abs(a).max()) < EXACT and a.shape[-1] <= MOST_COMPONENTS for a in arrays)
    return [a.astype(np.float64 if small else object) for a in arrays]


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows of integers."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Sums:
    """Counts and componentwise sums of vectors by part and entry, of any size."""

    def __init__(self, parts: int, entries: int, width: int):
        self.n = np.zeros((parts, entries), np.int64)
        self.total = np.zeros((parts, entries, width), object)

    def add(self, part: int, entry: np.ndarray, v: np.ndarray) -> None:
        """Add the integer vectors ``v`` (thousands at most, so that their sum stays within 64 bits) to their entries."""
        self.n[part] += np.bincount(entry, minlength=self.n.shape[1])
        some = np.zeros(self.total.shape[1:], np.int64)
        np.add.at(some, entry, v)
        self.total[part] += some

    def rows(self) -> pa.RecordBatch:
        part, entry = np.nonzero(self.n)
        width = self.total.shape[2]
        each = lambda a, t: pa.array(np.repeat(a, width), t)
        totals = pa.array([Decimal(int(x)) for x in self.total[part, entry].ravel()], pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([each(part, pa.int32()), each(entry, pa.int32()), pa.array(np.tile(np.arange(width), len(part)), pa.int32()), each(self.n[part, entry], pa.int64()), totals], names=["part", "entry", "place", "n", "total"])


def means(sums: DataFrame, old: np.ndarray) -> np.ndarray:
    """``old`` (part, entry, place) with the floor of the mean wherever an entry has vectors.

    The tasks' sums are added up by Spark; one row for each place of ``old`` reaches the driver.
    """
    new = old.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        new[r.part, r.entry, r.place] = int(r.total) // r.n
    return new


def as_long(total: Column) -> Column:
    """A decimal as long, null where it doesn't fit."""
    return F.when(F.abs(total) < F.lit(Decimal(2**63)), total.cast("long"))
