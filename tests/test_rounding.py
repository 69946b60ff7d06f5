"""Rounding against Python's own."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from foliospark.functions.rounding import exact_round


def test_equals_python(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, -2.5, 0.105, 2.675, 1e15 + 0.3, 4.5e11 + 0.00005, 2.0**52 + 0.5, 2.0**53 + 2, 1e300, -1e-300, 5e-324, 0.99995, 0.999999999, 9.99995, math.inf, -math.inf]
    values += [k / 2**j for k in range(-300, 300) for j in range(1, 12)]  # ties of all lengths
    values += [round(rng.uniform(0, 100), 3) + 5 * 10.0**-rng.randint(1, 6) for _ in range(20_000)]  # decimals near the middle
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 16) for _ in range(60_000)]
    values += [v for v in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(30_000)) if not math.isnan(v)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    digits = (0, 1, 2, 4, 6, 9, 15)
    for row in frame.select("v", *[exact_round(F.col("v"), d).alias(f"d{d}") for d in digits]).collect():
        for d in digits:
            want = None if row.v is None else row.v if math.isinf(row.v) else round(row.v, d)
            got = row[f"d{d}"]
            assert got == want and (got is None or math.copysign(1, got) == math.copysign(1, want)), (row.v, d, got, want)


def test_random_doubles_by_the_million(spark):
    digits = 4
    frame = spark.range(1_000_000).select((F.rand(7) * F.pow(F.lit(10.0), F.pmod("id", F.lit(14)) - 6)).alias("v"))

    @F.pandas_udf("double")
    def python(v):
        return v.map(lambda x: round(x, digits))

    assert frame.where(exact_round(F.col("v"), digits) != python("v")).count() == 0


def test_odd_input(spark):
    assert math.isnan(spark.range(1).select(exact_round(F.lit(float("nan")), 2)).first()[0])
    assert spark.range(1).select(exact_round(F.lit(7), 2)).first()[0] == 7.0
    with pytest.raises(ValueError):
        exact_round(F.lit(1.0), 16)
