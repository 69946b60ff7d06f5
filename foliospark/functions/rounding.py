"""Decimal rounding of the exact binary value of doubles, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles from here on are whole; this factor splits a double into halves whose products are exact.
WHOLE, SPLIT = 2.0**53, 134_217_729.0
MOST_DIGITS = 15


def exact_round(x: Column, digits: int = 0) -> Column:
    """``x`` rounded to so many decimals (0 to MOST_DIGITS): the decimal nearest to its exact value, of two as near the even one, as the nearest double.

    The fraction times the power of ten is taken as a rounded product and its exact error (the halves of both factors are multiplied
    without error), so which side of the middle it lies on is known exactly. Signs stay, of zeros too; infinite
    values and NaN are as they are, null is null.
    """
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"0 to {MOST_DIGITS} digits")
    power = 10.0**digits
    split = lambda v: v * SPLIT - (v * SPLIT - v)
    c = split(power)
    d = power - c
    x = x.cast("double")

    def parts(v: Column) -> Column:
        whole = F.floor(F.abs(v)).cast("double")
        return F.struct(v.alias("x"), whole.alias("whole"), (F.abs(v) - whole).alias("part"))  # exact

    def products(s: Column) -> Column:
        a = split(s["part"])
        b, product = s["part"] - a, s["part"] * power
        error = ((a * c - product) + a * d + b * c) + b * d
        return F.struct(s["x"].alias("x"), s["whole"].alias("whole"), F.floor(product).cast("double").alias("below"), product.alias("product"), error.alias("error"))

    def nearest(s: Column) -> Column:
        over = (s["product"] - s["below"] - 0.5) + s["error"]  # above the middle, or below it; its sign is exact
        odd = (s["below"] if digits else s["whole"] + s["below"]) % 2 != 0
        up = s["below"] + F.when((over > 0) | ((over == 0) & odd), 1.0).otherwise(0.0)
        return F.struct(s["x"].alias("x"), (s["whole"] + F.when(up == power, 1.0).otherwise(0.0)).alias("whole"), F.when(up == power, 0.0).otherwise(up).alias("up"))

    def joined(s: Column) -> Column:
        total = s["whole"] * power + s["up"]
        text = F.concat(s["whole"].cast("long").cast("string"), F.lit("."), F.lpad(s["up"].cast("long").cast("string"), max(1, digits), "0"))
        near = F.when(F.abs(s["x"]) >= WHOLE, F.abs(s["x"])).when(total < WHOLE, total / power).otherwise(text.cast("double") if digits else total)
        return F.when(F.isnan(s["x"]), s["x"]).when((s["x"] < 0) | (s["x"].cast("string") == "-0.0"), -near).otherwise(near)

    step = F.array(x)
    for rule in (parts, products, nearest, joined):  # each names what the next one uses more than once
        step = F.transform(step, rule)
    return step[0]
