"""Rounding by the exact binary value, where decimal rounding of the printed value would differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed4(x: Column) -> Column:
    """Text with four decimals, half to even on the exact binary value.

    Spark rounds a double by its shortest decimal text, so 36.91985, which is stored a little below
    the tie, would go up. The product with 10,000 is therefore taken with its rounding error (the
    value split in two halves whose products are exact), and the error decides ties.
    """
    c = x * 134217729.0
    high = c - (c - x)
    product = x * 10000.0
    error = (high * 10000.0 - product) + (x - high) * 10000.0
    floor = F.floor(product)
    part = product - floor
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(floor, F.lit(2)) == 1))))
    whole = floor + F.when(up, 1).otherwise(0)
    return F.format_string("%.4f", whole / 10000.0)
