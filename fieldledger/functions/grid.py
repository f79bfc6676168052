"""Grid cells as equi-join keys, so that Spark hashes instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(lat: str, lon: str, side: float) -> Column:
    """struct(y, x) of the cell holding a point."""
    return F.struct(F.floor(F.col(lat) / side).cast("long").alias("y"), F.floor(F.col(lon) / side).cast("long").alias("x"))


def with_cell(df: DataFrame, lat: str, lon: str, side: float, name: str = "cell") -> DataFrame:
    return df.withColumn(name, cell(lat, lon, side))


def with_near_cells(df: DataFrame, lat: str, lon: str, side: float, name: str = "cell") -> DataFrame:
    """Each row nine times, for its cell and the eight around; put it on the smaller side of a join."""
    around = [F.struct((F.floor(F.col(lat) / side) + dy).cast("long").alias("y"), (F.floor(F.col(lon) / side) + dx).cast("long").alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return df.withColumn(name, F.explode(F.array(*around)))
