"""The two map builds as composed jobs: base map from GeoJSON, terrain grid from tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geo_etl
from ..sources import geojson, tiles


def basemap(spark: SparkSession, counties: str, roads: str, water: str, wanted: DataFrame, frame: tuple[float, float, float, float]) -> dict[str, DataFrame]:
    """counties, outline, roads and water, clipped to `frame`, simplified and delta-encoded; `missing` lists wanted counties without a shape.

    `wanted`: name. A county's name is BASENAME, with ' (City)' where LSADC is 25; roads and water carry NAME.
    """
    geojson.register(spark)
    said = lambda k: F.get_json_object("properties", f"$.{k}")
    encoded = lambda df, tol: df.withColumn("line", geo_etl.simplify("line", tol)).withColumn("deltas", geo_etl.delta_encode("line"))
    west, south, east, north = frame

    shapes = geo_etl.geojson_rings(spark.read.format("geojson").load(counties))
    name = F.concat(said("BASENAME"), F.when(said("LSADC") == "25", " (City)").otherwise(""))
    shapes = shapes.withColumn("name", name).join(wanted.select("name").distinct(), "name", "left_semi")
    outline = geo_etl.chain_rings(geo_etl.boundary_edges(shapes, "name").withColumn("layer", F.lit("outline")), "layer")

    def lines(path: str, tol: float, extra) -> DataFrame:
        df = geo_etl.geojson_rings(spark.read.format("geojson").load(path)).withColumn("name", said("NAME")).filter(geo_etl.box_meets("ring", west, south, east, north, 0.02))
        df = extra(df).withColumn("id", F.xxhash64("file", "name", F.to_json("ring")))
        kept = geo_etl.clip_line(df.select("id", "ring"), "id", "ring", west, south, east, north)
        return encoded(kept.join(df.drop("ring", "properties", "file", "kind").dropDuplicates(["id"]), "id"), tol)

    return {
        "counties": encoded(shapes.select("name", F.col("ring").alias("line")), geo_etl.TOLERANCE["county"]),
        "outline": encoded(outline.select("ring_no", F.col("ring").alias("line")), geo_etl.TOLERANCE["outline"]),
        "roads": lines(roads, geo_etl.TOLERANCE["road"], lambda d: d.withColumn("class", geo_etl.road_class("name")).filter("class IS NOT NULL")),
        "water": lines(water, geo_etl.TOLERANCE["water"], lambda d: d.withColumn("label", geo_etl.water_name("name")).filter(F.size("ring") >= 4)),
        "missing": geo_etl.uncovered(wanted, shapes, "name"),
    }


def save_terrain(grid: DataFrame, path: str) -> None:
    """The height grid as a long table, rows of the picture together."""
    grid.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def terrain(spark: SparkSession, folder: str, columns: int = 640) -> DataFrame:
    """(row, col, high, low): the 16-bit height grid over all tiles of a folder, `columns` wide, cells square."""
    px = tiles.read_tiles(spark, folder)
    span = px.agg(F.min("tile_x").alias("x0"), F.min("tile_y").alias("y0"), F.max("tile_x").alias("x1"), F.max("tile_y").alias("y1"), (F.max("px") + 1).alias("side")).first()
    if span["x0"] is None:
        return spark.createDataFrame([], "row int, col int, high int, low int")
    side = span["side"]
    flat = px.select(((F.col("tile_x") - span["x0"]) * side + F.col("px")).alias("x"), ((F.col("tile_y") - span["y0"]) * side + F.col("py")).alias("y"), geo_etl.terrarium(F.col("r"), F.col("g"), F.col("b")).alias("value"))
    wide, tall = (span["x1"] - span["x0"] + 1) * side, (span["y1"] - span["y0"] + 1) * side
    columns = min(columns, wide)
    grid = geo_etl.resample(flat, columns, max(1, round(columns * tall / wide)))
    high, low = geo_etl.quantise(F.col("value"))
    return grid.select("row", "col", high.alias("high"), low.alias("low"))
