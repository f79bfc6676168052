"""Rings, lines and rasters: the map-building steps on array and long-table columns.

A ring or line is array<struct(lon double, lat double)>. Nulls: a null ring gives null or no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
LINE = T.ArrayType(POINT)
# fixed values of the map build, in degrees
TOLERANCE = {"county": 0.0009, "outline": 0.004, "road": 0.0015, "water": 0.0012}


def geojson_rings(df: DataFrame, kind: str = "kind", coordinates: str = "coordinates") -> DataFrame:
    """Rows once for each ring or line of a Polygon, MultiPolygon, LineString or MultiLineString.

    `coordinates` is array<array<array<array<double>>>>, simpler shapes wrapped in outer arrays of
    one; only the outer ring of each polygon is taken.
    """
    point = "struct(p[0] AS lon, p[1] AS lat)"
    outer = F.expr(
        f"""CASE WHEN {kind} IN ('Polygon', 'MultiPolygon') THEN transform({coordinates}, poly -> transform(poly[0], p -> {point}))
                 ELSE flatten(transform({coordinates}, many -> transform(many, line -> transform(line, p -> {point})))) END"""
    )
    return df.withColumn("ring", F.explode(outer)).drop(coordinates)


def box_meets(ring: str, west: float, south: float, east: float, north: float, pad: float = 0.0) -> Column:
    """The ring's bounding box meets the given one, widened by `pad`."""
    return F.expr(
        f"""array_max(transform({ring}, p -> p.lon)) >= {west - pad} AND array_min(transform({ring}, p -> p.lon)) <= {east + pad}
        AND array_max(transform({ring}, p -> p.lat)) >= {south - pad} AND array_min(transform({ring}, p -> p.lat)) <= {north + pad}"""
    )


def clip_line(lines: DataFrame, key: str, line: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """(key, piece, line): the stretches of each line inside the box, each with its neighbours outside; stretches of one point are dropped."""
    p = lines.select(key, F.posexplode(line).alias("i", "p"))
    inside = F.expr(f"p.lon BETWEEN {west} AND {east} AND p.lat BETWEEN {south} AND {north}")
    w = Window.partitionBy(key).orderBy("i")
    p = p.withColumn("inside", F.coalesce(inside, F.lit(False)))
    p = p.withColumn("keep", F.col("inside") | F.coalesce(F.lag("inside").over(w), F.lit(False)) | F.coalesce(F.lead("inside").over(w), F.lit(False)))
    p = p.withColumn("piece", F.sum(F.when(F.col("keep"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("keep")
    out = p.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("pts")).filter(F.size("pts") > 1)
    return out.select(key, "piece", F.transform("pts", lambda x: x["p"]).alias("line"))


def _simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept by splitting at the farthest point while it is farther off than `tolerance` (stack, no recursion)."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = np.hypot(*d)
        far = np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / length if length > 0 else np.hypot(mid[:, 0] - p[0], mid[:, 1] - p[1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep.nonzero()[0]


def simplify(line: str, tolerance: float) -> Column:
    """The line without points that lie within `tolerance` degrees of the simplified one; inherently iterative, so an Arrow UDF."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        out = []
        for pts in lines:
            if pts is None or len(pts) < 3:
                out.append(None if pts is None else [dict(p) for p in pts])
                continue
            xy = np.array([[p["lon"], p["lat"]] for p in pts])
            out.append([dict(pts[i]) for i in _simplify(xy, tolerance)])
        return pd.Series(out)

    return run(F.col(line))


def delta_encode(line: str, scale: int = 10_000) -> Column:
    """array<long>: coordinates times `scale`, rounded half to even, the first as they are, then differences: x0, y0, dx1, dy1 ..."""
    return F.expr(
        f"""flatten(transform(sequence(1, size({line})), i -> array(
              cast(bround({line}[i - 1].lon * {scale}, 0) AS bigint) - CASE WHEN i > 1 THEN cast(bround({line}[i - 2].lon * {scale}, 0) AS bigint) ELSE 0L END,
              cast(bround({line}[i - 1].lat * {scale}, 0) AS bigint) - CASE WHEN i > 1 THEN cast(bround({line}[i - 2].lat * {scale}, 0) AS bigint) ELSE 0L END)))"""
    )


def delta_decode(deltas: str, scale: int = 10_000) -> Column:
    """The line back from delta_encode, to the precision of the scale; running sums by one fold."""
    return F.expr(
        f"""transform(aggregate(sequence(0, size({deltas}) div 2 - 1), cast(array() AS array<struct<x: bigint, y: bigint>>),
              (a, i) -> concat(a, array(struct({deltas}[2 * i] + coalesce(try_element_at(a, -1).x, 0L) AS x, {deltas}[2 * i + 1] + coalesce(try_element_at(a, -1).y, 0L) AS y)))),
              p -> struct(p.x / {scale}D AS lon, p.y / {scale}D AS lat))"""
    )


def ring_edges(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, a, b): the edges of each ring, closed, each as its lesser and greater corner."""
    e = rings.select(key, F.expr(f"explode(zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)), (p, q) -> struct(least(p, q) AS a, greatest(p, q) AS b)))").alias("e"))
    return e.select(key, "e.a", "e.b").filter("a <> b")


def boundary_edges(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(a, b): edges that occur once over all rings: the outline of their union."""
    return ring_edges(rings, key, ring).groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 1").select("a", "b")


def _chain(edges: list[tuple]) -> list[list[tuple]]:
    nexts: dict[tuple, list] = {}
    for a, b in edges:
        nexts.setdefault(a, []).append(b)
        nexts.setdefault(b, []).append(a)
    for v in nexts.values():
        v.sort(reverse=True)
    rings = []
    for start in sorted(nexts):
        while nexts[start]:
            ring, at = [start], start
            while nexts[at]:
                to = nexts[at].pop()
                nexts[to].remove(at)
                if to == start:
                    break
                ring.append(to)
                at = to
            if len(ring) > 2:
                rings.append(ring)
    return rings


def chain_rings(edges: DataFrame, group: str) -> DataFrame:
    """(group, ring_no, ring): undirected edges of each group joined end to end. A group is one outline, bounded by its drawing."""
    schema = T.StructType([T.StructField(group, edges.schema[group].dataType), T.StructField("ring_no", T.IntegerType()), T.StructField("ring", LINE)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        point = lambda p: (p["lon"], p["lat"])
        rings = _chain([(point(a), point(b)) for a, b in zip(pdf["a"], pdf["b"])])
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(rings), "ring_no": range(len(rings)), "ring": [[{"lon": x, "lat": y} for x, y in r] for r in rings]})

    return edges.groupBy(group).applyInPandas(run, schema)


def uncovered(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys of `wanted` that `have` lacks; a build with any is broken."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def road_class(name: str) -> Column:
    """Interstate, US route or state route, from a road's name; null for the rest."""
    n = F.trim(F.col(name))
    return F.when(n.startswith("I-"), "interstate").when(n.rlike(r"^U\.?S\.? "), "us").when(n.rlike("^(State|VA|SR) "), "state")


def water_name(name: str) -> Column:
    """Usual short forms in water names written out."""
    out = F.col(name)
    for short, full in (("Riv", "River"), ("Crk", "Creek"), ("Lk", "Lake"), ("Resv", "Reservoir"), ("Br", "Branch")):
        out = F.regexp_replace(out, rf"\b{short}\b\.?", full)
    return out


def tile(lat: str, lon: str, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile numbers (x, y) of a point."""
    n = float(2**zoom)
    x = F.floor((F.col(lon) + 180) / 360 * n)
    r = F.radians(F.col(lat))
    y = F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * n)
    return x.cast("long"), y.cast("long")


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Metres of a terrain pixel."""
    return r * 256.0 + g + b / 256.0 - 32768.0


def quantise(metres: Column, offset: float = 500.0, scale: float = 10.0) -> tuple[Column, Column]:
    """(high, low) byte of (metres + offset) * scale, rounded half to even and held to 16 bits."""
    v = F.least(F.greatest(F.bround((metres + offset) * scale, 0), F.lit(0.0)), F.lit(65535.0)).cast("int")
    return F.shiftright(v, 8), v.bitwiseAND(255)


def resample(pixels: DataFrame, columns: int, rows: int) -> DataFrame:
    """(row, col, value): the nearest pixel to the middle of each cell of a grid of `columns` by `rows` over the same frame.

    `pixels`: x, y (whole numbers from 0), value; they cover the frame evenly. The target grid is made by
    range and joined by equality on the pixel it falls on. Cells of missing pixels are left out.
    """
    spark = pixels.sparkSession
    per = pixels.agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    grid = spark.range(columns * rows).select((F.col("id") % columns).cast("int").alias("col"), F.floor(F.col("id") / columns).cast("int").alias("row"))
    g = grid.crossJoin(F.broadcast(per))  # one row
    at = lambda i, n, top: F.least(F.floor((F.col(i) + 0.5) / n * (F.col(top) + 1)), F.col(top)).cast("long")
    g = g.select("row", "col", at("col", columns, "mx").alias("x"), at("row", rows, "my").alias("y"))
    return g.join(pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value"), ["x", "y"]).select("row", "col", "value")
