"""Dual-tree spatial joins: points near points, and regions containing points.

Both sides are held as quadtrees whose nodes are rows (key, tight bounding box, row count), two
levels of the grid apart, so a node has at most sixteen children. A frontier of node pairs starts
at the two roots. Each round joins the frontier with the children of its own level only, on both
sides, and sorts the new pairs into
  discarded  no point of one box can be near the other box,
  certain    every point of one box is near every point of the other: taken wholesale,
  leaf       both nodes are leaves, but the boxes do not decide: points are compared,
  open       carried into the next round.
Pairs carry their boxes, so a leaf waiting for the other side to come down joins nothing. Each side
has a grid of its own, since only boxes are compared. Nodes, pairs and points are DataFrames all
along; only extremes and counts reach the driver. A round's open pairs are freed once the next
round is written.

Nulls: a point without id, latitude or longitude (or with NaN) matches nothing.
Repeated points give repeated results unless the caller removes them. Empty inputs give
an empty result. Other columns of the inputs are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import MILES_PER_DEGREE, SITE_LATITUDE, in_ring, lon_miles, ring_meets_box
from ..functions.skew import split_join
from ..session import cut, cut_counted, free

LEAF_ROWS = 64  # a node of at most so many points is not split
STEP = 2  # levels of the grid between a node and its children
MAX_DEPTH = 14
SMALL_LEVEL = 6  # levels above hold at most 4^6 nodes, few enough to broadcast
SLICE_ROWS = 20_000  # a leaf of more points (all close together) is compared in slices
SLACK = 1e-9  # miles left to rounding when boxes decide

BOX = ["lo_lat", "lo_lon", "hi_lat", "hi_lon"]


def _extremes() -> dict:
    return {"n": F.count(F.lit(1)), "lo_lat": F.min("lat"), "lo_lon": F.min("lon"), "hi_lat": F.max("lat"), "hi_lon": F.max("lon")}


def _clean(df: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    finite = (F.abs(F.col(lat)) <= 180) & (F.abs(F.col(lon)) <= 360)
    return df.filter(F.col(id_col).isNotNull() & finite).select(
        F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")
    )


def _key(level, x, y):
    """One long for (level, x, y); 29 bits a coordinate."""
    return F.shiftleft(level.cast("long"), 58).bitwiseOR(F.shiftleft(x.cast("long"), 29)).bitwiseOR(y.cast("long"))


def _above(level: str, x: str, y: str, at: str):
    """Key of the node at level `at` that holds node (level, x, y)."""
    return _key(F.col(at), F.expr(f"shiftright({x}, {level} - {at})"), F.expr(f"shiftright({y}, {level} - {at})"))


class Grid:
    """The square over one side's points and the depth its tree may reach; `n` is 0 for an empty side."""

    def __init__(self, seen: dict, box: tuple | None = None):
        """`seen`: _extremes of the side's points; `box`: what the side covers, if more than its points."""
        self.n, self.box = seen["n"], box or tuple(seen[c] for c in BOX)
        if self.n:
            self.lo_lat, self.lo_lon = seen["lo_lat"], seen["lo_lon"]
            self.span = max(seen["hi_lat"] - self.lo_lat, seen["hi_lon"] - self.lo_lon, 1e-6) * (1 + 1e-9)
            deep = math.ceil(math.log(max(self.n / LEAF_ROWS, 1), 4)) + 4
            self.depth = min(MAX_DEPTH, math.ceil(deep / STEP) * STEP)

    def with_cell(self, df: DataFrame) -> DataFrame:
        at = lambda c, lo: F.floor((F.col(c) - F.lit(lo)) / F.lit(self.span) * F.lit(float(2**self.depth))).cast("long")
        return df.withColumn("cx", at("lon", self.lo_lon)).withColumn("cy", at("lat", self.lo_lat))


class Tree:
    """A quadtree as rows. `steps`: each node but the root under its parent `at` of level `at_level`."""

    def __init__(self, cells: DataFrame, grid: Grid, leaf_rows: int):
        self.depth, self.grid, self.root_leaf = grid.depth, grid, grid.n <= leaf_rows
        nodes = (
            cells.withColumn("level", F.explode(F.sequence(F.lit(STEP), F.lit(self.depth), F.lit(STEP))))
            .withColumn("x", F.expr(f"shiftright(cx, {self.depth} - level)"))
            .withColumn("y", F.expr(f"shiftright(cy, {self.depth} - level)"))
            .groupBy("level", "x", "y")
            .agg(
                F.sum("n").alias("n"), F.min("lo_lat").alias("lo_lat"), F.min("lo_lon").alias("lo_lon"),
                F.max("hi_lat").alias("hi_lat"), F.max("hi_lon").alias("hi_lon"),
            )
            .withColumn("at_level", F.col("level") - STEP)
            .withColumn("at", _above("level", "x", "y", "at_level"))
            .withColumn("key", _key(F.col("level"), F.col("x"), F.col("y")))
            .withColumn("leaf", (F.col("n") <= leaf_rows) | (F.col("level") == self.depth))
            # at most sixteen rows a window; a parent of few rows is a leaf, and what is under it no node
            .withColumn("whole", F.sum("n").over(Window.partitionBy("at")))
            .filter(F.col("whole") > leaf_rows)
        )
        self.steps = cut(nodes.select("at_level", "at", "key", "leaf", "n", *BOX, "level", "x", "y"))

    def leaves(self) -> DataFrame:
        """(leaf_key, level, x, y, n)"""
        below = self.steps.filter("leaf").select(F.col("key").alias("leaf_key"), "level", "x", "y", "n")
        if not self.root_leaf:
            return below
        return self.steps.sparkSession.createDataFrame([(0, 0, 0, 0, self.grid.n)], "leaf_key long, level int, x long, y long, n long")

    def under(self) -> DataFrame:
        """(node, leaf): each leaf below each node, itself included."""
        up = self.leaves().withColumn("l", F.explode(F.sequence(F.lit(0), F.col("level"), F.lit(STEP))))
        return up.select(_above("level", "x", "y", "l").alias("node"), "leaf_key")

    def homes(self, cells: DataFrame) -> DataFrame:
        """Cells (cx, cy, ...) with `leaf_key` and the leaf's rows `leaf_n`."""
        up = cells.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(self.depth), F.lit(STEP)))).withColumn("d", F.lit(self.depth))
        up = up.withColumn("leaf_key", _above("d", "cx", "cy", "l")).drop("l", "d")
        return up.join(self.leaves().select("leaf_key", F.col("n").alias("leaf_n")), "leaf_key")

    def place(self, points: DataFrame, cells: DataFrame) -> DataFrame:
        """Points with `leaf_key` and `slice`; a leaf of many points is spread over slices."""
        where = self.homes(cells.select("cx", "cy", "n")).select("cx", "cy", "n", "leaf_key", F.ceil(F.col("leaf_n") / SLICE_ROWS).cast("int").alias("slices"))
        return (
            split_join(points, cut(where), ["cx", "cy"], "n")
            .withColumn("slice", F.pmod(F.xxhash64("id", "lat", "lon"), F.col("slices").cast("long")).cast("int"))
            .drop("cx", "cy", "n", "slices")
        )

    def sliced(self, pairs: DataFrame, key: str, out: str) -> DataFrame:
        """Each pair once for every slice of the leaf in `key`."""
        s = self.leaves().select(F.col("leaf_key").alias(key), F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"))
        return pairs.join(s, key).withColumn(out, F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")


class PointIndex:
    """Points with their grid, cells and tree, for several joins against one set of points."""

    def __init__(self, points: DataFrame, id_col: str, lat: str = "lat", lon: str = "lon"):
        # read for the grid, the cells and the result
        p, seen = cut_counted(_clean(points, id_col, lat, lon), **_extremes())
        self.grid = Grid(seen)
        self.empty = self.grid.n == 0
        self.ids = p.select(F.col("id").alias("l_id"))
        if not self.empty:
            self.points = self.grid.with_cell(p)
            self.cells = cut(_cells(self.points))
            self.tree = Tree(self.cells, self.grid, LEAF_ROWS)
            self._placed = None

    def placed(self) -> DataFrame:
        if self._placed is None:
            self._placed = self.tree.place(self.points, self.cells)
        return self._placed


def _cells(points: DataFrame) -> DataFrame:
    """Points counted by finest cell before anything is shuffled by place."""
    return points.groupBy("cx", "cy").agg(
        F.count("*").alias("n"), F.min("lat").alias("lo_lat"), F.min("lon").alias("lo_lon"),
        F.max("lat").alias("hi_lat"), F.max("lon").alias("hi_lon"),
    )


def _descend(a: PointIndex, b_steps: DataFrame, b_grid: Grid, b_leaf: bool, rounds: int, classify, ring=None) -> list[DataFrame]:
    """All decided pairs (a_key, b_key, verdict) with verdict 'certain' or 'leaf', one frame a round.

    `b_steps` has at_level, at, key, leaf, the box, and with `ring` a type for it, a ring (null but for regions).
    """
    spark = b_steps.sparkSession
    node = ["key", "leaf", *BOX]
    kind = {"key": "long", "leaf": "boolean", **dict.fromkeys(BOX, "double")}
    row = (0, a.tree.root_leaf, *a.grid.box, 0, b_leaf, *b_grid.box)
    frontier = spark.createDataFrame([row], ", ".join(f"{s}_{c} {kind[c]}" for s in "ab" for c in node))
    cols = {"a": node, "b": node}
    if ring:
        frontier, cols["b"] = frontier.withColumn("b_ring", F.lit(None).cast(ring)), [*node, "ring"]
    decided, before = [], None
    for turn in range(rounds):
        pairs = frontier
        for s, steps in (("a", a.tree.steps), ("b", b_steps)):
            # a node of this round's level comes down to its children; a leaf finds none and stays
            down = steps.filter(F.col("at_level") == turn * STEP).select(F.col("at").alias(f"{s}_key"), *[F.col(c).alias(f"n_{c}") for c in cols[s]])
            if turn * STEP < SMALL_LEVEL and not (s == "b" and ring):
                down = F.broadcast(down)  # at most 4^SMALL_LEVEL nodes
            other = [F.col(f"{o}_{c}") for o in "ab" if o != s for c in cols[o]]
            stays = F.col("n_key").isNull()
            pairs = pairs.join(down, f"{s}_key", "left").select(*other, *[F.when(stays, F.col(f"{s}_{c}")).otherwise(F.col(f"n_{c}")).alias(f"{s}_{c}") for c in cols[s]])
        pairs = pairs.withColumn("verdict", classify()).filter("verdict <> 'none'")
        pairs, n = cut_counted(pairs, open=F.count_if(F.col("verdict") == "open"), done=F.count_if(F.col("verdict") != "open"))
        free(before)
        if n["done"]:
            decided.append(pairs.filter("verdict <> 'open'").select("a_key", "b_key", "verdict"))
        if not n["open"]:
            break
        before = None if n["done"] else pairs
        frontier = pairs.filter("verdict = 'open'").drop("verdict")
    return decided


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def within_distance(
    left: DataFrame | PointIndex, right: DataFrame, radius: float, left_id: str, right_id: str,
    left_xy: tuple[str, str] = ("lat", "lon"), right_xy: tuple[str, str] = ("lat", "lon"), at: float = SITE_LATITUDE,
) -> DataFrame:
    """(left_id, right_id) of every pair of points at most `radius` miles apart, as `l_id`, `r_id`."""
    p = left if isinstance(left, PointIndex) else PointIndex(left, left_id, *left_xy)
    q = PointIndex(right, right_id, *right_xy)
    none = p.ids.limit(0).crossJoin(q.ids.withColumnRenamed("l_id", "r_id").limit(0))
    if p.empty or q.empty:
        return none
    a, b = p.tree, q.tree
    kx, ky = lon_miles(at), MILES_PER_DEGREE

    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"))
    reach = lambda lo, hi: F.greatest(F.col(f"a_{hi}") - F.col(f"b_{lo}"), F.col(f"b_{hi}") - F.col(f"a_{lo}"))

    def classify():
        nearest = F.hypot(gap("lo_lat", "hi_lat") * ky, gap("lo_lon", "hi_lon") * kx)
        farthest = F.hypot(reach("lo_lat", "hi_lat") * ky, reach("lo_lon", "hi_lon") * kx)
        return (
            F.when(nearest > radius + SLACK, "none")
            .when(farthest < radius - SLACK, "certain")
            .when(F.col("a_leaf") & F.col("b_leaf"), "leaf")
            .otherwise("open")
        )

    decided = _descend(p, b.steps, q.grid, b.root_leaf, max(a.depth, b.depth) // STEP + 1, classify)
    if not decided:
        return none
    # certain pairs of inner nodes are spread to the leaves below them, without comparing anything
    pairs = (
        _union(decided).join(a.under().select(F.col("node").alias("a_key"), F.col("leaf_key").alias("a_leaf")), "a_key")
        .join(b.under().select(F.col("node").alias("b_key"), F.col("leaf_key").alias("b_leaf")), "b_key")
        .select("a_leaf", "b_leaf", (F.col("verdict") == "certain").alias("certain"))
    )
    pairs = b.sliced(a.sliced(pairs, "a_leaf", "a_slice").withColumnRenamed("b_leaf", "key_b"), "key_b", "b_slice")
    pl = p.placed().select(F.col("leaf_key").alias("a_leaf"), F.col("slice").alias("a_slice"), F.col("id").alias("l_id"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    ql = q.placed().select(F.col("leaf_key").alias("key_b"), F.col("slice").alias("b_slice"), F.col("id").alias("r_id"), F.col("lat").alias("ra"), F.col("lon").alias("ro"))
    near = F.hypot((F.col("la") - F.col("ra")) * ky, (F.col("lo") - F.col("ro")) * ky * F.cos(F.radians(F.lit(at)))) <= radius
    return (
        pairs.join(ql, ["key_b", "b_slice"]).join(pl, ["a_leaf", "a_slice"])
        .filter(F.col("certain") | near)
        .select("l_id", "r_id")
    )


def within_region(
    points: DataFrame | PointIndex, regions: DataFrame, point_id: str, region_id: str, ring: str = "ring",
    xy: tuple[str, str] = ("lat", "lon"),
) -> DataFrame:
    """(l_id, r_id) of every point and every region whose ring encloses it.

    The region side is a tree over the rings' boxes with the regions as its last level, so a
    whole point node is taken or refused at once when no edge of the ring comes near its box.
    A ring that is null, shorter than three points or has a null coordinate encloses nothing.
    """
    p = points if isinstance(points, PointIndex) else PointIndex(points, point_id, *xy)
    whole = F.expr(f"size({ring}) > 2 AND NOT exists({ring}, v -> v.lat IS NULL OR v.lon IS NULL)")
    r = regions.filter(F.col(region_id).isNotNull() & whole).select(
        F.col(region_id).alias("id"), F.col(ring).alias("ring"),
        F.expr(f"array_min(transform({ring}, v -> v.lat))").alias("lo_lat"), F.expr(f"array_min(transform({ring}, v -> v.lon))").alias("lo_lon"),
        F.expr(f"array_max(transform({ring}, v -> v.lat))").alias("hi_lat"), F.expr(f"array_max(transform({ring}, v -> v.lon))").alias("hi_lon"),
    )
    r = r.withColumn("lat", F.expr("(lo_lat + hi_lat) / 2")).withColumn("lon", F.expr("(lo_lon + hi_lon) / 2"))
    none = p.ids.limit(0).crossJoin(r.select(F.col("id").alias("r_id")).limit(0))
    # regions are numbered below zero; the cut makes the numbers stay
    r, seen = cut_counted(r.withColumn("key", -1 - F.monotonically_increasing_id()), **_extremes(), **{f"box_{c}": (F.min if c[:2] == "lo" else F.max)(c) for c in BOX})
    grid = Grid(seen, tuple(seen[f"box_{c}"] for c in BOX))
    if p.empty or not grid.n:
        return none
    r = grid.with_cell(r)
    rc = cut(r.groupBy("cx", "cy").agg(F.count("*").alias("n"), *[(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in BOX]))
    a, b = p.tree, Tree(rc, grid, 1)
    # below each leaf of the region tree stand its regions, which then stay
    homes = b.homes(rc.select("cx", "cy")).select("cx", "cy", F.col("leaf_key").alias("at"), F.expr("cast(shiftrightunsigned(leaf_key, 58) AS int)").alias("at_level"))
    kind = dict(r.dtypes)["ring"]
    cols = ["at_level", "at", "key", "leaf", *BOX, "ring"]
    inner = b.steps.withColumn("leaf", F.lit(False)).withColumn("ring", F.lit(None).cast(kind)).select(cols)
    steps = cut(inner.unionByName(r.withColumn("leaf", F.lit(True)).join(homes, ["cx", "cy"]).select(cols)))

    def classify():
        apart = F.expr("a_lo_lat > b_hi_lat OR b_lo_lat > a_hi_lat OR a_lo_lon > b_hi_lon OR b_lo_lon > a_hi_lon")
        clear = ~ring_meets_box("b_ring", "a_lo_lat", "a_lo_lon", "a_hi_lat", "a_hi_lon")
        inside = in_ring("b_ring", "((a_lo_lat + a_hi_lat) / 2)", "((a_lo_lon + a_hi_lon) / 2)")
        is_region = F.col("b_ring").isNotNull()
        return (
            F.when(apart, "none")
            .when(is_region & clear & inside, "certain")
            .when(is_region & clear, "none")
            .when(F.col("a_leaf") & F.col("b_leaf"), "leaf")
            .otherwise("open")
        )

    decided = _descend(p, steps, grid, False, max(a.depth, b.depth) // STEP + 2, classify, kind)
    if not decided:
        return none
    pairs = _union(decided).join(a.under().select(F.col("node").alias("a_key"), F.col("leaf_key").alias("a_leaf")), "a_key")
    pairs = a.sliced(pairs.select("a_leaf", F.col("b_key").alias("key"), (F.col("verdict") == "certain").alias("certain")), "a_leaf", "a_slice")
    pl = p.placed().select(F.col("leaf_key").alias("a_leaf"), F.col("slice").alias("a_slice"), F.col("id").alias("l_id"), "lat", "lon")
    return (
        pairs.join(r.select("key", F.col("id").alias("r_id"), "ring"), "key").join(pl, ["a_leaf", "a_slice"])
        .filter(F.col("certain") | in_ring("ring", "lat", "lon"))
        .select("l_id", "r_id")
    )
