"""Filling containers of fixed capacity with whole items: harmonic packing.

An item of size s belongs to class floor(capacity / s): of class j, any j items fit into one
container. Classes are filled independently, j items a container, and within a class in shards
of about SHARD_ROWS items, so no worker sees more than a shard and at most one container a
shard stays short. The classes of large items, whose containers keep the most room, are packed
first and topped up from the later classes: a room r takes one item of class ceil(capacity / r),
matched by number within class and shard. Items smaller than capacity / CLASSES are laid end to end
in their shards, each container taking those that begin and end inside it.

What classes and shards leave short is put together at the end: containers filled less than FULL are
emptied again and their items packed by best fit, the largest first, again in shards of at most
about SHARD_ROWS items, each one bounded group.

Items larger than the capacity are split into full containers and one rest, which is an item.
Items of size zero (null or empty texts) go with the smallest. Null ids are left out. Every
item is in exactly one container, and no container holds more than its capacity.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, free

CLASSES = 64
SHARD_ROWS = 50_000
FULL = 0.97
STAGES = [(1, 1), (2, 4), (5, 12)]  # classes packed, and their rooms topped up from the later ones, in turn


def _shards(*sides: DataFrame) -> DataFrame:
    """(cls, _shards): how many shards the larger of the sides needs in each class; one row a class, at most CLASSES + 1."""
    sizes = [s.groupBy("cls").agg(F.count("*").alias("_n")) for s in sides]
    both = sizes[0] if len(sizes) == 1 else sizes[0].unionByName(sizes[1])
    return F.broadcast(both.groupBy("cls").agg(F.ceil(F.max("_n") / SHARD_ROWS).cast("int").alias("_shards")))


def _numbered(rows: DataFrame, shards: DataFrame, order: list[str], size: str, seed: int) -> DataFrame:
    """Rows with `shard` and `number` (from 0, the largest first) within class and shard."""
    sharded = rows.join(shards, "cls").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), *order), F.col("_shards").cast("long")).cast("int")).drop("_shards")
    return sharded.withColumn("number", F.row_number().over(Window.partitionBy("cls", "shard").orderBy(F.desc(size), *order)) - 1)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece, size, container): `piece` counts the parts of a split item from 0."""
    base = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("total"))
    parts = base.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("long") - 1)))
    parts = parts.select("id", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("long").alias("size"))
    cls = F.when(F.col("size") * CLASSES < capacity, CLASSES).otherwise(F.least(F.lit(CLASSES - 1), F.floor(F.lit(capacity) / F.col("size")))).cast("int")
    parts = cut(parts.withColumn("cls", cls))

    placed, rest, made = [], parts, []
    for turn, (low, high) in enumerate(STAGES):
        mine = rest.filter(F.col("cls").between(low, high))
        own = cut(_bins(_numbered(mine, _shards(mine), ["id", "piece"], "size", turn)).select("id", "piece", "size", "container"))
        placed.append(own)
        made.append(own)
        room = own.groupBy("container").agg((F.lit(capacity) - F.sum("size")).alias("room"))
        # a room of at least capacity / k takes any item of class k or above; class k holds the largest that surely fit
        wants = room.filter(F.col("room") * (CLASSES - 1) >= capacity).withColumn("cls", F.ceil(F.lit(capacity) / F.col("room")).cast("int")).filter(f"cls < {CLASSES}")
        later = rest.filter(F.col("cls") > high)
        shards = _shards(later, wants)
        gifts, wants = _numbered(later, shards, ["id", "piece"], "size", turn), _numbered(wants, shards, ["container"], "room", turn)
        # both sides numbered in one table: an item without a room of its number stays for the next stage
        matched = cut(gifts.join(wants.select("cls", "shard", "number", "container"), ["cls", "shard", "number"], "left").select("id", "piece", "size", "cls", "container"))
        made.append(matched)
        placed.append(matched.filter("container IS NOT NULL").select("id", "piece", "size", "container"))
        rest = matched.filter("container IS NULL").drop("container")
    numbered = _numbered(rest, _shards(rest), ["id", "piece"], "size", len(STAGES))
    filled = _bins(numbered.filter(f"cls < {CLASSES}"))
    # the smallest, end to end: an item that would cross a container's end opens the next one; a stretch
    # of capacity less the largest small item keeps every container within its capacity
    stretch = capacity - capacity // CLASSES
    ahead = F.sum("size").over(Window.partitionBy("cls", "shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    small = _named(numbered.filter(f"cls = {CLASSES}").withColumn("bin", F.floor(F.coalesce(ahead, F.lit(0)) / F.lit(stretch))))
    placed += [x.select("id", "piece", "size", "container") for x in (filled, small)]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    whole = cut(out)
    free(parts, *made)
    return _without_short(whole, capacity)


def _without_short(out: DataFrame, capacity: int) -> DataFrame:
    """The packing with the items of containers filled less than FULL packed anew by best fit."""
    short = out.groupBy("container").agg(F.sum("size").alias("used")).filter(F.col("used") < capacity * FULL).select("container")
    items = cut(out.join(short, "container", "left_semi").select("id", "piece", "size"))
    shards = -(-items.count() // SHARD_ROWS)
    if not shards:
        return out
    fits = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(99), "id", "piece"), F.lit(shards)).cast("int"))

    def best_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True])
        rooms, names = [], []  # rooms of open containers in rising order, and whose they are
        said, opened = [], 0
        for size in pdf["size"]:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room, name = capacity, opened
                opened += 1
            else:
                room, name = rooms.pop(at), names.pop(at)
            said.append(name)
            left = room - size
            at = bisect.bisect_left(rooms, left)
            rooms.insert(at, left)
            names.insert(at, name)
        return pdf.assign(container=[f"s-{s}-{n}" for s, n in zip(pdf["shard"], said)])[["id", "piece", "size", "container"]]

    kind = dict(out.dtypes)
    again = fits.groupBy("shard").applyInPandas(best_fit, f"id {kind['id']}, piece {kind['piece']}, size {kind['size']}, container string")
    return out.join(short, "container", "left_anti").select("id", "piece", "size", "container").unionByName(again)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("container", F.concat_ws("-", F.lit("c"), F.col("cls").cast("string"), F.col("shard").cast("string"), F.col("bin").cast("string")))


def _bins(numbered: DataFrame) -> DataFrame:
    """A class's items, as many to a container as its number."""
    return _named(numbered.withColumn("bin", F.floor(F.col("number") / F.col("cls"))))
