"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

HOT_ROWS = 100_000
HOT_KEYS = 1_000


def split_join(big: DataFrame, table: DataFrame, on: list[str], n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of `big` with `table` (one row a key, `n` = rows of `big` with that key).

    Keys of more than max(hot_rows, total / HOT_KEYS) rows number at most HOT_KEYS; only
    those rows of `table` are broadcast, and the big rows of these keys are never shuffled.
    All other keys go through an ordinary join.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    limit = max(hot_rows, total / HOT_KEYS)
    if total <= limit:
        return big.join(table, on)
    hot = table.filter(F.col(n) > limit)
    # at most HOT_KEYS rows, by the limit above
    tagged = big.join(F.broadcast(hot.select(*on).withColumn("_hot", F.lit(True))), on, "left")
    return (
        tagged.filter("_hot").drop("_hot").join(F.broadcast(hot), on)
        .unionByName(tagged.filter("_hot IS NULL").drop("_hot").join(table.filter(F.col(n) <= limit), on))
    )


def running(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, how: str, inclusive: bool = True) -> DataFrame:
    """Running 'sum', 'max' or 'last' (not null) of `column` within `keys` by `order`, whatever share of the rows one key holds.

    Rows are range-partitioned by keys and order, so a hot key spans several partitions; each
    partition runs over its own rows, and what lies in a key's earlier partitions is carried in.
    Only keys that span partitions need that: fewer of them than partitions, so they are broadcast.
    Without a row before, the result is null. Rows that tie in `order` may stand in any order.
    """
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    tail = F.max(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v"))))["_v"] if how == "last" else over(column)
    tails = parts.groupBy("_part", *keys).agg(tail.alias("_tail"))
    before = over("_tail").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = cut(tails.withColumn("_ahead", before).filter("_ahead IS NOT NULL").drop("_tail"))
    on = F.col("p._part") == F.col("a._part")
    for k in keys:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"a.{k}"))
    joined = parts.withColumn("_own", over(column).over(w)).alias("p").join(F.broadcast(ahead).alias("a"), on, "left")
    own, carried = F.col("p._own"), F.col("a._ahead")
    value = {"sum": F.when(own.isNull(), carried).otherwise(own + F.coalesce(carried, F.lit(0))), "max": F.greatest(own, carried), "last": F.coalesce(own, carried)}[how]
    return joined.select(*[F.col(f"p.{c}") for c in df.columns if c != out], value.alias(out))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Rows numbered from 1 within `keys` by `order`, which must not tie."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", out, "sum").drop("_one")


BLOCK_ROWS = 20_000
BLOCK_SAMPLE = 1 / 64
Keys = str | Column | Callable[[DataFrame], DataFrame]


def block_join(left: DataFrame, right: DataFrame, l_id: str, r_id: str, l_keys: Keys = "keys", r_keys: Keys = "keys", block_rows: int = BLOCK_ROWS, share: float = BLOCK_SAMPLE) -> DataFrame:
    """(l_id, r_id) of every two rows whose arrays of keys share an element, once for each one they share.

    The keys are a column, an expression, or a function that adds the column `keys` to the frame.
    A key of more than `block_rows` rows on a side is spread over slices of that side, and the other
    side's rows are repeated for each slice, so no task gets a whole block. Which keys are such is
    judged from a sample of the rows, drawn before their keys are worked out (at most the HOT_KEYS most
    frequent of it reach the driver); the result does not depend on the sample. Null arrays and null elements meet nothing.
    """
    def each(d, i, keys):
        if callable(keys) and not isinstance(keys, Column):
            d, keys = keys(d), "keys"
        return d.select(F.col(i), F.explode(keys).alias("_key"))

    seen = each(left.sample(share, 7), l_id, l_keys).select("_key", F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    seen = seen.unionByName(each(right.sample(share, 7), r_id, r_keys).select("_key", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    most = seen.groupBy("_key").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).filter(F.greatest("_l", "_r") > block_rows * share)
    hot = [(k, -int(-n // (block_rows * share)) or 1, -int(-m // (block_rows * share)) or 1) for k, n, m in most.orderBy(F.desc(F.greatest("_l", "_r"))).limit(HOT_KEYS).collect()]
    a, b = each(left, l_id, l_keys), each(right, r_id, r_keys)
    if not hot:
        return a.join(b.hint("merge"), "_key").select(l_id, r_id)  # a frame's size says little of that of its keys, so none is broadcast
    slices = F.broadcast(left.sparkSession.createDataFrame(hot, f"_key {dict(a.dtypes)['_key']}, _ls long, _rs long"))  # at most HOT_KEYS rows

    def spread(d, i, own, other):
        d = d.join(slices, "_key", "left")
        d = d.withColumn(own, F.coalesce(F.pmod(F.xxhash64(i), F.col(f"{own}s")), F.lit(0)))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(f"{other}s"), F.lit(1)) - 1))).drop("_ls", "_rs")

    return spread(a, l_id, "_l", "_r").join(spread(b, r_id, "_r", "_l").hint("merge"), ["_key", "_l", "_r"]).select(l_id, r_id)
