"""Applying a feed of inserts, updates and deletes, newest first.

The feed is cut into batches of instants and worked through backwards. In each batch the
newest change of a key is found (combined before the shuffle, so a key with very many changes
costs one row a task), keys already resolved by a newer batch are removed by an anti-join, and
what is left is final: its image, or its tombstone. Base rows that no change touched are
appended last. Order of arrival plays no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BATCHES = 4


def first_deliveries(feed: DataFrame, id_col: str, position: str) -> DataFrame:
    """One row a change id, the one at the first position. Changes without id or position are left out."""
    rest = [c for c in feed.columns if c != id_col]
    kept = feed.filter(F.col(id_col).isNotNull() & F.col(position).isNotNull())
    return kept.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_r")).select(id_col, "_r.*")


def resolve_newest_first(changes: DataFrame, keys: list[str], order: list[str], batches: int = BATCHES) -> DataFrame:
    """The last change of each key by `order`, whose first column is a number (the instant).

    Changes with a null in the instant take no effect; null keys are no key. With equal order
    values throughout, the greatest remaining columns win, so the result is one row a key always.
    `batches` changes the work, never the result.
    """
    at = order[0]
    live = changes.filter(F.col(at).isNotNull())
    for k in keys:
        live = live.filter(F.col(k).isNotNull())
    rest = [c for c in changes.columns if c not in keys]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    share = [i / batches for i in range(1, batches)]
    marks = live.agg(F.percentile_approx(at, share or [0.5], 1000)).first()[0]
    if marks is None:
        return changes.limit(0).select(*keys, *rest)
    marks = sorted(set(marks)) if batches > 1 else []
    edges = [None, *marks, None]
    resolved = None
    for low, high in reversed(list(zip(edges, edges[1:]))):
        batch = live
        if low is not None:
            batch = batch.filter(F.col(at) > F.lit(low))
        if high is not None:
            batch = batch.filter(F.col(at) <= F.lit(high))
        newest = batch.groupBy(*keys).agg(F.max(ordered).alias("_r"))
        if resolved is not None:
            newest = newest.join(resolved.select(*keys), keys, "left_anti")
        newest = cut(newest)
        resolved = newest if resolved is None else resolved.unionByName(newest)
    return resolved.select(*keys, "_r.*").select(*keys, *rest)


def apply_feed(base: DataFrame, feed: DataFrame, key: str, order: list[str], op: str, deletes: tuple[str, ...] = ("delete",), batches: int = BATCHES) -> DataFrame:
    """The table after the feed: full row images replace base rows, deletes remove them.

    `feed` has the columns of `base` plus `op` and those of `order`. Insert and update alike
    write the image; a delete of an unknown key does nothing. A repeated base key is kept once,
    as the row with the greatest columns.
    """
    last = resolve_newest_first(feed.select(*dict.fromkeys([key, *order, op, *base.columns])), [key], order, batches)
    images = last.filter(~F.col(op).isin(*deletes)).select(*base.columns)
    untouched = base.filter(F.col(key).isNotNull()).join(last.select(key), key, "left_anti")
    rest = [c for c in base.columns if c != key]
    untouched = untouched.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*base.columns)
    return images.unionByName(untouched)
