"""Graphs without driver loops over rows: pointer forests followed by doubling, groups of a graph by contraction."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import HOT_ROWS, split_join
from ..session import cut, cut_counted, free


def follow(pointers: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root, depth, looped) of every id with a pointer `a` -> `b`.

    Each round doubles the stretch walked, so a chain of length n takes log2(n) rounds. An id
    that leads into a loop has a null root and looped = true. Pointers to null are left out; of
    several pointers of one id the least counts. An id pointing at itself is a loop.
    """
    step = pointers.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("id")).agg(F.min(b).alias("to"))
    step = cut(step.withColumn("depth", F.lit(1).cast("long")))
    total = step.count()
    rounds = math.ceil(math.log2(total + 1)) + 1 if total else 0
    for _ in range(rounds):
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        walked = step.join(ahead, "to", "left")
        step = cut(walked.select("id", F.coalesce("next", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if not step.filter("moved").limit(1).count():
            break
        step = step.drop("moved")
    # whoever still stands on an id with a pointer goes round in a loop
    still = step.select("id").withColumnRenamed("id", "to").withColumn("_in", F.lit(True))
    out = step.join(still, "to", "left")
    looped = F.coalesce("_in", F.lit(False))
    return out.select("id", F.when(~looped, F.col("to")).alias("root"), F.when(~looped, F.col("depth")).alias("depth"), looped.alias("looped"))


CUT_EVERY = 4  # rounds expanded in one plan
MAX_ROUNDS = 200  # far beyond what 10^18 edges would take; a guard, not a cap on results
LOCAL_IDS = 250_000  # vertices that a task holds at a time


def components(pairs: DataFrame, a: str, b: str, seed: int = 7, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, group_id) of every id in a pair; group_id is the least id of its group.

    Each round draws a fresh hash order. A task first joins the edges of its own partition into local groups,
    LOCAL_IDS vertices at a time; a vertex hooks to the first, in that order, of the vertices that come first
    in its local groups. Edges are relabelled by these hooks, loops and repeats removed, and the round's hooks
    kept. Once the edges left fit one partition, one round ends it. Then the hooks are followed from the first round to the last.

    Relabelling broadcasts the hooks of at most HOT_KEYS vertices with more than `hot_rows` edges (split_join).
    Nulls and loops make no edge. Repeated edges count once. Ids keep their type. Empty in, empty out.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    # the round is a column, not a literal, so that every round runs the same compiled code
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("turn", F.lit(seed)))
    kind = edges.schema["u"].dataType
    local = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("to", kind), T.StructField("n", T.LongType())])
    hooks = []
    for _ in range(MAX_ROUNDS):
        drawn = edges.select("u", "v", F.xxhash64("turn", "u").alias("hu"), F.xxhash64("turn", "v").alias("hv"))
        hook = drawn.mapInArrow(_local_groups(LOCAL_IDS), local).groupBy("id").agg(F.min(F.struct("h", "to")).alias("near"), F.sum("n").alias("n"))
        hook, seen = cut_counted(hook.select("id", F.col("near.to").alias("to"), "n"), most=F.coalesce(F.max("n"), F.lit(0)))
        if not seen["most"]:
            break
        hooks.append(hook)
        even = seen["most"] <= hot_rows
        fresh = _relabel(_relabel(edges, hook, "u", even, hot_rows), hook, "v", even, hot_rows)
        fresh = fresh.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("turn") + 1).alias("turn")).distinct()
        fresh, seen = cut_counted(fresh, left=F.count(F.lit(1)))
        free(edges)
        edges = fresh
        if not seen["left"]:
            break
    else:
        raise RuntimeError("contraction did not end")
    if not hooks:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    # expand backwards: the last round's hooks end at their targets; an earlier round's hook leads to
    # a vertex that moved on in a later round, or stayed. The later side has one row a vertex; a hot
    # target makes only the outer side uneven, which the adaptive skew join splits.
    final = hooks[-1].select("id", "to")
    for k, hook in enumerate(reversed(hooks[:-1])):
        on = final.select(F.col("id").alias("to"), F.col("to").alias("end"))
        final = hook.join(on, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
        if k % CUT_EVERY == CUT_EVERY - 1:
            final = cut(final)
    final = cut(final)
    free(*hooks)
    least = final.groupBy("to").agg(F.least(F.min("id"), F.first("to")).alias("group_id"), F.count("*").alias("n"))
    return split_join(final, least, ["to"], "n", hot_rows).select("id", "group_id")


def _local_groups(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From edges (u, v, hu, hv) of a partition: (id, h, to, n), each vertex with the first by hash of its local group and its number of edges."""

    def run(batches):
        over, drawn, edges, kind = {}, {}, {}, None

        def find(x):
            top = x
            while over[top] != top:
                top = over[top]
            while over[x] != top:
                over[x], x = top, over[x]
            return top

        def found():
            ids = list(over)
            tops = [find(x) for x in ids]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array([drawn[x] for x in tops], pa.int64()), pa.array(tops, kind), pa.array([edges[x] for x in ids], pa.int64())],
                ["id", "h", "to", "n"],
            )

        for batch in batches:
            kind = batch.schema.field("u").type
            for u, v, hu, hv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "hu", "hv"))):
                for x, h in ((u, hu), (v, hv)):
                    if x not in over:
                        over[x], drawn[x], edges[x] = x, h, 0
                    edges[x] += 1
                x, y = find(u), find(v)
                if x != y:
                    if (drawn[y], y) < (drawn[x], x):
                        x, y = y, x
                    over[y] = x
            if len(over) >= most:
                yield found()
                over, drawn, edges = {}, {}, {}
        if over:
            yield found()

    return run


def _relabel(edges: DataFrame, hook: DataFrame, end: str, even: bool, hot_rows: int) -> DataFrame:
    to = hook.select(F.col("id").alias(end), F.col("to").alias("_to"), "n")
    joined = edges.join(to, end) if even else split_join(edges, to, [end], "n", hot_rows)
    return joined.drop(end, "n").withColumnRenamed("_to", end)
