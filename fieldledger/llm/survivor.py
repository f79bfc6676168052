"""One surviving record for each group of duplicates.

`truth_discovery` is the iterative operator: a value's support is the sum of the weights of the
sources claiming it, a source's trust is the mean support its claims have from the other sources
(its own vote left out, or the strongest source would end as the only judge), and both are
estimated in turn until the trust settles. Only per-source sums (one row a source label) reach
the driver; the caller bounds their number with `max_sources`, beyond which it refuses.

`preferred_entry` is the declared-order operator: where trust in sources is given as ranks and
the preferred entry is fixed by (rank, date, id), no estimate may overrule it, so it takes the
least such key per group and field. It is a single combined aggregation, even under skew.

Nulls: a claim without group, source or value counts nowhere. Ties go to the greater number of
claims, then the greatest value by its text. Groups without a claim give no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

START_TRUST = 0.8
TOLERANCE = 1e-4
MAX_ROUNDS = 20
TRUST_RANGE = (0.05, 0.99)


def truth_discovery(claims: DataFrame, max_sources: int = 10_000, rounds: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Winner of each (group_id, field) from claims (group_id, field, source, value), and each source's trust.

    With `rounds` so many are run; else until the trust settles, MAX_ROUNDS at most.

    Claims are first counted by (group, field, value, source), so a hot group is combined before any shuffle.
    """
    c = claims.select("group_id", "field", "source", F.col("value").cast("string").alias("value")).dropna()
    c = cut(c.groupBy("group_id", "field", "value", "source").agg(F.count("*").alias("n")))
    sources = [r[0] for r in c.select("source").distinct().limit(max_sources + 1).collect()]
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    trust = dict.fromkeys(sources, START_TRUST)
    spark = claims.sparkSession

    def votes():
        w = spark.createDataFrame([(s, -math.log(1 - t)) for s, t in trust.items()] or [("", 0.0)], "source string, weight double")
        weighed = c.join(F.broadcast(w), "source")  # at most max_sources rows
        by = weighed.groupBy("group_id", "field", "value").agg(F.sum("weight").alias("support"), F.sum("n").alias("claims"))
        return weighed, by, by.groupBy("group_id", "field").agg(F.sum("support").alias("total"))

    def winners():
        _, by, totals = votes()
        best = F.max_by(F.struct("value", "support", "claims"), F.struct(F.bround("support", 9), F.col("claims"), F.col("value")))
        won = by.groupBy("group_id", "field").agg(best.alias("b")).join(totals, ["group_id", "field"])
        return won.select("group_id", "field", F.col("b.value").alias("value"), F.col("b.claims").alias("claims"), (F.col("b.support") / F.col("total")).alias("confidence"))

    for _ in range(MAX_ROUNDS if rounds is None else rounds):
        weighed, by, totals = votes()
        j = weighed.join(by.drop("claims"), ["group_id", "field", "value"]).join(totals, ["group_id", "field"])
        others = F.when(F.col("total") - F.col("weight") > 1e-9, (F.col("support") - F.col("weight")) / (F.col("total") - F.col("weight")))
        share = j.groupBy("source").agg(((F.coalesce(F.sum(others), F.lit(0.0)) + 2 * START_TRUST) / (F.count(others) + 2)).alias("t")).collect()
        fresh = {r[0]: min(max(r[1], TRUST_RANGE[0]), TRUST_RANGE[1]) for r in share}
        moved = max((abs(fresh[s] - trust[s]) for s in fresh), default=0.0)
        trust.update(fresh)
        if rounds is None and moved < TOLERANCE:
            break
    return winners(), trust


def preferred_entry(claims: DataFrame) -> DataFrame:
    """(group_id, field, entry, value): of each group and field the claim with least (rank, -day, entry).

    `claims` has group_id, field, entry, value, rank (int, null last) and day (date, null earliest).
    """
    key = F.struct(
        F.coalesce(F.col("rank"), F.lit(2**31 - 1)).alias("r"),
        (-F.coalesce(F.datediff("day", F.lit("1900-01-01").cast("date")), F.lit(-10_000_000))).alias("d"),
        F.col("entry").alias("e"),
    )
    kept = claims.filter("group_id IS NOT NULL AND field IS NOT NULL AND entry IS NOT NULL AND value IS NOT NULL")
    return kept.groupBy("group_id", "field").agg(F.min(F.struct(key.alias("k"), F.col("value").cast("string").alias("value"))).alias("m")).select(
        "group_id", "field", F.col("m.k.e").alias("entry"), F.col("m.value").alias("value")
    )
