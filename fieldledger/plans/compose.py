"""The whole state as named DataFrames, for batch and live use alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, progress, signals


def compose(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The state, each part computed on use only.

    registry (added entries included), visible, added, status, audit; taps, advancing, paid, points_by_stage, clusters,
    milestones, reviews, totals (one row: stages, milestones, reviews, points), rank (one row), history; signals, counters
    (what, value, n), recent, last_taps.
    """
    from . import logs

    changes = logs.changes(spark, d)
    registry = logs.registry_now(spark, d)
    known = logs.known(spark, d)
    taps = logs.taps(spark, d)
    advancing = progress.advancing_taps(taps)
    paid = progress.stage_points(advancing, known)
    events = logs.events(spark, d)
    met = logs.milestones_met(spark, d)
    found = logs.signals_now(spark, d)
    triaged = logs.triaged(spark, d, found)
    reviews = progress.review_points(logs.reviews(spark, d, found), found.filter("received IS NOT NULL").select("signal_id", "received"))

    total = lambda df: df.agg(F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("n"))
    totals = total(paid).withColumnRenamed("n", "stages").crossJoin(total(met).withColumnRenamed("n", "milestones")).crossJoin(total(reviews).withColumnRenamed("n", "reviews"))  # one row each
    totals = totals.withColumn("points", F.col("stages") + F.col("milestones") + F.col("reviews"))
    visible = registry.filter((F.col("scope") == "core") & (F.col("status") == "active"))
    tags = F.array(*[F.struct(F.lit(f"entities_by_{c}").alias("what"), F.col(c).cast("string").alias("value")) for c in ("kind", "status", "existence")])
    entries = registry.select(F.explode(tags).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))
    seen = visible.agg(F.count("*").alias("n")).select(F.lit("entities_visible").alias("what"), F.lit(None).cast("string").alias("value"), "n")
    return {
        "registry": registry,
        "visible": visible,
        "added": registry.filter("existence = 'ledger'"),
        "status": ledger.latest_status(changes),
        "audit": ledger.audit_trail(changes),
        "taps": taps,
        "advancing": advancing,
        "paid": paid,
        "points_by_stage": progress.points_by_stage(paid),
        "clusters": logs.cluster_rollup(spark, d),
        "milestones": met,
        "reviews": reviews,
        "totals": totals,
        "rank": progress.rank_of(totals, progress.rank_ladder(spark)),
        "history": progress.history(paid, met),
        "signals": signals.view(found, triaged, known.select("id"), logs.NOW),
        "counters": signals.counters(found, triaged, known.select("id")).unionByName(entries).unionByName(seen),
        "recent": signals.recent(events, 40),
        "last_taps": signals.last_undoable(events),
    }
