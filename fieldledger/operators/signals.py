"""Signals: seeding from the registry, freshness, triage, views and counters.

`now` is always a parameter (micros since 1970). Nulls: a signal without time of receipt is not
fresh; triage rows without signal or instant count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the signal layer
SEED_TIMINGS = {"proposed": "announced", "construction": "construction", "expansion": "construction", "hold": "on_hold"}
SEED_KINDS = {"proposed": "project_status", "construction": "project_status", "expansion": "expansion", "hold": "project_status"}
FRESH_SOURCES = ["public_web", "trade_press", "government_record", "enterprise_db", "manual"]
BRIGHT_HOURS, FADE_DAYS = 72, 7
SPEC_WINDOW = ["announced", "design", "permitting"]


def seed(entities: DataFrame) -> DataFrame:
    """A signal for each core entity whose timing says that something is going on, with the contract's kind, match and origin; the id is the same every time.

    `entities`: id, name, scope, timing_k, timing_label. Repeated ids give one signal.
    """
    stage, kind = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (SEED_TIMINGS, SEED_KINDS))
    kept = entities.filter((F.col("scope") == "core") & F.col("timing_k").isin(*SEED_TIMINGS) & F.col("id").isNotNull())
    return kept.select(
        F.concat_ws("-", F.lit("sig-snap"), "id", "timing_k").alias("signal_id"), F.col("id").alias("entity_id"), F.lit("registry_snapshot").alias("source_type"),
        F.try_element_at(stage, "timing_k").alias("stage"), F.try_element_at(kind, "timing_k").alias("kind"), F.lit("exact_id").alias("match_method"), F.lit("high").alias("match_confidence"), F.lit("rule").alias("generated_by"), F.substring(F.concat_ws(": ", "name", "timing_label"), 1, 200).alias("headline"),
    ).distinct()


def append_new(existing: DataFrame, fresh: DataFrame, key: str = "signal_id") -> DataFrame:
    """Rows of `fresh` whose id is not there yet: appending them again changes nothing."""
    return fresh.join(existing.select(key), key, "left_anti")


def freshness(received: Column, source_type: Column, now: int) -> Column:
    """1 up to 72 hours (or in the future), falling straight to 0 at seven days, 3 places; 0 for snapshots."""
    hours = (F.lit(now // 1_000_000) - F.floor(received / 1_000_000)) / 3600
    fade = FADE_DAYS * 24
    v = F.when(hours <= BRIGHT_HOURS, 1.0).when(hours >= fade, 0.0).otherwise(F.bround(1 - (hours - BRIGHT_HOURS) / (fade - BRIGHT_HOURS), 3))
    return F.when(source_type.isin(FRESH_SOURCES), F.coalesce(v, F.lit(0.0))).otherwise(0.0)


def triage(actions: DataFrame) -> DataFrame:
    """(signal_id, status): the last triage action of each signal, without its prefix. `actions`: signal_id, action, instant, ord."""
    kept = actions.filter(F.col("action").startswith("signal_") & F.col("signal_id").isNotNull() & F.col("instant").isNotNull())
    last = kept.groupBy("signal_id").agg(F.max(F.struct("instant", "ord", "action")).alias("r"))
    return last.select("signal_id", F.regexp_replace("r.action", "^signal_", "").alias("status"))


def view(signals: DataFrame, triaged: DataFrame, known: DataFrame, now: int) -> DataFrame:
    """Signals with status, freshness and window; those of unknown entities are left out, those of none stay."""
    ids = known.select(F.col("id").alias("entity_id")).distinct()
    placed = signals.filter("entity_id IS NOT NULL").join(ids, "entity_id", "left_semi").unionByName(signals.filter("entity_id IS NULL"))
    return placed.join(triaged, "signal_id", "left").select(
        "signal_id", "entity_id", F.coalesce("status", F.lit("new")).alias("status"), freshness(F.col("received"), F.col("source_type"), now).alias("freshness"),
        F.coalesce(F.col("stage").isin(SPEC_WINDOW), F.lit(False)).alias("spec_window"),
    )


def of_active(signals: DataFrame, registry: DataFrame) -> DataFrame:
    """Signals to notify of: those of entries that are active, and those of none. `registry`: id, status."""
    retired = registry.filter("status <> 'active'").select(F.col("id").alias("entity_id")).distinct()
    return signals.join(retired, "entity_id", "left_anti")


def decluttered(entries: DataFrame, touched: DataFrame) -> DataFrame:
    """Entries without those of low opportunity that nobody has tapped. `entries`: id, band; `touched`: entity_id. Unrated entries stay."""
    low = F.coalesce(F.col("band") == "Low", F.lit(False))
    seen = touched.select(F.col("entity_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    return entries.join(seen, "id", "left").filter(~low | F.col("_seen")).drop("_seen")


def orphans(signals: DataFrame, known: DataFrame) -> DataFrame:
    """Signals that name an entity nobody knows."""
    return signals.filter("entity_id IS NOT NULL").join(known.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")


def counters(signals: DataFrame, triaged: DataFrame, known: DataFrame) -> DataFrame:
    """(what, value, n): signals by source type, kind, generator and triage status, and those unplaced or orphaned; in one pass over the signals.

    `signals`: signal_id, entity_id, source_type, kind, generated_by. Nulls are counted under null.
    """
    ids = known.select(F.col("id").alias("entity_id")).distinct().withColumn("_known", F.lit(True))
    s = signals.join(triaged, "signal_id", "left").join(ids, "entity_id", "left")
    where = F.when(F.col("entity_id").isNull(), "unplaced").when(F.col("_known").isNull(), "orphaned").otherwise("placed")
    each = F.array(*[F.struct(F.lit(n).alias("what"), v.cast("string").alias("value")) for n, v in {
        "signals_by_source": F.col("source_type"), "signals_by_kind": F.col("kind"), "signals_by_generator": F.col("generated_by"), "signals_by_status": F.coalesce("status", F.lit("new")), "signals_by_place": where,
    }.items()])
    return s.select(F.explode(each).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def recent(events: DataFrame, most: int) -> DataFrame:
    """The last `most` events by instant; of one instant the earlier appended first."""
    return events.filter("instant IS NOT NULL").orderBy(F.desc("instant"), F.asc("ord"), F.asc("id")).limit(most)


def last_undoable(events: DataFrame) -> DataFrame:
    """(entity_id, id): the latest tap of each entity that is neither undone nor an undo."""
    from .progress import without_undone

    live = without_undone(events).filter("entity_id IS NOT NULL AND instant IS NOT NULL")
    return live.groupBy("entity_id").agg(F.max(F.struct("instant", "ord", "id")).alias("r")).select("entity_id", F.col("r.id").alias("id"))
