"""Stages, points, shares, milestones and rank, replayed from the two logs and never stored.

Only the first tap that reaches a stage or a higher one matters, so stages come from grouped
minima instead of running windows: for each of the few stages the first tap of at least that
stage. A tap advances if it is the first for some stage; it earns the points of the stages for
which it is the first. Grouped minima combine before the shuffle, so an entity with a large
part of all taps costs one row a task.

Taps are rows (tap_id, entity_id, rank, seq, band); seq is any orderable struct, unique a tap.
Nulls: taps without entity, action or instant count nowhere.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import numbered, running
from ..session import cut, cut_counted, free
from .graph import components

# fixed values of progression
STAGES = ["uncharted", "surveyed", "landfall", "established", "anchored"]
STAGE_POINTS = [0, 1, 3, 5, 8]
ACTION_RANK = {"surveyed": 1, "visited": 2, "met": 2, "quoted": 3, "won": 4}
BAND_WEIGHT = {"High": 3, "Medium": 2, "Low": 1, "Insufficient information": 1}
KIND_WEIGHT = {"oem": 3, "engineering_office": 3, "integrator": 2, "distributor": 2}
MILESTONES = [(0.1, 5), (0.25, 15), (0.5, 30), (0.75, 50)]
LADDER = {"steps": 22, "top_points": 5760, "exponent": 2.1, "round_to": 5}
REVIEW_DAYS, REVIEW_POINTS = 3, 1


def _map(values: dict):
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def without_undone(events: DataFrame, id_col: str = "id") -> DataFrame:
    """Taps neither undone nor undo themselves."""
    undone = events.filter("action = 'undo' AND undo_of IS NOT NULL").select(F.col("undo_of").alias(id_col)).distinct()
    return events.filter("action <> 'undo'").join(undone, id_col, "left_anti")


def merge_order(changes: DataFrame, events: DataFrame) -> DataFrame:
    """(source, id, instant, turn): both logs in the order of replay: instant, ledger first, then order of append.

    `turn` counts from 1 over range partitions with offsets, so no single task holds the stream.
    """
    both = changes.select(F.lit("ledger").alias("source"), "id", "instant", F.lit(0).alias("src"), F.col("ord").cast("long").alias("ord"))
    both = both.unionByName(events.select(F.lit("log").alias("source"), "id", "instant", F.lit(1).alias("src"), F.col("ord").cast("long").alias("ord")))
    return numbered(both.filter("instant IS NOT NULL"), [], ["instant", "src", "ord", "id"], "turn").select("source", "id", "instant", "turn")


def tap_weight(band: str, kind: str, base_band: str):
    """Points multiplier: for facilities the band said at the tap, else the entity's; for others their kind."""
    facility = F.coalesce(F.try_element_at(_map(BAND_WEIGHT), F.coalesce(band, base_band, F.lit(""))), F.lit(1))
    other = F.coalesce(F.try_element_at(_map(KIND_WEIGHT), F.coalesce(kind, F.lit(""))), F.lit(1))
    return F.when(F.col(kind) == "facility", facility).otherwise(other)


def advancing_taps(taps: DataFrame) -> DataFrame:
    """(entity_id, tap_id, seq, old_rank, new_rank, band, first_of): the taps that raise a stage.

    `taps`: entity_id, tap_id, rank, seq, band. `first_of` lists the stages first reached by the tap.
    """
    one = F.struct("seq", "tap_id", "rank", "band")
    firsts = taps.groupBy("entity_id").agg(*[F.min(F.when(F.col("rank") >= k, one)).alias(f"s{k}") for k in range(1, len(STAGES))])
    each = firsts.select("entity_id", F.explode(F.array_compact(F.array(*[F.when(F.col(f"s{k}").isNotNull(), F.struct(F.lit(k).alias("stage"), F.col(f"s{k}").alias("t"))) for k in range(1, len(STAGES))]))).alias("x"))
    by = each.groupBy("entity_id", F.col("x.t.tap_id").alias("tap_id")).agg(F.min("x.t.seq").alias("seq"), F.max("x.t.rank").alias("new_rank"), F.max("x.t.band").alias("band"), F.array_sort(F.collect_set("x.stage")).alias("first_of"))
    return by.withColumn("old_rank", F.array_min("first_of") - 1)


def stage_points(advancing: DataFrame, entities: DataFrame) -> DataFrame:
    """Advancing taps with `points`; `entities`: id, kind, base_band. Taps on unknown entities are left out."""
    known = advancing.join(entities.withColumnRenamed("id", "entity_id"), "entity_id")
    value = F.expr("aggregate(first_of, 0, (s, k) -> s + element_at(array(" + ", ".join(map(str, STAGE_POINTS[1:])) + "), k))")
    weight = tap_weight("band", "kind", "base_band")
    return known.withColumn("weight", weight).withColumn("points", value * F.col("weight"))


def points_by_stage(paid: DataFrame) -> DataFrame:
    """(stage, points) over all advancing taps; stages nobody reached have none."""
    each = paid.select("weight", F.explode("first_of").alias("k"))
    names, values = F.array(*[F.lit(s) for s in STAGES]), F.array(*[F.lit(p) for p in STAGE_POINTS])
    return each.groupBy(F.element_at(names, F.col("k") + 1).alias("stage")).agg(F.sum(F.element_at(values, F.col("k") + 1) * F.col("weight")).alias("points"))


def as_of_status(taps: DataFrame, changes: DataFrame) -> DataFrame:
    """Each tap with `status`: the entity's status just before it ('active' if never changed).

    `taps`: tap_id, entity_id, instant. `changes`: entity_id, instant, ord, status. A change at the
    same instant counts as before, as the ledger goes first.
    """
    t = taps.select("entity_id", "tap_id", "instant", F.lit(1).alias("src"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("status"))
    c = changes.select("entity_id", F.lit(None).cast("string").alias("tap_id"), "instant", F.lit(0).alias("src"), F.col("ord").cast("long").alias("ord"), "status")
    u = running(t.unionByName(c), ["entity_id"], ["instant", "src", "ord"], "status", "now", "last")
    return u.filter("src = 1").select("tap_id", "entity_id", "instant", F.coalesce("now", F.lit("active")).alias("status"))


def targets_as_of(rows: DataFrame, status: DataFrame) -> DataFrame:
    """(row_id, target): the entity that each row's entity stood for at the row's instant, following duplicate marks as they were then.

    `rows`: row_id, entity_id, instant. `status`: entity_id, instant, ord, duplicate_of (null unless the change marks a
    duplicate). A change at the same instant counts as before. Chains may have any length; one that leads round in a
    loop ends at the row's own entity. Entities that marks ever join form a group; the marks and rows of a group are
    replayed in order, sorted and streamed through a task that holds only where its entities point. Rows outside groups stay.
    """
    group = cut(components(status.filter("duplicate_of IS NOT NULL"), "entity_id", "duplicate_of").withColumnRenamed("id", "entity_id"))
    key = {c: dict(rows.dtypes)[c] for c in ("row_id", "entity_id")}
    at = F.coalesce(F.col("instant"), F.lit(-(2**63))).alias("instant")  # null instants come first
    marks = status.select("entity_id", at, F.lit(0).alias("src"), F.col("ord").cast("long").alias("ord"), F.lit(None).cast(key["row_id"]).alias("row_id"), F.col("duplicate_of").alias("to"))
    asks = rows.select("entity_id", at, F.lit(1).alias("src"), F.lit(0).cast("long").alias("ord"), "row_id", F.lit(None).cast(key["entity_id"]).alias("to"))
    told = marks.unionByName(asks).join(group, "entity_id").repartition("group_id").sortWithinPartitions("group_id", "instant", "src", "ord")
    replayed = told.select("group_id", "src", "entity_id", "row_id", "to").mapInArrow(_replay_marks, f"row_id {key['row_id']}, target {key['entity_id']}")
    return replayed.unionByName(rows.join(group, "entity_id", "left_anti").select("row_id", F.col("entity_id").alias("target")))


def _replay_marks(batches):
    """(row_id, target) of the rows (src 1) among marks (src 0), sorted by group and in order of replay."""
    here, points = None, {}
    for batch in batches:
        ids, targets = [], []
        for group, src, entity, row, to in zip(*(batch.column(c).to_pylist() for c in ("group_id", "src", "entity_id", "row_id", "to"))):
            if group != here:
                here, points = group, {}
            if src == 0:
                points[entity] = to
                continue
            end, seen = entity, {entity}
            while (after := points.get(end)) is not None:
                if after in seen:
                    end = entity
                    break
                seen.add(after)
                end = after
            ids.append(row)
            targets.append(end)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("row_id").type), pa.array(targets, batch.schema.field("entity_id").type)], ["row_id", "target"])


def share_timeline(first_taps: DataFrame, status: DataFrame, pool: DataFrame) -> DataFrame:
    """(cluster, instant, done, size, share) after every instant at which a cluster's share changes.

    `pool`: id, cluster of core facilities, and `since`, the instant from which one counts (null: always); `first_taps`: entity_id, instant of the first advancing tap;
    `status`: entity_id, instant, ord, status. An entity counts while active; it is done once tapped.
    Every change of either is a step of plus or minus one; steps are summed by cluster and instant
    before the running sum. Running values are taken over range partitions (skew.running), so neither
    an entity of very many changes nor a cluster is one task.
    """
    since = F.col("since") if "since" in pool.columns else F.lit(None).cast("long").alias("since")
    e = pool.select(F.col("id").alias("entity_id"), "cluster", since).dropDuplicates(["entity_id"])
    s = status.join(e, "entity_id", "left_semi").select("entity_id", "instant", "ord", (F.col("status") == "active").alias("live"))
    s = running(s, ["entity_id"], ["instant", "ord"], "live", "was", "last", inclusive=False)
    s = cut(s.filter(F.col("live") != F.coalesce("was", F.lit(True))))
    tap = first_taps.select("entity_id", F.col("instant").alias("tapped"))
    flips = s.join(tap, "entity_id", "left")
    one = F.when(F.col("live"), 1).otherwise(-1)
    size_steps = flips.select("entity_id", "instant", F.lit(0).alias("done"), one.alias("size"))
    # a flip after the tap also moves the done count; the tap itself counts if the entity is active then
    done_steps = flips.filter("tapped IS NOT NULL AND instant > tapped").select("entity_id", "instant", one.alias("done"), F.lit(0).alias("size"))
    at_tap = tap.join(e, "entity_id", "left_semi").join(flips.filter("instant <= tapped").groupBy("entity_id").agg(F.max(F.struct("instant", "ord", "live")).alias("l")), "entity_id", "left")
    tap_steps = at_tap.filter(F.coalesce(F.col("l.live"), F.lit(True))).select("entity_id", F.col("tapped").alias("instant"), F.lit(1).alias("done"), F.lit(0).alias("size"))
    joined_steps = e.filter("since IS NOT NULL").select("entity_id", F.col("since").alias("instant"), F.lit(0).alias("done"), F.lit(1).alias("size"))
    steps = size_steps.unionByName(done_steps).unionByName(tap_steps).unionByName(joined_steps).join(e, "entity_id").groupBy("cluster", "instant").agg(F.sum("done").alias("d"), F.sum("size").alias("z"))
    start = e.groupBy("cluster").agg(F.count_if(F.col("since").isNull()).alias("n"))
    r = running(steps, ["cluster"], ["instant"], "d", "done", "sum")
    r = running(r, ["cluster"], ["instant"], "z", "moved", "sum").join(start, "cluster").withColumn("size", F.col("n") + F.col("moved"))
    return r.select("cluster", "instant", "done", "size", F.bround(F.coalesce(F.try_divide("done", "size"), F.lit(0.0)), 6).alias("share"))


def milestones(timeline: DataFrame, advancing: DataFrame) -> DataFrame:
    """(cluster, share, points, instant): when each milestone was first met; checked only at advancing taps.

    `advancing`: cluster, instant. The timeline is read as of each such instant.
    """
    u = timeline.select("cluster", "instant", F.lit(0).alias("src"), "done", "size").unionByName(advancing.select("cluster", "instant", F.lit(1).alias("src"), F.lit(None).cast("long").alias("done"), F.lit(None).cast("long").alias("size")).distinct())
    held = u.withColumn("held", F.when(F.col("src") == 0, F.struct("done", "size")))
    now = running(held, ["cluster"], ["instant", "src"], "held", "now", "last").filter("src = 1").select("cluster", "instant", "now.done", "now.size")
    marks = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(p).alias("points")) for s, p in MILESTONES])
    met = now.withColumn("m", F.explode(marks)).filter("size > 0 AND done / size >= m.share")
    return met.groupBy("cluster", F.col("m.share").alias("share"), F.col("m.points").alias("points")).agg(F.min("instant").alias("instant"))


def history(paid: DataFrame, met: DataFrame, most: int = 200) -> DataFrame:
    """(instant, subject, what, points): the last `most` stages and milestones, newest first.

    `paid` as from stage_points, `met` as from milestones.
    """
    names = F.array(*[F.lit(s) for s in STAGES])
    a = paid.select(F.col("seq.instant").alias("instant"), F.col("entity_id").alias("subject"), F.element_at(names, F.col("new_rank") + 1).alias("what"), F.col("points").cast("long").alias("points"))
    b = met.select("instant", F.col("cluster").alias("subject"), F.concat(F.lit("share "), F.col("share").cast("string")).alias("what"), F.col("points").cast("long").alias("points"))
    return a.unionByName(b).orderBy(F.desc("instant"), "subject", "what").limit(most)


def rank_ladder(spark: SparkSession) -> DataFrame:
    """(level, min_points): thresholds grow as a power of the step, rounded half to even to a multiple, strictly rising."""
    top, last, step = LADDER["top_points"], LADDER["steps"] - 1, LADDER["round_to"]
    rows, before = [], None
    for i in range(last + 1):
        points = 0 if i == 0 else round(top * math.pow(i / last, LADDER["exponent"]) / step) * step
        if before is not None and points <= before:
            points = before + step
        rows.append((i + 1, points))
        before = points
    return spark.createDataFrame(rows, "level int, min_points long")


def rank_of(points: DataFrame, ladder: DataFrame, value: str = "points") -> DataFrame:
    """Rows with level, floor and next_at (null on the last level). The ladder has a fixed 22 rows, held as one array."""
    steps = ladder.agg(F.array_sort(F.collect_list(F.struct("min_points", "level"))).alias("_l"))
    p = points.crossJoin(F.broadcast(steps))  # one row
    held = F.expr(f"filter(_l, x -> x.min_points <= {value})")
    ahead = F.expr(f"filter(_l, x -> x.min_points > {value})")
    cur = F.coalesce(F.try_element_at(held, F.lit(-1)), F.element_at("_l", 1))
    return p.withColumn("level", cur["level"]).withColumn("floor", cur["min_points"]).withColumn("next_at", F.try_element_at(ahead, F.lit(1))["min_points"]).drop("_l")


def review_points(reviews: DataFrame, signals: DataFrame) -> DataFrame:
    """(signal_id, points): the first review of a signal, worth a point within REVIEW_DAYS of its arrival.

    `reviews`: signal_id, instant, ord; `signals`: signal_id, received (micros). Ages drop fractions of seconds.
    """
    first = reviews.groupBy("signal_id").agg(F.min(F.struct("instant", "ord")).alias("r"))
    sec = lambda c: F.floor(c / 1_000_000)
    age = (sec(F.col("r.instant")) - sec(F.col("received"))) / 86400
    return first.join(signals, "signal_id").select("signal_id", F.when((age >= 0) & (age <= REVIEW_DAYS), REVIEW_POINTS).otherwise(0).alias("points"))


def transferred_stages(taps: DataFrame, transfers: DataFrame, with_taps: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Final stage of every entity, and the advancing taps (None unless asked for), when marking a duplicate moves its stage to another.

    `taps`: tap_id, target, rank, seq (target as of the tap). `transfers`: change_id, source, target, seq
    (target after the mark). A mark takes the source's stage away and gives it to the target if higher.
    The stretch up to a mark of an entity is its segment, which hands its greatest rank on to the segment of the
    target that holds the mark. So segments are a forest in which time only goes on, and what a mark moves is the greatest
    rank of all segments that lead to its own: found by doubling, in log2 of the longest way rounds.
    """
    t = transfers.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    events = taps.select(F.col("target").alias("entity"), "seq", F.lit("tap").alias("what"), F.col("tap_id").alias("id"), F.col("rank").cast("int").alias("rank"))
    events = events.unionByName(t.select(F.col("source").alias("entity"), "seq", F.lit("out").alias("what"), F.col("change_id").alias("id"), F.lit(0).alias("rank")))
    events = events.unionByName(t.select(F.col("target").alias("entity"), "seq", F.lit("in").alias("what"), F.col("change_id").alias("id"), F.lit(0).alias("rank")))
    events = running(events.withColumn("out", F.when(F.col("what") == "out", 1).otherwise(0)), ["entity"], ["seq"], "out", "segment", "sum", inclusive=False).drop("out")
    events = cut(events.withColumn("segment", F.coalesce("segment", F.lit(0))))
    # a segment ends with at most one mark; the last one of an entity stays open
    segments = events.groupBy("entity", "segment").agg(F.coalesce(F.max(F.when(F.col("what") == "tap", F.col("rank"))), F.lit(0)).alias("own"), F.max(F.when(F.col("what") == "out", F.col("id"))).alias("ends"))
    segments = cut(segments)
    into = cut(events.filter("what = 'in'").join(segments, ["entity", "segment"]).select("id", "entity", F.col("ends").alias("to")))
    step = cut(segments.filter("ends IS NOT NULL").select(F.col("ends").alias("id"), F.col("own").alias("moved")).join(into.select("id", "to"), "id", "left"))
    going = 1
    while going:
        handed = step.filter("to IS NOT NULL").groupBy(F.col("to").alias("id")).agg(F.max("moved").alias("handed"))
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        after = step.join(ahead, "to", "left").select("id", "moved", F.col("next").alias("to")).join(handed, "id", "left")
        after, seen = cut_counted(after.select("id", F.greatest("moved", "handed").alias("moved"), "to"), going=F.count("to"))
        free(step)
        step, going = after, seen["going"]
    moved = step.select("id", "moved")
    last = segments.filter("ends IS NULL").select("entity", F.col("own").alias("rank")).unionByName(into.filter("to IS NULL").join(moved, "id").select("entity", F.col("moved").alias("rank")))
    stages = last.groupBy("entity").agg(F.max("rank").alias("rank")).filter("rank > 0")
    if not with_taps:
        return stages, None
    now = events.join(moved, "id", "left").withColumn("rank", F.when(F.col("what") == "in", F.coalesce("moved", F.lit(0))).otherwise(F.col("rank")))
    now = running(now, ["entity", "segment"], ["seq"], "rank", "before", "max", inclusive=False).withColumn("before", F.coalesce("before", F.lit(0)))
    advancing = now.filter("what = 'tap' AND rank > before").select(F.col("id").alias("tap_id"), "entity", F.col("before").alias("old_rank"), F.col("rank").alias("new_rank"))
    return stages, advancing
