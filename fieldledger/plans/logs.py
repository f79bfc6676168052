"""Queries of the reference operators on the two logs: ledger, progression, signals, validation, maps, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import instant_micros
from ..operators import geo_etl, ledger, progress, signals, validate
from ..operators.changefeed import first_deliveries
from ..session import cut, table
from .catalog import Catalog
from .general import effective_changes
from .registry import HOME, entities

catalog = Catalog()

NOW = 1_790_000_000_000_000  # a fixed 'now' (2026-09), so that results repeat
FRAME = (-78.2, 36.9, -76.6, 38.4)  # west, south, east, north of the map frame in the map queries

LIVE_SQL = """
WITH once AS (SELECT id, arg_min(struct_pack(ts := ts, change := change, entity_id := entity_id, duplicate_of := duplicate_of, field := field, value := value, reason := reason), ord) AS r, min(ord) AS ord
              FROM ledger_change WHERE id IS NOT NULL GROUP BY id),
 live AS (SELECT * FROM (SELECT id AS change_id, ord, epoch_us(try_cast(r.ts AS timestamptz)) AS instant, r.entity_id AS entity_id, r.change AS change, r.value AS value, r.duplicate_of AS duplicate_of,
   CASE WHEN r.change = 'add_entity' THEN 'record' WHEN r.change = 'mark_duplicate' AND (r.duplicate_of IS NULL OR r.duplicate_of = r.entity_id) THEN NULL
        WHEN r.change IN ('mark_defunct', 'mark_not_a_fit', 'mark_assigned_elsewhere', 'mark_duplicate', 'reinstate') THEN 'status'
        WHEN r.change = 'correct' AND r.value IS NOT NULL THEN r.field END AS field FROM once) WHERE field IS NOT NULL AND entity_id IS NOT NULL AND instant IS NOT NULL),
 stat AS (SELECT entity_id, arg_max(struct_pack(c := change, d := duplicate_of, i := change_id), struct_pack(i := instant, o := ord)) AS r FROM live WHERE field = 'status' GROUP BY entity_id),
 status AS (SELECT entity_id, CASE r.c WHEN 'mark_defunct' THEN 'defunct' WHEN 'mark_not_a_fit' THEN 'not_a_fit' WHEN 'mark_assigned_elsewhere' THEN 'assigned_elsewhere' WHEN 'mark_duplicate' THEN 'duplicate' ELSE 'active' END AS status,
   CASE WHEN r.c = 'mark_duplicate' THEN r.d END AS duplicate_of, r.i AS change_id FROM stat)
"""
ADDED_SQL = """add_once AS (SELECT arg_min(struct_pack(ts := ts, change := change, entity_id := entity_id, j := entity), ord) AS r, min(ord) AS ord FROM ledger_change WHERE id IS NOT NULL GROUP BY id),
 add_first AS (SELECT r.entity_id AS id, arg_min(r.j, struct_pack(i := epoch_us(try_cast(r.ts AS timestamptz)), o := ord)) AS j, min(epoch_us(try_cast(r.ts AS timestamptz))) AS since FROM add_once
   WHERE r.change = 'add_entity' AND try_cast(r.ts AS timestamptz) IS NOT NULL AND json_extract_string(r.j, '$.id') = r.entity_id GROUP BY 1),
 entry AS (SELECT DISTINCT ON (id) id, kind, name, parent, cluster, scope, subindustry, lat, lon, miles, existence FROM entity WHERE id IS NOT NULL
   UNION ALL SELECT id, j->>'$.kind', j->>'$.name', j->>'$.parent', j->>'$.cluster', j->>'$.scope', j->>'$.subindustry', (j->>'$.lat')::double, (j->>'$.lon')::double, (j->>'$.miles')::double, 'ledger'
   FROM add_first WHERE id NOT IN (SELECT id FROM entity WHERE id IS NOT NULL))"""
LOG_SQL = ADDED_SQL + """,
 log AS (SELECT id, epoch_us(try_cast(r.ts AS timestamptz)) AS instant, r.action AS action, r.entity_id AS entity_id, r.undo_of AS undo_of, r.band AS band
         FROM (SELECT id, arg_min(struct_pack(ts := ts, action := action, entity_id := entity_id, undo_of := undo_of, band := band),
                                  struct_pack(a := arrived_at, b := action, c := entity_id)) AS r FROM logbook_event WHERE id IS NOT NULL GROUP BY id)),
 tap AS (SELECT * FROM log WHERE action <> 'undo' AND id NOT IN (SELECT undo_of FROM log WHERE action = 'undo' AND undo_of IS NOT NULL)),
 ranked AS (SELECT *, CASE action WHEN 'surveyed' THEN 1 WHEN 'visited' THEN 2 WHEN 'met' THEN 2 WHEN 'quoted' THEN 3 WHEN 'won' THEN 4 END AS rank FROM tap WHERE entity_id IS NOT NULL AND instant IS NOT NULL),
 run AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY entity_id ORDER BY instant, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old_rank FROM ranked WHERE rank IS NOT NULL),
 adv AS (SELECT * FROM run WHERE rank > old_rank),
 ent AS (SELECT DISTINCT ON (id) id, kind, cluster, scope, potential.band AS base_band, NULL::bigint AS since FROM entity WHERE id IS NOT NULL
   UNION ALL SELECT id, j->>'$.kind', j->>'$.cluster', j->>'$.scope', NULL, since FROM add_first WHERE id NOT IN (SELECT id FROM entity WHERE id IS NOT NULL)),
 paid AS (SELECT adv.*, kind, cluster, CASE WHEN kind = 'facility' THEN CASE coalesce(adv.band, base_band) WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END
           ELSE CASE kind WHEN 'oem' THEN 3 WHEN 'engineering_office' THEN 3 WHEN 'integrator' THEN 2 WHEN 'distributor' THEN 2 ELSE 1 END END AS weight FROM adv JOIN ent ON ent.id = adv.entity_id),
 points AS (SELECT *, ([1, 4, 9, 17][rank] - coalesce([1, 4, 9, 17][nullif(old_rank, 0)], 0)) * weight AS points FROM paid)
"""


def changes(spark, d):
    return effective_changes(spark, d)


def all_changes(spark, d):
    """Every change once, those of no effect included."""
    feed = table(spark, d, "ledger_change").select("ord", "id", "ts", "change", "entity_id", "duplicate_of", "field", "value", "reason", "entity")
    return first_deliveries(feed, "id", "ord").withColumn("instant", instant_micros("ts")).withColumnRenamed("id", "change_id")


def registry_now(spark, d):
    """The registry as the ledger leaves it, added entries included."""
    base = entities(spark, d).select("id", "kind", "name", "parent", "lat", "lon", "cluster", "scope", "band", "subindustry", "miles", "existence")
    return ledger.apply_ledger(base, changes(spark, d), HOME, ledger.additions(all_changes(spark, d)))


def events(spark, d):
    """Activity once an id: the first arrival. (id, instant, action, entity_id, undo_of, band, ord)"""
    e = table(spark, d, "logbook_event").filter("id IS NOT NULL").select("id", "ts", "action", "entity_id", "undo_of", "band", "role", "arrived_at")
    first = e.groupBy("id").agg(F.min(F.struct("arrived_at", "action", "entity_id", "ts", "undo_of", "band", "role")).alias("r")).select("id", "r.*")
    return first.withColumn("instant", instant_micros("ts")).withColumn("ord", F.unix_micros(F.col("arrived_at").cast("timestamp")))


def taps(spark, d):
    live = progress.without_undone(events(spark, d))
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in progress.ACTION_RANK.items() for x in kv]), F.col("action"))
    t = live.withColumn("rank", rank).filter("entity_id IS NOT NULL AND instant IS NOT NULL AND rank IS NOT NULL")
    return t.select(F.col("id").alias("tap_id"), "entity_id", "rank", F.struct("instant", F.col("id").alias("tap")).alias("seq"), "instant", "band")


def known(spark, d):
    """Entries of the base, and added ones with the instant `since` which they are there."""
    base = entities(spark, d).select("id", "kind", "cluster", "scope", F.col("potential.band").alias("base_band"), F.lit(None).cast("long").alias("since"))
    added = ledger.additions(all_changes(spark, d)).select("id", "kind", "cluster", "scope", F.lit(None).cast("string").alias("base_band"), "since")
    return base.unionByName(added.join(base.select("id"), "id", "left_anti"))


def paid(spark, d):
    return progress.stage_points(progress.advancing_taps(taps(spark, d)), known(spark, d))


# ------------------------------------------------------------------ ledger


@catalog.query(sql=LIVE_SQL + "SELECT entity_id, status, change_id, duplicate_of FROM status")
def q27_ledger_latest_status(spark, d):
    return ledger.latest_status(changes(spark, d)).select("entity_id", "status", "change_id", "duplicate_of")


@catalog.query(
    sql=LIVE_SQL
    + "," + ADDED_SQL
    + """, c AS (SELECT entity_id, field, arg_max(value, struct_pack(i := instant, o := ord)) AS v FROM live WHERE change = 'correct' GROUP BY 1, 2),
         w AS (SELECT entity_id, max(v) FILTER (field = 'name') AS name, max(v) FILTER (field = 'parent') AS parent, max(v) FILTER (field = 'subindustry') AS subindustry,
                 try_cast(max(v) FILTER (field = 'lat') AS double) AS lat, try_cast(max(v) FILTER (field = 'lon') AS double) AS lon FROM c GROUP BY 1),
         b AS (SELECT * FROM entry)
         SELECT b.id, b.kind, b.cluster, b.scope, b.existence, coalesce(w.name, b.name) AS name, coalesce(w.parent, b.parent) AS parent, coalesce(w.subindustry, b.subindustry) AS subindustry, coalesce(w.lat, b.lat) AS lat, coalesce(w.lon, b.lon) AS lon,
           CASE WHEN w.lat IS NOT NULL OR w.lon IS NOT NULL THEN round_even(sqrt(pow((coalesce(w.lon, b.lon) - -77.44) * 69 * cos(radians(37.5)), 2) + pow((coalesce(w.lat, b.lat) - 37.54) * 69, 2)), 1) ELSE b.miles END AS miles,
           coalesce(s.status, 'active') AS status FROM b LEFT JOIN w ON w.entity_id = b.id LEFT JOIN status s ON s.entity_id = b.id"""
)
def q28_ledger_corrections(spark, d):
    """The effective registry, added entries included."""
    return registry_now(spark, d).select("id", "kind", "cluster", "scope", "existence", "name", "parent", "subindustry", "lat", "lon", "miles", "status")


@catalog.query(
    sql="""WITH once AS (SELECT id, arg_min(struct_pack(ts := ts, change := change, entity_id := entity_id, duplicate_of := duplicate_of, field := field, value := value, entity := entity), ord) AS r, min(ord) AS ord
              FROM ledger_change WHERE id IS NOT NULL GROUP BY id),
 c AS (SELECT id AS change_id, ord, epoch_us(try_cast(r.ts AS timestamptz)) AS instant, r.* FROM once),
 base AS (SELECT DISTINCT id FROM entity WHERE id IS NOT NULL),
 added AS (SELECT entity_id, min(struct_pack(i := instant, o := ord)) AS since FROM c WHERE change = 'add_entity' AND entity_id IS NOT NULL GROUP BY 1),
 k AS (SELECT c.*, b.id IS NOT NULL OR coalesce(a.since < struct_pack(i := instant, o := ord), false) AS is_known, tb.id IS NOT NULL OR coalesce(ta.since < struct_pack(i := instant, o := ord), false) AS target_known
       FROM c LEFT JOIN base b ON b.id = c.entity_id LEFT JOIN added a ON a.entity_id = c.entity_id LEFT JOIN base tb ON tb.id = c.duplicate_of LEFT JOIN added ta ON ta.entity_id = c.duplicate_of),
 v AS (SELECT change_id, unnest(list_filter([
   CASE WHEN instant IS NULL THEN 'unreadable ts' END, CASE WHEN change = 'add_entity' AND is_known THEN 'added twice' END, CASE WHEN change <> 'add_entity' AND NOT is_known THEN 'unknown entity' END,
   CASE WHEN change = 'mark_duplicate' AND duplicate_of IS NULL THEN 'duplicate of nothing' END, CASE WHEN change = 'mark_duplicate' AND duplicate_of = entity_id THEN 'duplicate of itself' END,
   CASE WHEN change = 'mark_duplicate' AND duplicate_of IS NOT NULL AND NOT target_known THEN 'unknown target' END,
   CASE WHEN change = 'correct' AND NOT coalesce(field IN ('name', 'lat', 'lon', 'subindustry', 'parent'), false) THEN 'field not correctable' END,
   CASE WHEN change = 'correct' AND value IS NULL THEN 'no value' END,
   CASE WHEN change = 'correct' AND field IN ('lat', 'lon') AND value IS NOT NULL AND try_cast(value AS double) IS NULL THEN 'not a number' END,
   CASE WHEN change = 'add_entity' AND (entity->>'$.id') IS DISTINCT FROM entity_id THEN 'entry of another id' END,
   CASE WHEN change = 'add_entity' AND NOT coalesce(regexp_full_match(entity->>'$.id', '[A-Za-z0-9_.:-]{3,80}') AND entity->>'$.kind' IN ('facility', 'oem', 'engineering_office', 'integrator', 'distributor')
     AND length(entity->>'$.name') BETWEEN 1 AND 200 AND (entity->>'$.lat')::double BETWEEN 36 AND 40 AND (entity->>'$.lon')::double BETWEEN -80 AND -74 AND coalesce(entity->>'$.scope', 'core') IN ('core', 'extended'), false)
     THEN 'entry breaks its contract' END], lambda x: x IS NOT NULL)) AS problem FROM k)
 SELECT change_id, problem FROM v"""
)
def q29_ledger_violations(spark, d):
    return ledger.violations(all_changes(spark, d), entities(spark, d).select("id"), ledger.ENTRY_CONTRACT)


@catalog.query(
    sql=LIVE_SQL
    + """ SELECT change_id, entity_id, CASE change WHEN 'add_entity' THEN 'added' WHEN 'correct' THEN 'corrected ' || field WHEN 'mark_defunct' THEN 'status defunct' WHEN 'mark_not_a_fit' THEN 'status not_a_fit'
           WHEN 'mark_assigned_elsewhere' THEN 'status assigned_elsewhere' WHEN 'mark_duplicate' THEN 'status duplicate' ELSE 'status active' END AS effect, instant FROM live"""
)
def q29_audit_trail(spark, d):
    """What each change of effect did."""
    return ledger.audit_trail(changes(spark, d)).select("change_id", "entity_id", "effect", "instant")


CHAIN_SQL = LIVE_SQL.replace("WITH once", "WITH RECURSIVE once") + """, dup AS (SELECT entity_id AS id, duplicate_of AS nxt FROM status WHERE status = 'duplicate'),
 walk(id, cur, depth) AS (SELECT id, nxt, 1 FROM dup UNION ALL SELECT w.id, d.nxt, w.depth + 1 FROM walk w JOIN dup d ON d.id = w.cur WHERE w.depth < 400),
 far AS (SELECT id, max(depth) AS depth, arg_max(cur, depth) AS cur FROM walk GROUP BY id)"""


@catalog.query(sql=CHAIN_SQL + " SELECT id, cur AS root, depth::bigint AS depth FROM far WHERE depth < 400")
def q30_dup_chain_resolve(spark, d):
    return ledger.duplicate_chains(cut(ledger.latest_status(changes(spark, d)))).filter("NOT looped").select("id", "root", "depth")


@catalog.query(sql=CHAIN_SQL + " SELECT id FROM far WHERE depth >= 400")
def q31_dup_loops(spark, d):
    """Entries whose duplicate chain never ends."""
    return ledger.duplicate_chains(cut(ledger.latest_status(changes(spark, d)))).filter("looped").select("id")


# ------------------------------------------------------------------ progression


@catalog.query(
    sql="""WITH c AS (SELECT id, arg_min(ts, ord) AS ts, min(ord) AS ord FROM ledger_change WHERE id IS NOT NULL GROUP BY id),
 l AS (SELECT id, arg_min(struct_pack(ts := ts, action := action, undo_of := undo_of, a := arrived_at), struct_pack(a := arrived_at, b := action, c := entity_id)) AS r FROM logbook_event WHERE id IS NOT NULL GROUP BY id),
 e AS (SELECT id, r.ts AS ts, epoch_us(r.a) AS ord FROM l WHERE r.action <> 'undo' AND id NOT IN (SELECT r.undo_of FROM l WHERE r.action = 'undo' AND r.undo_of IS NOT NULL)),
 u AS (SELECT 'ledger' AS source, id, epoch_us(try_cast(ts AS timestamptz)) AS instant, 0 AS src, ord FROM c UNION ALL SELECT 'log', id, epoch_us(try_cast(ts AS timestamptz)), 1, ord FROM e)
 SELECT source, id, row_number() OVER (ORDER BY instant, src, ord, id) AS turn FROM u WHERE instant IS NOT NULL"""
)
def q32_merge_order(spark, d):
    c = all_changes(spark, d).select(F.col("change_id").alias("id"), "instant", "ord")
    return progress.merge_order(c, progress.without_undone(events(spark, d))).select("source", "id", "turn")


@catalog.query(sql="WITH " + LOG_SQL.strip().split(" ranked AS")[0].rstrip().rstrip(",") + " SELECT id, action, entity_id FROM tap")
def q33_undo_filter(spark, d):
    return progress.without_undone(events(spark, d)).select("id", "action", "entity_id")


@catalog.query(sql="WITH " + LOG_SQL + " SELECT id AS tap_id, entity_id, old_rank::int AS old_rank, rank::int AS new_rank FROM adv")
def q34_running_stage(spark, d):
    """Taps that raise a stage, with the stages before and after."""
    return progress.advancing_taps(taps(spark, d)).select("tap_id", "entity_id", F.col("old_rank").cast("int").alias("old_rank"), F.col("new_rank").cast("int").alias("new_rank"))


@catalog.query(sql="WITH " + LOG_SQL + " SELECT id AS tap_id, entity_id, points::bigint AS points FROM points")
def q35_stage_points(spark, d):
    return paid(spark, d).select("tap_id", "entity_id", F.col("points").cast("long").alias("points"))


@catalog.query(
    sql="WITH " + LOG_SQL + """, x AS (SELECT unnest(range(old_rank + 1, rank + 1)) AS k, weight FROM paid)
        SELECT ['surveyed', 'landfall', 'established', 'anchored'][k] AS stage, sum([1, 3, 5, 8][k] * weight)::bigint AS points FROM x GROUP BY k"""
)
def q36_points_by_stage(spark, d):
    return progress.points_by_stage(paid(spark, d)).select("stage", F.col("points").cast("long").alias("points"))


def _timeline(spark, d):
    pool = known(spark, d).filter("kind = 'facility' AND scope = 'core'").select("id", "cluster", "since")
    first = progress.advancing_taps(taps(spark, d)).filter("old_rank = 0").select("entity_id", F.col("seq.instant").alias("instant"))
    status = changes(spark, d).filter("field = 'status'").withColumn("status", ledger.status_column("change")).select("entity_id", "instant", "ord", "status")
    return progress.share_timeline(first, status, pool)


SHARE_SQL = (
    LIVE_SQL + "," + LOG_SQL
    + """, pool AS (SELECT id, cluster, since FROM ent WHERE kind = 'facility' AND scope = 'core'),
 st AS (SELECT l.entity_id, l.instant, l.ord, l.change = 'reinstate' AS live FROM live l JOIN pool p ON p.id = l.entity_id WHERE l.field = 'status'),
 ch AS (SELECT *, coalesce(lag(live) OVER (PARTITION BY entity_id ORDER BY instant, ord), true) AS was FROM st),
 flip AS (SELECT entity_id, instant, ord, live FROM ch WHERE live <> was),
 ft AS (SELECT a.entity_id, a.instant AS tapped FROM adv a JOIN pool p ON p.id = a.entity_id WHERE a.old_rank = 0),
 step AS (SELECT entity_id, instant, 0 AS d, CASE WHEN live THEN 1 ELSE -1 END AS z FROM flip
   UNION ALL SELECT f.entity_id, f.instant, CASE WHEN f.live THEN 1 ELSE -1 END, 0 FROM flip f JOIN ft ON ft.entity_id = f.entity_id AND f.instant > tapped
   UNION ALL SELECT id, since, 0, 1 FROM pool WHERE since IS NOT NULL
   UNION ALL SELECT ft.entity_id, tapped, 1, 0 FROM ft WHERE coalesce((SELECT arg_max(f.live, struct_pack(i := f.instant, o := f.ord)) FROM flip f WHERE f.entity_id = ft.entity_id AND f.instant <= tapped), true)),
 net AS (SELECT p.cluster, s.instant, sum(d) AS d, sum(z) AS z FROM step s JOIN pool p ON p.id = s.entity_id GROUP BY 1, 2),
 tl AS (SELECT n.cluster, instant, sum(d) OVER w AS done, c.n + sum(z) OVER w AS size FROM net n JOIN (SELECT cluster, count(*) FILTER (since IS NULL) AS n FROM pool GROUP BY 1) c USING (cluster) WINDOW w AS (PARTITION BY n.cluster ORDER BY instant ROWS UNBOUNDED PRECEDING))"""
)


@catalog.query(sql=SHARE_SQL + " SELECT cluster, instant, done::bigint AS done, size::bigint AS size, round_even(coalesce(done / nullif(size, 0), 0), 6) AS share FROM tl")
def q37_cluster_share_timeline(spark, d):
    return _timeline(spark, d)


@catalog.query(
    sql=SHARE_SQL
    + """, seen AS (SELECT DISTINCT p.cluster, a.instant FROM adv a JOIN ent p ON p.id = a.entity_id),
 held AS (SELECT seen.cluster, seen.instant, t.done, t.size FROM seen ASOF JOIN tl t ON seen.cluster = t.cluster AND seen.instant >= t.instant)
 SELECT cluster, m.share::double AS share, m.points::int AS points, min(instant) AS instant FROM held, (VALUES (0.1::double, 5), (0.25, 15), (0.5, 30), (0.75, 50)) m(share, points) WHERE size > 0 AND done / size >= m.share GROUP BY 1, 2, 3"""
)
def q38_milestones(spark, d):
    return milestones_met(spark, d)


def milestones_met(spark, d):
    """(cluster, share, points, instant) of every milestone met."""
    adv = progress.advancing_taps(taps(spark, d)).join(known(spark, d).select(F.col("id").alias("entity_id"), "cluster"), "entity_id").select("cluster", F.col("seq.instant").alias("instant"))
    return progress.milestones(cut(_timeline(spark, d)), adv)


def signals_now(spark, d):
    """Registry signals plus one for each added entry, received when it was added."""
    e = entities(spark, d).select("id", "name", "scope", F.col("timing.k").alias("timing_k"), F.col("timing.label").alias("timing_label"), "loaded_at")
    snap = signals.seed(e).join(e.select(F.col("id").alias("entity_id"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("received")), "entity_id")
    snap = snap.select("signal_id", "entity_id", "source_type", "stage", "kind", "generated_by", "received")
    added = changes(spark, d).filter("field = 'record'").select(F.concat(F.lit("sig-add-"), "change_id").alias("signal_id"), "entity_id", F.lit("manual").alias("source_type"), F.lit("announced").alias("stage"), F.lit("project_status").alias("kind"), F.lit("person").alias("generated_by"), F.col("instant").alias("received"))
    return snap.unionByName(added)


SIGNAL_TAIL = (
    """, e AS (SELECT DISTINCT ON (id) id, name, scope, timing.k AS k, epoch_us(loaded_at) AS received FROM entity WHERE id IS NOT NULL),
 sig AS (SELECT 'sig-snap-' || id || '-' || k AS signal_id, id AS entity_id, 'registry_snapshot' AS source_type, CASE k WHEN 'expansion' THEN 'expansion' ELSE 'project_status' END AS kind, 'rule' AS generated_by, CASE k WHEN 'proposed' THEN 'announced' WHEN 'construction' THEN 'construction' WHEN 'expansion' THEN 'construction' ELSE 'on_hold' END AS stage, received
         FROM e WHERE scope = 'core' AND k IN ('proposed', 'construction', 'expansion', 'hold')
         UNION ALL SELECT 'sig-add-' || change_id, entity_id, 'manual', 'project_status', 'person', 'announced', instant FROM live WHERE field = 'record'),
 fresh AS (SELECT *, CASE WHEN source_type = 'registry_snapshot' THEN 0.0::double ELSE CASE WHEN (1790000000 - received // 1000000) / 3600 <= 72 THEN 1.0::double WHEN (1790000000 - received // 1000000) / 3600 >= 168 THEN 0.0
     ELSE round_even(1 - ((1790000000 - received // 1000000) / 3600 - 72) / 96, 3) END END AS freshness FROM sig)"""
)
SIGNAL_SQL = LIVE_SQL + "," + ADDED_SQL + SIGNAL_TAIL


@catalog.query(
    sql="""WITH log AS (SELECT id, arg_min(struct_pack(ts := ts, action := action, entity_id := entity_id), struct_pack(a := arrived_at, b := action, c := entity_id)) AS r, epoch_us(min(arrived_at)) AS ord FROM logbook_event WHERE id IS NOT NULL GROUP BY id),
 rev AS (SELECT r.entity_id AS entity_id, min(struct_pack(i := epoch_us(try_cast(r.ts AS timestamptz)), o := ord)) AS f FROM log WHERE r.action = 'visited' AND r.entity_id IS NOT NULL AND try_cast(r.ts AS timestamptz) IS NOT NULL GROUP BY 1),
 e AS (SELECT DISTINCT ON (id) id, epoch_us(loaded_at) AS received FROM entity WHERE id IS NOT NULL)
 SELECT rev.entity_id AS signal_id, CASE WHEN (f.i // 1000000 - received // 1000000) / 86400 BETWEEN 0 AND 3 THEN 1 ELSE 0 END AS points FROM rev JOIN e ON e.id = rev.entity_id WHERE received IS NOT NULL"""
)
def q39_review_points(spark, d):
    """Review rule with an entry's load as the arrival and its first visit as the review (the tables have no signal log)."""
    r = events(spark, d).filter("action = 'visited' AND entity_id IS NOT NULL AND instant IS NOT NULL").select(F.col("entity_id").alias("signal_id"), "instant", "ord")
    s = entities(spark, d).filter("loaded_at IS NOT NULL").select(F.col("id").alias("signal_id"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("received"))
    return progress.review_points(r, s)


LADDER_SQL = "ladder AS (SELECT i + 1 AS level, CASE WHEN i = 0 THEN 0 ELSE round_even(5760 * pow(i / 21, 2.1) / 5, 0) * 5 END::bigint AS min_points FROM (SELECT unnest(range(22)) AS i))"


@catalog.query(sql="WITH " + LADDER_SQL + " SELECT level::int AS level, min_points FROM ladder")
def q40_rank_ladder(spark, d):
    return progress.rank_ladder(spark)


@catalog.query(
    sql="WITH " + LOG_SQL + ", " + LADDER_SQL + """, c AS (SELECT cluster, sum(points)::bigint AS points FROM points GROUP BY 1)
        SELECT cluster, c.points, max(level) FILTER (min_points <= c.points)::int AS level, max(min_points) FILTER (min_points <= c.points) AS floor, min(min_points) FILTER (min_points > c.points) AS next_at FROM c, ladder GROUP BY 1, 2"""
)
def q41_rank_for(spark, d):
    """Points and rank of each cluster's work."""
    by = paid(spark, d).groupBy("cluster").agg(F.sum("points").cast("long").alias("points"))
    return progress.rank_of(by, progress.rank_ladder(spark)).select("cluster", "points", "level", "floor", "next_at")


@catalog.query(
    sql=LIVE_SQL + "," + LOG_SQL
    + """, top AS (SELECT entity_id, max(rank) AS r FROM adv GROUP BY 1),
 pool AS (SELECT e.id, e.cluster, coalesce(t.r, 0) AS r FROM ent e LEFT JOIN status s ON s.entity_id = e.id LEFT JOIN top t ON t.entity_id = e.id WHERE kind = 'facility' AND scope = 'core' AND coalesce(s.status, 'active') = 'active')
 SELECT cluster, count(*) AS entities, count(*) FILTER (r = 0) AS uncharted, count(*) FILTER (r = 1) AS surveyed, count(*) FILTER (r = 2) AS landfall, count(*) FILTER (r = 3) AS established, count(*) FILTER (r = 4) AS anchored,
   round_even(count(*) FILTER (r > 0) / count(*), 4) AS surveyed_share FROM pool GROUP BY cluster"""
)
def q42_cluster_rollup_pivot(spark, d):
    return cluster_rollup(spark, d)


def cluster_rollup(spark, d):
    status = ledger.latest_status(changes(spark, d)).select(F.col("entity_id").alias("id"), "status")
    top = progress.advancing_taps(taps(spark, d)).groupBy(F.col("entity_id").alias("id")).agg(F.max("new_rank").alias("r"))
    pool = known(spark, d).filter("kind = 'facility' AND scope = 'core'").join(status, "id", "left").filter("coalesce(status, 'active') = 'active'").join(top, "id", "left")
    names = F.array(*[F.lit(s) for s in progress.STAGES])
    staged = pool.select("cluster", F.element_at(names, F.coalesce("r", F.lit(0)) + 1).alias("stage"))
    wide = staged.groupBy("cluster").pivot("stage", progress.STAGES).count().na.fill(0)
    n = sum(F.col(s) for s in progress.STAGES)
    return wide.select("cluster", n.alias("entities"), *progress.STAGES, F.bround((n - F.col("uncharted")) / n, 4).alias("surveyed_share"))


@catalog.query()
def q42_transferred_stages(spark, d):
    """Final stages where duplicate marks hand a stage on (doubling over transfers; tested against a replay).

    The target of a tap, and of a mark, is the entry its own one stood for at that instant; loops keep the entry itself.
    """
    status = cut(changes(spark, d).filter("field = 'status'").select("change_id", "change", "entity_id", "instant", "ord", F.when(F.col("change") == "mark_duplicate", F.col("duplicate_of")).alias("duplicate_of")))
    tap = cut(taps(spark, d).select(F.concat(F.lit("t|"), "tap_id").alias("row_id"), "tap_id", "entity_id", "instant", "rank"))
    mark = status.filter("change = 'mark_duplicate'").select(F.concat(F.lit("m|"), "change_id").alias("row_id"), "change_id", "entity_id", "instant")
    rows = tap.select("row_id", "entity_id", "instant").unionByName(mark.select("row_id", "entity_id", "instant"))
    at = cut(progress.targets_as_of(rows, status))
    order = lambda src, tie: F.struct("instant", F.lit(src).alias("src"), F.col(tie).alias("tie")).alias("seq")
    t = tap.join(at, "row_id").select("tap_id", "target", "rank", order(1, "tap_id"))
    m = mark.join(at, "row_id").filter("target <> entity_id").select("change_id", F.col("entity_id").alias("source"), "target", order(0, "change_id"))
    stages, _ = progress.transferred_stages(t, m, with_taps=False)
    return stages.select(F.col("entity").alias("entity_id"), "rank")


# ------------------------------------------------------------------ signals and state


@catalog.query(
    sql="""SELECT DISTINCT 'sig-snap-' || id || '-' || timing.k AS signal_id, id AS entity_id, 'registry_snapshot' AS source_type, CASE timing.k WHEN 'proposed' THEN 'announced' WHEN 'construction' THEN 'construction' WHEN 'expansion' THEN 'construction' ELSE 'on_hold' END AS stage,
             CASE timing.k WHEN 'expansion' THEN 'expansion' ELSE 'project_status' END AS kind, 'exact_id' AS match_method, 'high' AS match_confidence, 'rule' AS generated_by, left(concat_ws(': ', name, timing.label), 200) AS headline FROM entity WHERE scope = 'core' AND timing.k IN ('proposed', 'construction', 'expansion', 'hold') AND id IS NOT NULL"""
)
def q43_signal_seed(spark, d):
    e = entities(spark, d).select("id", "name", "scope", F.col("timing.k").alias("timing_k"), F.col("timing.label").alias("timing_label"))
    return signals.seed(e)


@catalog.query(sql=SIGNAL_SQL + " SELECT signal_id, freshness FROM fresh")
def q44_freshness(spark, d):
    return signals_now(spark, d).select("signal_id", signals.freshness(F.col("received"), F.col("source_type"), NOW).alias("freshness"))


def _triage(spark, d):
    """Triage actions made from activity: visits review, meetings pin, won deals dismiss the entry's snapshot signal."""
    named = F.create_map(*[F.lit(x) for kv in {"visited": "signal_reviewed", "met": "signal_pinned", "won": "signal_dismissed"}.items() for x in kv])
    return events(spark, d).withColumn("action", F.try_element_at(named, F.col("action"))).filter("action IS NOT NULL AND entity_id IS NOT NULL").select(F.col("entity_id").alias("signal_id"), "action", "instant", F.struct("ord", "id").alias("ord"))


def triaged(spark, d, found):
    """(signal_id, status) of the signals in `found` that were triaged: an action on an entry is one on its signals."""
    t = signals.triage(_triage(spark, d)).withColumnRenamed("signal_id", "entity_id")
    return found.select("signal_id", "entity_id").join(t, "entity_id").select("signal_id", "status")


def reviews(spark, d, found):
    """(signal_id, instant, ord) of every review of a signal in `found`."""
    r = _triage(spark, d).filter("action = 'signal_reviewed' AND instant IS NOT NULL").withColumnRenamed("signal_id", "entity_id")
    return found.select("signal_id", "entity_id").join(r, "entity_id").select("signal_id", "instant", "ord")


TRIAGE_SQL = """
 log AS (SELECT id, arg_min(struct_pack(ts := ts, action := action, entity_id := entity_id), struct_pack(a := arrived_at, b := action, c := entity_id)) AS r, epoch_us(min(arrived_at)) AS ord FROM logbook_event WHERE id IS NOT NULL GROUP BY id),
 act AS (SELECT id, r.entity_id AS entity_id, epoch_us(try_cast(r.ts AS timestamptz)) AS instant, ord, CASE r.action WHEN 'visited' THEN 'reviewed' WHEN 'met' THEN 'pinned' WHEN 'won' THEN 'dismissed' END AS a FROM log),
 tri AS (SELECT entity_id, arg_max(a, struct_pack(i := instant, o := ord, id := id)) AS status FROM act WHERE a IS NOT NULL AND entity_id IS NOT NULL AND instant IS NOT NULL GROUP BY 1)"""


@catalog.query(sql="WITH " + TRIAGE_SQL + " SELECT entity_id AS signal_id, status FROM tri")
def q45_triage(spark, d):
    return signals.triage(_triage(spark, d))


@catalog.query(
    sql=SIGNAL_SQL + "," + TRIAGE_SQL
    + """, one AS (SELECT f.*, coalesce(t.status, 'new') AS status FROM fresh f LEFT JOIN tri t ON t.entity_id = f.entity_id)
         SELECT signal_id, entity_id, status, freshness, stage IN ('announced', 'design', 'permitting') AS spec_window FROM one WHERE entity_id IN (SELECT id FROM entry)"""
)
def q46_signal_view(spark, d):
    s = signals_now(spark, d)
    return signals.view(s, triaged(spark, d, s), known(spark, d).select("id"), NOW)


@catalog.query(sql=SIGNAL_SQL + " SELECT signal_id FROM sig WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT id FROM e)")
def q46_orphans(spark, d):
    """Signals whose entity the base registry lacks (here those of added entries)."""
    return signals.orphans(signals_now(spark, d), entities(spark, d).select("id")).select("signal_id")


@catalog.query(
    sql="""WITH log AS (SELECT id, arg_min(struct_pack(ts := ts, action := action), struct_pack(a := arrived_at, b := action, c := entity_id)) AS r, epoch_us(min(arrived_at)) AS ord FROM logbook_event WHERE id IS NOT NULL GROUP BY id)
         SELECT id, r.action AS action, epoch_us(try_cast(r.ts AS timestamptz)) AS instant FROM log WHERE try_cast(r.ts AS timestamptz) IS NOT NULL ORDER BY instant DESC, ord, id LIMIT 40"""
)
def q47_recent_topk(spark, d):
    return signals.recent(events(spark, d), 40).select("id", "action", "instant")


@catalog.query(
    sql="WITH " + LOG_SQL.split(" ranked AS")[0].rstrip().rstrip(",")
    + """, o AS (SELECT id, epoch_us(min(arrived_at)) AS ord FROM logbook_event GROUP BY id)
         SELECT entity_id, arg_max(tap.id, struct_pack(i := instant, o := o.ord, id := tap.id)) AS id FROM tap JOIN o ON o.id = tap.id WHERE entity_id IS NOT NULL AND instant IS NOT NULL GROUP BY 1"""
)
def q48_last_tap(spark, d):
    return signals.last_undoable(events(spark, d))


@catalog.query(
    sql="""SELECT kind, scope, existence, count(*) AS n FROM (SELECT DISTINCT ON (id) id, kind, scope, existence FROM entity WHERE id IS NOT NULL) GROUP BY GROUPING SETS ((kind), (scope), (existence), ())"""
)
def q49_counters_grouping_sets(spark, d):
    """Several counters in one pass."""
    entities(spark, d).select("kind", "scope", "existence").createOrReplaceTempView("fieldledger_counted")
    return spark.sql("SELECT kind, scope, existence, count(*) AS n FROM fieldledger_counted GROUP BY GROUPING SETS ((kind), (scope), (existence), ())")


COUNTER_SQL = """, tagged AS (SELECT sig.*, coalesce(t.status, 'new') AS status, CASE WHEN sig.entity_id IS NULL THEN 'unplaced' WHEN sig.entity_id NOT IN (SELECT id FROM entry) THEN 'orphaned' ELSE 'placed' END AS place
   FROM sig LEFT JOIN tri t ON t.entity_id = sig.entity_id),
 counted AS (SELECT 'signals_by_source' AS what, source_type AS value, count(*)::bigint AS n FROM tagged GROUP BY 2 UNION ALL SELECT 'signals_by_kind', kind, count(*) FROM tagged GROUP BY 2
   UNION ALL SELECT 'signals_by_generator', generated_by, count(*) FROM tagged GROUP BY 2 UNION ALL SELECT 'signals_by_status', status, count(*) FROM tagged GROUP BY 2 UNION ALL SELECT 'signals_by_place', place, count(*) FROM tagged GROUP BY 2)"""


@catalog.query(sql=SIGNAL_SQL + "," + TRIAGE_SQL + COUNTER_SQL + " SELECT what, value, n FROM counted")
def q49_signal_counters(spark, d):
    """Signals by source type, kind, generator, triage status and place."""
    s = signals_now(spark, d)
    return signals.counters(s, triaged(spark, d, s), known(spark, d).select("id"))


@catalog.query(sql=SIGNAL_SQL + " SELECT signal_id, source_type FROM sig WHERE source_type = 'manual' OR entity_id > 'C5'")
def q70_append_new_signals(spark, d):
    """What a second seeding adds where the signals of the entries up to C5 are there already."""
    s = signals_now(spark, d)
    there = s.filter("source_type <> 'manual' AND entity_id <= 'C5'")
    return signals.append_new(there, s).select("signal_id", "source_type")


@catalog.query(
    sql="""SELECT kind, count(DISTINCT jurisdiction)::bigint AS jurisdictions, true AS names_close, true AS median_close FROM entity GROUP BY kind"""
)
def q71_approximate_aggregates(spark, d):
    """Distinct names and the median latitude by kind from sketches, with whether they are as close to the exact ones as promised."""
    e = table(spark, d, "entity").groupBy("kind").agg(
        F.countDistinct("jurisdiction").alias("jurisdictions"), F.approx_count_distinct("name", 0.03).alias("about"), F.countDistinct("name").alias("exact"),
        F.percentile_approx("lat", [0.49, 0.5, 0.51], F.lit(10_000)).alias("mid"), F.percentile("lat", 0.5).alias("median"),
    )
    close = F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.12)
    return e.select("kind", "jurisdictions", close.alias("names_close"), (F.col("median").between(F.col("mid")[0] - 0.01, F.col("mid")[2] + 0.01)).alias("median_close"))


@catalog.query(sql=SIGNAL_SQL + " SELECT signal_id, entity_id FROM sig WHERE entity_id NOT IN (SELECT entity_id FROM status WHERE status <> 'active')")
def q76_active_notifications(spark, d):
    """Signals of entries that are active."""
    return signals.of_active(signals_now(spark, d), registry_now(spark, d).select("id", "status")).select("signal_id", "entity_id")


@catalog.query(sql="WITH " + LOG_SQL + " SELECT id FROM ent WHERE kind = 'facility' AND (coalesce(base_band, '') <> 'Low' OR id IN (SELECT entity_id FROM adv))")
def q77_decluttered(spark, d):
    """Facilities without the untouched ones of low opportunity."""
    e = known(spark, d).filter("kind = 'facility'").select("id", F.col("base_band").alias("band"))
    return signals.decluttered(e, progress.advancing_taps(taps(spark, d))).select("id")


@catalog.query(sql=LIVE_SQL + "," + ADDED_SQL + " SELECT id, name, cluster FROM entry WHERE existence = 'ledger'")
def q27_added_entries(spark, d):
    """Entries that the ledger added."""
    return ledger.additions(all_changes(spark, d)).join(entities(spark, d).select("id"), "id", "left_anti").select("id", "name", "cluster")


# ------------------------------------------------------------------ validation

# fixed values: the contract of a change
CHANGE_CONTRACT = {
    "type": "object", "additionalProperties": False, "required": ["id", "ts", "actor", "change", "entity_id", "reason"],
    "properties": {
        "id": {"type": "string", "pattern": "^lc-[a-z0-9]{12}$"}, "ts": {"type": "string", "format": "date-time"}, "actor": {"type": "string", "pattern": "^(desk|rep-[0-9]+|system:[a-z0-9_-]+)$"},
        "change": {"enum": [*ledger.STATUS_OF, "correct", "add_entity"]}, "entity_id": {"type": "string", "minLength": 3, "maxLength": 80, "pattern": "^[A-Za-z0-9_.:-]+$"},
        "reason": {"type": "string", "minLength": 3, "maxLength": 500}, "duplicate_of": {"type": "string", "pattern": "^[A-Za-z0-9_.:-]+$"}, "field": {"enum": ledger.CORRECTABLE},
        "value": {"type": ["string", "number"]}, "entity": {"type": "object"}, "evidence": {"type": "string", "maxLength": 500},
    },
}


@catalog.query(
    sql="""SELECT DISTINCT ord, list_filter([CASE WHEN reason IS NULL THEN '$: lacks reason' END, CASE WHEN id IS NULL THEN '$: lacks id' END, CASE WHEN ts IS NULL THEN '$: lacks ts' END, CASE WHEN actor IS NULL THEN '$: lacks actor' END,
             CASE WHEN change IS NULL THEN '$: lacks change' END, CASE WHEN entity_id IS NULL THEN '$: lacks entity_id' END,
             CASE WHEN NOT regexp_matches(actor, '^(desk|rep-[0-9]+|system:[a-z0-9_-]+)$') THEN '$.actor: pattern' END,
             CASE WHEN NOT regexp_matches(id, '^lc-[a-z0-9]{12}$') THEN '$.id: pattern' END, CASE WHEN length(reason) < 3 THEN '$.reason: too short' END, CASE WHEN length(reason) > 500 THEN '$.reason: too long' END,
             CASE WHEN length(evidence) > 500 THEN '$.evidence: too long' END, CASE WHEN length(entity_id) < 3 THEN '$.entity_id: too short' END, CASE WHEN length(entity_id) > 80 THEN '$.entity_id: too long' END,
             CASE WHEN NOT regexp_matches(entity_id, '^[A-Za-z0-9_.:-]+$') THEN '$.entity_id: pattern' END, CASE WHEN NOT regexp_matches(duplicate_of, '^[A-Za-z0-9_.:-]+$') THEN '$.duplicate_of: pattern' END,
             CASE WHEN field NOT IN ('name', 'lat', 'lon', 'subindustry', 'parent') THEN '$.field: not one of the values' END,
             CASE WHEN change NOT IN ('mark_defunct', 'mark_not_a_fit', 'mark_assigned_elsewhere', 'mark_duplicate', 'reinstate', 'correct', 'add_entity') THEN '$.change: not one of the values' END,
             CASE WHEN json_type(entity) <> 'OBJECT' THEN '$.entity: not object' END,
             CASE WHEN NOT regexp_matches(ts, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z$') THEN '$.ts: no instant' END], lambda x: x IS NOT NULL) AS errors FROM ledger_change"""
)
def q50_validate_json(spark, d):
    """The ledger's JSON lines against their contract (every rule it has, in the twin as well)."""
    c = table(spark, d, "ledger_change")
    raw = F.to_json(F.struct("id", "ts", "actor", "change", "entity_id", "reason", "duplicate_of", "field", "value", "evidence", F.try_parse_json("entity").alias("entity")))
    checked = validate.validate(c.select("ord", raw.alias("raw")), "raw", CHANGE_CONTRACT)
    rank = F.expr("array_sort(errors, (l, r) -> CASE WHEN l LIKE '$: %' AND r NOT LIKE '$: %' THEN -1 WHEN r LIKE '$: %' AND l NOT LIKE '$: %' THEN 1 WHEN l < r THEN -1 WHEN l > r THEN 1 ELSE 0 END)")
    return checked.select("ord", rank.alias("errors")).distinct()


@catalog.query(
    sql="""SELECT DISTINCT id, ts, regexp_matches(ts, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z$') AS contract_form, try_cast(ts AS timestamptz) IS NOT NULL AS readable FROM logbook_event"""
)
def q51_validate_formats(spark, d):
    e = table(spark, d, "logbook_event").select("id", "ts").distinct()
    return e.select("id", "ts", F.col("ts").rlike(validate.INSTANT).alias("contract_form"), instant_micros("ts").isNotNull().alias("readable"))


@catalog.query(sql="SELECT id, count(*) AS n FROM ledger_change WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def q52_duplicate_ids(spark, d):
    return validate.repeated_ids(table(spark, d, "ledger_change"))


# ------------------------------------------------------------------ maps


@catalog.query(
    sql="""SELECT zone_id, flatten(list_transform(range(1, len(ring) + 1), lambda i: [
             round_even(ring[i].lon * 10000, 0)::bigint - CASE WHEN i > 1 THEN round_even(ring[i - 1].lon * 10000, 0)::bigint ELSE 0 END,
             round_even(ring[i].lat * 10000, 0)::bigint - CASE WHEN i > 1 THEN round_even(ring[i - 1].lat * 10000, 0)::bigint ELSE 0 END])) AS deltas FROM survey_zone"""
)
def q53_delta_encode(spark, d):
    return table(spark, d, "survey_zone").select("zone_id", geo_etl.delta_encode("ring").alias("deltas"))


@catalog.query(
    sql="""WITH e AS (SELECT zone_id, ring[i] AS p, ring[(i % len(ring)) + 1] AS q FROM (SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM survey_zone)),
             k AS (SELECT CASE WHEN p <= q THEN p ELSE q END AS a, CASE WHEN p <= q THEN q ELSE p END AS b FROM e WHERE p <> q)
         SELECT a.lon AS a_lon, a.lat AS a_lat, b.lon AS b_lon, b.lat AS b_lat FROM k GROUP BY a, b HAVING count(*) = 1"""
)
def q54_single_edges(spark, d):
    b = geo_etl.boundary_edges(table(spark, d, "survey_zone"), "zone_id")
    return b.select(F.col("a.lon").alias("a_lon"), F.col("a.lat").alias("a_lat"), F.col("b.lon").alias("b_lon"), F.col("b.lat").alias("b_lat"))


@catalog.query(
    sql="""SELECT plant_id, floor((lon + 180) / 360 * 512)::bigint AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512)::bigint AS y FROM power_plant"""
)
def q55_tile_xy(spark, d):
    x, y = geo_etl.tile("lat", "lon", 9)
    return table(spark, d, "power_plant").select("plant_id", x.alias("x"), y.alias("y"))


@catalog.query(
    sql="""WITH m AS (SELECT plant_id, (mw::bigint % 256) * 256.0::double + (plant_id[4:]::int % 256) + 0.5::double - 32768.0 AS metres FROM power_plant),
             v AS (SELECT plant_id, least(greatest(round_even((metres + 500.0) * 10.0, 0), 0), 65535)::int AS v FROM m) SELECT plant_id, v >> 8 AS high, v & 255 AS low FROM v"""
)
def q56_raster_quantise(spark, d):
    """Terrain decoding and 16-bit quantising over values made from the plants (the tables have no raster)."""
    p = table(spark, d, "power_plant")
    n = F.substring("plant_id", 4, 10).cast("int")
    metres = geo_etl.terrarium((F.bround("mw", 0).cast("long") % 256).cast("double"), n % 256, F.lit(128.0))
    high, low = geo_etl.quantise(metres)
    return p.select("plant_id", high.alias("high"), low.alias("low"))


@catalog.query(
    sql="""WITH p AS (SELECT zone_id, i - 1 AS i, ring[i] AS p FROM (SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM survey_zone)),
             q AS (SELECT *, p.lon BETWEEN -78.2 AND -76.6 AND p.lat BETWEEN 36.9 AND 38.4 AS ins FROM p),
             r AS (SELECT *, ins OR coalesce(lag(ins) OVER w, false) OR coalesce(lead(ins) OVER w, false) AS keep FROM q WINDOW w AS (PARTITION BY zone_id ORDER BY i)),
             s AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (PARTITION BY zone_id ORDER BY i) AS piece FROM r)
         SELECT zone_id, piece::bigint AS piece, count(*)::int AS points FROM s WHERE keep GROUP BY 1, 2 HAVING count(*) > 1"""
)
def q57_clip_islands(spark, d):
    c = geo_etl.clip_line(table(spark, d, "survey_zone"), "zone_id", "ring", *FRAME)
    return c.select("zone_id", "piece", F.size("line").alias("points"))


@catalog.query()
def q57_simplify(spark, d):
    z = table(spark, d, "survey_zone").select("zone_id", "ring")
    return z.select("zone_id", F.size("ring").alias("before"), F.size(geo_etl.simplify("ring", geo_etl.TOLERANCE["outline"])).alias("after"))


@catalog.query()
def q57_chained_rings(spark, d):
    z = table(spark, d, "survey_zone").select("zone_id", "ring")
    return geo_etl.chain_rings(geo_etl.ring_edges(z, "zone_id"), "zone_id").select("zone_id", "ring_no", F.size("ring").alias("points"))


@catalog.query(
    sql=LIVE_SQL + "," + LOG_SQL
    + """, t AS (SELECT id AS tap_id, entity_id, instant FROM ranked WHERE rank IS NOT NULL), c AS (SELECT entity_id, instant, max(struct_pack(o := ord, s := CASE change WHEN 'mark_defunct' THEN 'defunct' WHEN 'mark_not_a_fit' THEN 'not_a_fit'
          WHEN 'mark_assigned_elsewhere' THEN 'assigned_elsewhere' WHEN 'mark_duplicate' THEN 'duplicate' ELSE 'active' END)).s AS status FROM live WHERE field = 'status' GROUP BY 1, 2)
        SELECT t.tap_id, t.entity_id, coalesce(c.status, 'active') AS status FROM t ASOF LEFT JOIN c ON t.entity_id = c.entity_id AND t.instant >= c.instant"""
)
def q58_asof_state(spark, d):
    """Each tap with its entry's status as of that moment."""
    status = changes(spark, d).filter("field = 'status'").withColumn("status", ledger.status_column("change"))
    return progress.as_of_status(taps(spark, d), status).select("tap_id", "entity_id", "status")


# ------------------------------------------------------------------ windows over the event stream


@catalog.query(
    sql="""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
             s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
         SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k"""
)
def q59_session_windows(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@catalog.query(sql="SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def q60_tumbling_windows(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "users")


@catalog.query(
    sql="""SELECT zone_id, list_max(list_transform(ring, lambda p: p.lon)) >= -77.65 AND list_min(list_transform(ring, lambda p: p.lon)) <= -77.15 AND list_max(list_transform(ring, lambda p: p.lat)) >= 37.35
             AND list_min(list_transform(ring, lambda p: p.lat)) <= 37.65 AS meets FROM survey_zone"""
)
def q72_box_meets(spark, d):
    """Zones whose box meets a padded frame."""
    return table(spark, d, "survey_zone").select("zone_id", geo_etl.box_meets("ring", -77.6, 37.4, -77.2, 37.6, 0.05).alias("meets"))


@catalog.query(
    sql="""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(address, '\\bRiv\\b\\.?', 'River', 'g'), '\\bCrk\\b\\.?', 'Creek', 'g'), '\\bLk\\b\\.?', 'Lake', 'g'), '\\bResv\\b\\.?', 'Reservoir', 'g'), '\\bBr\\b\\.?', 'Branch', 'g') AS written,
             CASE WHEN starts_with(road, 'I-') THEN 'interstate' WHEN regexp_matches(road, '^U\\.?S\\.? ') THEN 'us' WHEN regexp_matches(road, '^(State|VA|SR) ') THEN 'state' END AS class
           FROM (SELECT id, address, trim(CASE band WHEN 1 THEN 'I-' WHEN 2 THEN 'US ' WHEN 3 THEN 'VA ' ELSE '' END || regexp_extract(address, '^[0-9]+')) AS road FROM (SELECT DISTINCT ON (id) id, address, band FROM entity WHERE id IS NOT NULL) WHERE address IS NOT NULL)"""
)
def q73_road_and_water_names(spark, d):
    """Classes of road names made from bands and house numbers, and addresses with short water names written out."""
    e = entities(spark, d).filter("address IS NOT NULL").select("id", "address", F.expr("trim(concat(CASE band WHEN 1 THEN 'I-' WHEN 2 THEN 'US ' WHEN 3 THEN 'VA ' ELSE '' END, regexp_extract(address, '^[0-9]+', 0)))").alias("road"))
    return e.select("id", geo_etl.water_name("address").alias("written"), geo_etl.road_class("road").alias("class"))


@catalog.query(sql="SELECT DISTINCT label AS jurisdiction FROM place_ref WHERE kind IN ('county', 'city') AND label NOT IN (SELECT jurisdiction FROM entity WHERE jurisdiction IS NOT NULL AND kind = 'distributor')")
def q74_uncovered(spark, d):
    """Counties and cities whose official name no distributor's entry carries."""
    places = table(spark, d, "place_ref").filter("kind IN ('county', 'city')").select(F.col("label").alias("jurisdiction"))
    return geo_etl.uncovered(places, entities(spark, d).filter("kind = 'distributor'").select("jurisdiction"), "jurisdiction")


CONTRACT = {
    "type": "object", "required": ["id", "name"], "properties": {
        "id": {"type": "string", "pattern": "^C[0-9]+-"}, "name": {"type": "string", "minLength": 12, "maxLength": 40}, "band": {"enum": [1, 2, 3]}, "miles": {"type": "number", "minimum": 20, "maximum": 90},
        "facts": {"$ref": "#/definitions/facts"}, "sources": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["as_of"]}},
    },
    "definitions": {"facts": {"type": "object", "properties": {"employees": {"type": "integer", "minimum": 5}, "cogen": {"const": False}}}},
}


@catalog.query(
    sql="""SELECT id, (NOT regexp_matches(id, '^C[0-9]+-'))::int + (name IS NULL)::int + coalesce((length(name) < 12)::int, 0) + coalesce((length(name) > 40)::int, 0) + coalesce((band NOT IN (1, 2, 3))::int, 0)
           + coalesce((miles < 20)::int, 0) + coalesce((miles > 90)::int, 0) + coalesce((facts.employees < 5)::int, 0) + coalesce((facts.cogen)::int, 0) + coalesce((len(sources) < 1)::int, 0) + coalesce((len(sources) > 2)::int, 0)
           + coalesce(len(list_filter(sources, lambda s: s.as_of IS NULL)), 0) AS errors FROM (SELECT DISTINCT ON (id) * FROM entity WHERE id IS NOT NULL)"""
)
def q75_contract_keywords(spark, d):
    """Number of errors of each entry's JSON against a contract of patterns, lengths, ranges, constants, references and items."""
    raw = F.to_json(F.struct("id", "name", "band", "miles", F.struct("facts.employees", "facts.cogen").alias("facts"), "sources"))
    e = entities(spark, d).select("id", raw.alias("raw"))
    return validate.validate(e, "raw", CONTRACT).select("id", F.size("errors").cast("long").alias("errors"))


# ------------------------------------------------------------------ stores, manifest, streams


@catalog.query()
def q65_manifest(spark, d):
    from ..sources.stores import manifest

    return manifest(spark, f"{d}/power_plant.parquet", f"{d}/place_ref.parquet", f"{d}/survey_zone.parquet")


@catalog.query(sql="SELECT action, count(*) AS n FROM (SELECT DISTINCT id, action FROM logbook_event WHERE id IS NOT NULL) GROUP BY action")
def q66_stream_activity(spark, d):
    """Activity counted by a streaming query over the log's files, repeated deliveries dropped."""
    from ..streaming.activity import count_actions

    return count_actions(spark, f"{d}/logbook_event.parquet")


MET_SQL = """, seen AS (SELECT DISTINCT p.cluster, a.instant FROM adv a JOIN ent p ON p.id = a.entity_id),
 held AS (SELECT seen.cluster, seen.instant, t.done, t.size FROM seen ASOF JOIN tl t ON seen.cluster = t.cluster AND seen.instant >= t.instant),
 met AS (SELECT cluster, m.share AS share, m.points AS points, min(instant) AS instant FROM held, (VALUES (0.1::double, 5), (0.25, 15), (0.5, 30), (0.75, 50)) m(share, points) WHERE size > 0 AND done / size >= m.share GROUP BY 1, 2, 3)"""


@catalog.query(
    sql=SHARE_SQL + MET_SQL + SIGNAL_TAIL + "," + TRIAGE_SQL.replace(" log AS", " plain AS").replace("FROM log)", "FROM plain)") + COUNTER_SQL + "," + LADDER_SQL
    + """, rev AS (SELECT entity_id, min(struct_pack(i := instant, o := ord, id := id)) AS f FROM act WHERE a = 'reviewed' AND entity_id IS NOT NULL AND instant IS NOT NULL GROUP BY 1),
 reviewed AS (SELECT count(*) FILTER ((f.i // 1000000 - received // 1000000) / 86400 BETWEEN 0 AND 3) AS p FROM rev JOIN sig ON sig.entity_id = rev.entity_id WHERE received IS NOT NULL),
 pts AS (SELECT (SELECT coalesce(sum(points), 0)::bigint FROM points) AS stage, (SELECT coalesce(sum(points), 0)::bigint FROM met) AS milestone, (SELECT p FROM reviewed) AS review),
 registry AS (SELECT e.*, coalesce(s.status, 'active') AS status FROM entry e LEFT JOIN status s ON s.entity_id = e.id)
 SELECT what, value, n FROM counted UNION ALL SELECT 'entities_by_kind', kind, count(*) FROM registry GROUP BY 2 UNION ALL SELECT 'entities_by_status', status, count(*) FROM registry GROUP BY 2
 UNION ALL SELECT 'entities_by_existence', existence, count(*) FROM registry GROUP BY 2 UNION ALL SELECT 'entities_visible', NULL, count(*) FROM registry WHERE scope = 'core' AND status = 'active'
 UNION ALL SELECT 'points', 'stages', stage FROM pts UNION ALL SELECT 'points', 'milestones', milestone FROM pts UNION ALL SELECT 'points', 'reviews', review FROM pts UNION ALL SELECT 'points', 'total', stage + milestone + review FROM pts
 UNION ALL SELECT 'rank', NULL, (SELECT max(level) FROM ladder, pts WHERE min_points <= stage + milestone + review)::bigint
 UNION ALL SELECT 'milestones', cluster, count(*) FROM met GROUP BY 2 UNION ALL SELECT 'taps', NULL, count(*) FROM ranked WHERE rank IS NOT NULL
 UNION ALL SELECT 'active_facilities', cluster, count(*) FROM registry WHERE kind = 'facility' AND scope = 'core' AND status = 'active' GROUP BY 2"""
)
def q67_compose(spark, d):
    """The composed state as counters: registry, signals, taps, milestones, clusters, points and rank."""
    from .compose import compose

    s = compose(spark, d)
    one = lambda what, value, n: F.struct(F.lit(what).alias("what"), F.lit(value).cast("string").alias("value"), F.col(n).cast("long").alias("n"))
    totals = s["totals"].crossJoin(s["rank"].select("level"))  # one row each
    totals = totals.select(F.explode(F.array(one("points", "stages", "stages"), one("points", "milestones", "milestones"), one("points", "reviews", "reviews"), one("points", "total", "points"), one("rank", None, "level"))).alias("x")).select("x.*")
    cols = lambda df, what, value: df.select(F.lit(what).alias("what"), (F.col(value) if value else F.lit(None).cast("string")).alias("value"), F.col("n").cast("long").alias("n"))
    by = cols(s["milestones"].groupBy("cluster").agg(F.count("*").alias("n")), "milestones", "cluster")
    active = cols(s["clusters"].select("cluster", F.col("entities").alias("n")), "active_facilities", "cluster")
    return s["counters"].unionByName(totals).unionByName(by).unionByName(active).unionByName(cols(s["taps"].agg(F.count("*").alias("n")), "taps", None))


@catalog.query(
    sql=SHARE_SQL + MET_SQL
    + """ SELECT instant, entity_id AS subject, ['surveyed', 'landfall', 'established', 'anchored'][rank] AS what, points::bigint AS points FROM points
 UNION ALL SELECT instant, cluster, 'share ' || share::double::varchar, points::bigint FROM met ORDER BY instant DESC, subject, what LIMIT 200"""
)
def q68_history(spark, d):
    """The last 200 stages and milestones."""
    return progress.history(paid(spark, d), cut(milestones_met(spark, d)))
