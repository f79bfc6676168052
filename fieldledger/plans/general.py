"""Queries of the general large-data operators: points near places, and the change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import instant_micros
from ..operators.changefeed import first_deliveries, resolve_newest_first
from ..operators.spatial import PointIndex, within_distance, within_region
from ..session import table
from .catalog import Catalog

catalog = Catalog()

PLANT_MILES = 2.0
LAT_RANGE = (36.0, 39.6)
LON_RANGE = (-79.6, -74.8)
STATUS_OF = {  # fixed values of the change feed
    "mark_defunct": "defunct",
    "mark_not_a_fit": "not_a_fit",
    "mark_assigned_elsewhere": "assigned_elsewhere",
    "mark_duplicate": "duplicate",
    "reinstate": "active",
}


def placed_entities(spark, d):
    """Entities inside the territory, western longitude assured; one row per id and place."""
    e = table(spark, d, "entity").select("id", "lat", (-F.abs("lon")).alias("lon"))
    return e.filter(F.col("lat").between(*LAT_RANGE) & F.col("lon").between(*LON_RANGE)).dropDuplicates()


@catalog.query(
    sql="""
WITH e AS (SELECT DISTINCT id, lat, -abs(lon) AS lon FROM entity
           WHERE id IS NOT NULL AND lat BETWEEN 36.0 AND 39.6 AND -abs(lon) BETWEEN -79.6 AND -74.8),
 edge AS (SELECT zone_id, i, ring[i] AS p, ring[(i % len(ring)) + 1] AS q, len(ring) AS n
          FROM (SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM survey_zone)),
 hit AS (SELECT e.id, z.zone_id, count(*) AS n FROM e JOIN edge z
         ON (z.p.lat > e.lat) <> (z.q.lat > e.lat)
        AND e.lon < (z.q.lon - z.p.lon) * (e.lat - z.p.lat) / nullif(z.q.lat - z.p.lat, 0) + z.p.lon GROUP BY 1, 2)
SELECT DISTINCT e.id AS entity_id, p.plant_id AS target_id FROM e JOIN power_plant p
  ON abs(e.lat - p.lat) < 0.03 AND sqrt(pow((e.lat - p.lat) * 69, 2) + pow((e.lon - p.lon) * 69 * cos(radians(37.7)), 2)) <= 2.0
UNION ALL SELECT DISTINCT id, zone_id FROM hit WHERE n % 2 = 1
"""
)
def p1_found(spark, d):
    e = PointIndex(placed_entities(spark, d), "id")
    plants = table(spark, d, "power_plant").select("plant_id", "lat", "lon")
    zones = table(spark, d, "survey_zone").select("zone_id", "ring")
    near = within_distance(e, plants, PLANT_MILES, "id", "plant_id")
    inside = within_region(e, zones, "id", "zone_id")
    return near.unionByName(inside).select(F.col("l_id").alias("entity_id"), F.col("r_id").alias("target_id")).distinct()


def effective_changes(spark, d):
    """Each change once, as (entity_id, field, instant, ord, change_id, value), without those of no effect."""
    feed = table(spark, d, "ledger_change").select("ord", "id", "ts", "change", "entity_id", "duplicate_of", "field", "value", "reason")
    once = first_deliveries(feed, "id", "ord").withColumn("instant", instant_micros("ts"))
    field = (
        F.when(F.col("change") == "add_entity", "record")
        .when((F.col("change") == "mark_duplicate") & (F.col("duplicate_of").isNull() | (F.col("duplicate_of") == F.col("entity_id"))), None)
        .when(F.col("change").isin(*STATUS_OF), "status")
        .when((F.col("change") == "correct") & F.col("value").isNotNull(), F.col("field"))
    )
    live = once.withColumn("field", field).filter("field IS NOT NULL AND entity_id IS NOT NULL AND instant IS NOT NULL")
    return live.select("entity_id", "field", "instant", "ord", F.col("id").alias("change_id"), "change", "value", "reason", "duplicate_of")


def last_changes(spark, d):
    """The deciding change of each (entity, field), for entities that exist or were added by the feed."""
    last = resolve_newest_first(effective_changes(spark, d), ["entity_id", "field"], ["instant", "ord"])
    known = table(spark, d, "entity").select(F.col("id").alias("entity_id")).unionByName(last.filter("field = 'record'").select("entity_id"))
    return last.join(known, "entity_id", "left_semi")


@catalog.query(
    sql="""
WITH once AS (SELECT id, arg_min(struct_pack(ts := ts, change := change, entity_id := entity_id, duplicate_of := duplicate_of,
                                             field := field, value := value), ord) AS r, min(ord) AS ord
              FROM ledger_change WHERE id IS NOT NULL GROUP BY id),
 live AS (SELECT id, ord, epoch_us(try_cast(r.ts AS timestamptz)) AS instant, r.entity_id AS entity_id,
   CASE WHEN r.change = 'add_entity' THEN 'record'
        WHEN r.change = 'mark_duplicate' AND (r.duplicate_of IS NULL OR r.duplicate_of = r.entity_id) THEN NULL
        WHEN r.change IN ('mark_defunct', 'mark_not_a_fit', 'mark_assigned_elsewhere', 'mark_duplicate', 'reinstate') THEN 'status'
        WHEN r.change = 'correct' AND r.value IS NOT NULL THEN r.field END AS field FROM once),
 known AS (SELECT id FROM entity UNION SELECT entity_id FROM live WHERE field = 'record')
SELECT entity_id, field, arg_max(id, struct_pack(i := instant, o := ord)) AS change_id
FROM live WHERE field IS NOT NULL AND instant IS NOT NULL AND entity_id IN (SELECT id FROM known) GROUP BY entity_id, field
"""
)
def p3_found(spark, d):
    return last_changes(spark, d).select("entity_id", "field", "change_id")


@catalog.query(
    sql="""
WITH once AS (SELECT id, arg_min(struct_pack(ts := ts, change := change, entity_id := entity_id, duplicate_of := duplicate_of,
                                             field := field, value := value), ord) AS r, min(ord) AS ord
              FROM ledger_change WHERE id IS NOT NULL GROUP BY id),
 live AS (SELECT ord, epoch_us(try_cast(r.ts AS timestamptz)) AS instant, r.entity_id AS entity_id, r.change AS change, r.value AS value,
   CASE WHEN r.change = 'add_entity' THEN 'record'
        WHEN r.change = 'mark_duplicate' AND (r.duplicate_of IS NULL OR r.duplicate_of = r.entity_id) THEN NULL
        WHEN r.change IN ('mark_defunct', 'mark_not_a_fit', 'mark_assigned_elsewhere', 'mark_duplicate', 'reinstate') THEN 'status'
        WHEN r.change = 'correct' AND r.value IS NOT NULL THEN r.field END AS field FROM once),
 last AS (SELECT entity_id, field, arg_max(struct_pack(change := change, value := value), struct_pack(i := instant, o := ord)) AS r
          FROM live WHERE field IS NOT NULL AND instant IS NOT NULL GROUP BY entity_id, field),
 wide AS (SELECT entity_id, count(*) FILTER (field = 'record') AS added, max(r.change) FILTER (field = 'status') AS status,
   max(r.value) FILTER (field = 'name') AS name, max(r.value) FILTER (field = 'parent') AS parent,
   max(r.value) FILTER (field = 'subindustry') AS subindustry, max(r.value) FILTER (field = 'lat') AS lat, max(r.value) FILTER (field = 'lon') AS lon
   FROM last GROUP BY entity_id),
 base AS (SELECT DISTINCT id AS entity_id FROM entity WHERE id IS NOT NULL)
SELECT coalesce(b.entity_id, w.entity_id) AS entity_id,
  CASE w.status WHEN 'mark_defunct' THEN 'defunct' WHEN 'mark_not_a_fit' THEN 'not_a_fit' WHEN 'mark_assigned_elsewhere' THEN 'assigned_elsewhere'
    WHEN 'mark_duplicate' THEN 'duplicate' ELSE 'active' END AS status,
  w.name AS name_now, w.parent AS parent_now, w.subindustry AS subindustry_now, try_cast(w.lat AS double) AS lat_now, try_cast(w.lon AS double) AS lon_now,
  CASE WHEN b.entity_id IS NULL THEN 'added' WHEN w.entity_id IS NULL THEN 'untouched' ELSE 'changed' END AS origin
FROM base b FULL JOIN wide w ON b.entity_id = w.entity_id WHERE b.entity_id IS NOT NULL OR w.added > 0
"""
)
def p3_state(spark, d):
    """Every entry as the feed leaves it: corrected fields (null: not corrected), status, and whether it was touched."""
    last = last_changes(spark, d)
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))  # noqa: E731  one row a field
    wide = last.groupBy("entity_id").agg(
        pick("status", "change").alias("change"), pick("name", "value").alias("name_now"), pick("parent", "value").alias("parent_now"),
        pick("subindustry", "value").alias("subindustry_now"), pick("lat", "value").alias("lat_now"), pick("lon", "value").alias("lon_now"),
    )
    status = F.coalesce(*[F.when(F.col("change") == k, v) for k, v in STATUS_OF.items()], F.lit("active"))
    base = table(spark, d, "entity").select(F.col("id").alias("entity_id")).filter("entity_id IS NOT NULL").distinct()
    touched = wide.join(base.withColumn("in_base", F.lit(True)), "entity_id", "left").select(
        "entity_id", status.alias("status"), "name_now", "parent_now", "subindustry_now",
        F.expr("try_cast(lat_now AS double)").alias("lat_now"), F.expr("try_cast(lon_now AS double)").alias("lon_now"),
        F.when(F.col("in_base"), "changed").otherwise("added").alias("origin"),
    )
    untouched = base.join(wide, "entity_id", "left_anti").select(
        "entity_id", F.lit("active").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in touched.dtypes[2:-1]], F.lit("untouched").alias("origin")
    )
    return touched.unionByName(untouched)
