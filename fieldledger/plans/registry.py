"""Queries of the reference operators on the registry side: placing, folding, matching, scoring, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import flag_tokens, fold_tokens, truthy
from ..operators import resolve, score
from ..session import cut, free, pack, table
from .catalog import Catalog

catalog = Catalog()

# this project's exclusion rules, in order; the first that fits wins
RULES = [
    {"id": "municipal", "enabled": True, "match_sector": ["municipal-water", "municipal-wastewater"]},
    {"id": "off_rule", "enabled": False, "match_text": "plant"},
    {"id": "quarries", "enabled": True, "match_text": r"\b(quarry|qry|aggregates)\b"},
    {"id": "warehouses", "enabled": True, "match_sector": ["warehouse"], "match_text": r"\b(warehouse|whse|logistics)\b"},
]
HOME = (37.54, -77.44)
LON_MILES = "cos(radians(37.7))"
DIST = "sqrt(pow(({a}.lat - {b}.lat) * 69, 2) + pow(({a}.lon - {b}.lon) * 69 * cos(radians(37.7)), 2))"
FOLD = "list_sort(list_filter(list_distinct(regexp_extract_all(upper(coalesce({c}, '')), '[A-Z0-9]{{3,}}')), lambda x: NOT list_contains(['INC','LLC','CORP','CORPORATION','COMPANY','PLANT','MILL','STATION','FACILITY','FACILITIES','SYSTEMS','SYSTEM','USA','VIRGINIA','THE','AND','HOLDINGS','PRODUCTS','SERVICE','SERVICES','GROUP','LIMITED','PARTNERSHIP','OPERATING','INCORPORATED','CENTER','DATA'], x)))"
FLAG = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]{{4,}}')), lambda x: NOT list_contains(['plant','mill','works','corp','company','incorporated','center','centre','data','facility','systems','group','services','virginia','station'], x))"


def entities(spark, d):
    """Registry rows once an id (repeated deliveries are equal)."""
    return table(spark, d, "entity").filter("id IS NOT NULL").dropDuplicates(["id"])


def site_records(spark, d):
    return table(spark, d, "site_record").filter("rec_id IS NOT NULL").dropDuplicates(["rec_id"])


JURIS_SQL = """
WITH dim AS (SELECT label, lower(short_name) AS k, kind = 'city' AS is_city, cluster FROM place_ref WHERE kind IN ('county', 'city')),
 e AS (SELECT DISTINCT id, jurisdiction, city FROM entity WHERE id IS NOT NULL),
 v AS (SELECT DISTINCT raw, regexp_replace(trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')), '\\s*\\(city\\)$', ' city') AS s
       FROM (SELECT jurisdiction AS raw FROM e UNION SELECT city FROM e)),
 p AS (SELECT raw, s, regexp_matches(s, '\\s(city|cit)$') AS says, regexp_replace(s, '\\s+(city|cit)$', '') AS base FROM v),
 j AS (SELECT p.raw, coalesce(x.label, CASE WHEN says THEN t.label END, CASE WHEN NOT says THEN b.label END, t.label) AS label,
              coalesce(x.cluster, CASE WHEN says THEN t.cluster END, CASE WHEN NOT says THEN b.cluster END, t.cluster) AS cluster
       FROM p LEFT JOIN dim x ON x.k = p.s AND NOT x.is_city LEFT JOIN dim b ON b.k = p.base AND NOT b.is_city LEFT JOIN dim t ON t.k = p.base AND t.is_city)
"""


@catalog.query(
    sql=JURIS_SQL
    + """SELECT e.id, coalesce(a.label, b.label) AS jurisdiction_now, coalesce(a.cluster, b.cluster) AS cluster_now
         FROM e LEFT JOIN j a ON a.raw = e.jurisdiction LEFT JOIN j b ON b.raw = e.city"""
)
def q01_jurisdiction_lookup(spark, d):
    dims = resolve.jurisdiction_dims(table(spark, d, "place_ref"))
    e = entities(spark, d).select("id", "jurisdiction", "city")
    e = resolve.official_jurisdiction(e, "jurisdiction", dims, "a")
    e = resolve.official_jurisdiction(e, "city", dims, "b")
    return e.select("id", F.coalesce("a", "b").alias("jurisdiction_now"), F.coalesce("a_cluster", "b_cluster").alias("cluster_now"))


@catalog.query(
    sql="""SELECT DISTINCT rec_id, lat, CASE WHEN lon > 0 THEN -lon ELSE lon END AS lon FROM site_record
           WHERE rec_id IS NOT NULL AND lat IS NOT NULL AND lat <> 0 AND lon IS NOT NULL AND lon <> 0
             AND (CASE WHEN lon > 0 THEN -lon ELSE lon END) >= -78.9 AND lat > 36.4 AND lat < 39.3"""
)
def q02_clean_bbox_sign(spark, d):
    return resolve.clean_coordinates(site_records(spark, d).select("rec_id", "lat", "lon"))


EXCLUDE_SQL = """
CASE WHEN sector IN ('municipal-water', 'municipal-wastewater') THEN 'municipal'
     WHEN regexp_matches(coalesce(name, '') || ' ' || coalesce(note, '') || ' ' || coalesce(sector, ''), '(?i)\\b(quarry|qry|aggregates)\\b') THEN 'quarries'
     WHEN sector IN ('warehouse') OR regexp_matches(coalesce(name, '') || ' ' || coalesce(note, '') || ' ' || coalesce(sector, ''), '(?i)\\b(warehouse|whse|logistics)\\b') THEN 'warehouses' END
"""


def _ruled(spark, d):
    return resolve.exclusion_rule(site_records(spark, d).select("rec_id", "name", "note", "sector"), RULES, ["name", "note", "sector"])


@catalog.query(sql=f"SELECT DISTINCT rec_id, {EXCLUDE_SQL} AS excluded_by FROM site_record WHERE rec_id IS NOT NULL")
def q03_exclusion_rules(spark, d):
    return _ruled(spark, d).select("rec_id", "excluded_by")


@catalog.query(sql=f"SELECT excluded_by, count(*) AS n FROM (SELECT DISTINCT rec_id, {EXCLUDE_SQL} AS excluded_by FROM site_record WHERE rec_id IS NOT NULL) WHERE excluded_by IS NOT NULL GROUP BY 1")
def q04_exclusion_counts(spark, d):
    return _ruled(spark, d).filter("excluded_by IS NOT NULL").groupBy("excluded_by").agg(F.count("*").alias("n"))


@catalog.query(
    sql="""SELECT id, name, existence, 'registry' AS source FROM (SELECT DISTINCT id, name, coalesce(existence, 'registry') AS existence FROM entity WHERE id IS NOT NULL)
           UNION ALL SELECT id, name, existence, source_name FROM (SELECT DISTINCT rec_id::varchar AS id, name, coalesce(existence, 'registry') AS existence, source_name FROM site_record WHERE rec_id IS NOT NULL)"""
)
def q05_union_sources_tagged(spark, d):
    from ..sources.stores import union_sources

    a = entities(spark, d).select("id", "name", F.coalesce("existence", F.lit("registry")).alias("existence"), F.lit("registry").alias("source"))
    b = site_records(spark, d).select(F.col("rec_id").cast("string").alias("id"), "name", F.coalesce("existence", F.lit("registry")).alias("existence"), F.col("source_name").alias("source"))
    return union_sources(a, b)


def _placed(spark, d):
    """Records with clean coordinates and `placed`, the official jurisdiction of their jurisdiction or city."""
    dims = resolve.jurisdiction_dims(table(spark, d, "place_ref"))
    r = site_records(spark, d).select(F.col("rec_id").alias("id"), "source_name", "sector", "lat", "lon", "jurisdiction", "city")
    r = resolve.clean_coordinates(r)
    r = resolve.official_jurisdiction(r, "jurisdiction", dims, "a")
    r = resolve.official_jurisdiction(r, "city", dims, "b")
    return r.withColumn("placed", F.coalesce("a", "b"))


def _unplaced_and_anchors(spark, d):
    r = _placed(spark, d)
    return r.filter("placed IS NULL"), r.filter("placed IS NOT NULL AND source_name = 'permit_registry'")


@catalog.query(
    sql=JURIS_SQL.replace("FROM entity WHERE id IS NOT NULL", "FROM (SELECT rec_id AS id, * FROM site_record) WHERE id IS NOT NULL")
    + """, r AS (SELECT DISTINCT rec_id AS id, source_name, lat, CASE WHEN lon > 0 THEN -lon ELSE lon END AS lon, jurisdiction, city FROM site_record
            WHERE rec_id IS NOT NULL AND lat <> 0 AND lon <> 0 AND (CASE WHEN lon > 0 THEN -lon ELSE lon END) >= -78.9 AND lat > 36.4 AND lat < 39.3),
         q AS (SELECT r.*, coalesce(a.label, b.label) AS placed FROM r LEFT JOIN j a ON a.raw = r.jurisdiction LEFT JOIN j b ON b.raw = r.city),
         m AS (SELECT u.id, w.id AS anchor_id, """
    + DIST.format(a="u", b="w")
    + """ AS dist FROM q u JOIN q w ON u.placed IS NULL AND w.placed IS NOT NULL AND w.source_name = 'permit_registry' AND abs(u.lat - w.lat) < 0.37),
         best AS (SELECT id, min(struct_pack(d := dist, a := anchor_id)) AS b FROM m WHERE dist < 25 GROUP BY id)
         SELECT id AS rec_id, b.a AS anchor_id, round(b.d, 4) AS dist FROM best"""
)
def q06_knn_anchor(spark, d):
    open_rows, anchors = _unplaced_and_anchors(spark, d)
    near = resolve.nearest_anchor(open_rows, anchors)
    return near.select(F.col("id").alias("rec_id"), "anchor_id", F.round("dist", 4).alias("dist"))


@catalog.query(
    sql=JURIS_SQL.replace("FROM entity WHERE id IS NOT NULL", "FROM (SELECT rec_id AS id, * FROM site_record) WHERE id IS NOT NULL")
    + """, r AS (SELECT DISTINCT rec_id AS id, source_name, sector, lat, CASE WHEN lon > 0 THEN -lon ELSE lon END AS lon, jurisdiction, city FROM site_record
            WHERE rec_id IS NOT NULL AND lat <> 0 AND lon <> 0 AND (CASE WHEN lon > 0 THEN -lon ELSE lon END) >= -78.9 AND lat > 36.4 AND lat < 39.3),
         q AS (SELECT r.*, coalesce(a.label, b.label) AS placed FROM r LEFT JOIN j a ON a.raw = r.jurisdiction LEFT JOIN j b ON b.raw = r.city),
         k AS (SELECT id, min(struct_pack(sector := sector, lat := lat, lon := lon, placed := placed)) AS x FROM q GROUP BY id),
         m AS (SELECT u.id, min("""
    + DIST.format(a="u", b="w")
    + """) AS dist FROM (SELECT id, x.lat AS lat, x.lon AS lon FROM k WHERE x.placed IS NULL) u JOIN q w ON w.placed IS NOT NULL AND w.source_name = 'permit_registry' AND abs(u.lat - w.lat) < 0.37 GROUP BY u.id),
         n AS (SELECT k.id, x.sector AS sector, CASE WHEN x.placed IS NULL AND coalesce(m.dist >= 2, true) THEN 'out_of_territory' ELSE 'core' END AS scope FROM k LEFT JOIN m USING (id))
         SELECT id AS rec_id, CASE WHEN sector IN ('municipal-water', 'municipal-wastewater') AND scope <> 'out_of_territory' THEN 'out_of_portfolio' ELSE scope END AS scope FROM n"""
)
def q06_scope_of_rows(spark, d):
    """Scope of every record: without a jurisdiction or a placed record within 2 miles out of the territory but kept; municipal sectors out of the portfolio."""
    r = _placed(spark, d).groupBy("id").agg(F.min(F.struct("sector", "lat", "lon", "placed")).alias("x")).select("id", "x.*", F.lit("core").alias("scope"))
    anchors = _unplaced_and_anchors(spark, d)[1]
    return resolve.municipal_scope(resolve.place_rows(r, "placed", anchors, 2.0)).select(F.col("id").alias("rec_id"), "scope")


def _sites(spark, d):
    return entities(spark, d).select("id", "name", "lat", "lon", "sector")


MATCH_SQL = (
    f"""WITH p AS (SELECT *, {FOLD.format(c='name')} AS t FROM power_plant WHERE lat IS NOT NULL AND lon IS NOT NULL),
 s AS (SELECT *, {FOLD.format(c='name')} AS t FROM (SELECT DISTINCT id, name, lat, lon, sector FROM entity WHERE id IS NOT NULL AND lat <> 0 AND lon <> 0)),
 m AS (SELECT p.plant_id, s.id, len(list_intersect(p.t, s.t)) * 2 + CASE WHEN s.sector IN ('power-generation', 'district-energy') THEN 10 ELSE 0 END AS score
       FROM p JOIN s ON abs(p.lat - s.lat) < 0.04 AND """
    + DIST.format(a="p", b="s")
    + """ <= 2.0 AND list_has_any(p.t, s.t)),
 best AS (SELECT plant_id, min(struct_pack(s := -score, id := id)) AS b FROM m GROUP BY plant_id)"""
)


@catalog.query(sql=MATCH_SQL + " SELECT plant_id, b.id AS id, (-b.s)::int AS score FROM best")
def q07_best_match_score(spark, d):
    return resolve.best_match(table(spark, d, "power_plant"), _sites(spark, d)).select("plant_id", "id", F.col("score").cast("int").alias("score"))


NEAR_SQL = f"""WITH e AS (SELECT DISTINCT id, lat, lon FROM entity WHERE id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL),
 pair AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.01 AND {DIST.format(a='a', b='b')} <= 0.3)"""


@catalog.query(sql=NEAR_SQL + " SELECT e.id, count(p.o)::bigint AS links FROM e LEFT JOIN (SELECT a AS id, b AS o FROM pair UNION ALL SELECT b, a FROM pair) p ON p.id = e.id GROUP BY e.id")
def q08_colocated_links(spark, d):
    """Per entry the number of others within 0.3 miles: links are counted, never listed."""
    return resolve.colocation_links(entities(spark, d).select("id", "lat", "lon"))


GROUP_SQL = (
    NEAR_SQL.replace("WITH e AS", "WITH RECURSIVE e AS").replace("SELECT DISTINCT id, lat, lon FROM entity", "SELECT id, min(struct_pack(lat := lat, lon := lon)).lat AS lat, min(struct_pack(lat := lat, lon := lon)).lon AS lon FROM entity").replace("lon IS NOT NULL)", "lon IS NOT NULL GROUP BY id)", 1)
    + """, nbr AS (SELECT a AS id, b AS o FROM pair UNION ALL SELECT b, a FROM pair), m AS (SELECT id, min(o) AS m FROM nbr GROUP BY id),
 f AS (SELECT x.id, CASE WHEN x.m < x.id THEN x.m WHEN y.m < x.id THEN y.m END AS nxt FROM m x JOIN m y ON y.id = x.m),
 walk(id, cur) AS (SELECT id, id FROM f UNION ALL SELECT w.id, f.nxt FROM walk w JOIN f ON f.id = w.cur WHERE f.nxt IS NOT NULL),
 grp AS (SELECT id, min(cur) AS site_group FROM walk GROUP BY id)"""
)


@catalog.query(sql=GROUP_SQL + " SELECT id, site_group FROM grp")
def q09_colocated_groups(spark, d):
    return resolve.colocation_groups(entities(spark, d).select("id", "lat", "lon"))


@catalog.query(
    sql=GROUP_SQL
    + """, nm AS (SELECT id, min(name) AS name FROM entity GROUP BY id), small AS (SELECT site_group FROM grp GROUP BY 1 HAVING count(*) <= 8)
        SELECT a.id, list(nm.name ORDER BY b.id) AS colocated FROM grp a JOIN small USING (site_group) JOIN grp b ON b.site_group = a.site_group AND b.id <> a.id JOIN nm ON nm.id = b.id GROUP BY a.id"""
)
def q09_colocated_names(spark, d):
    e = entities(spark, d).select("id", "name", "lat", "lon")
    return resolve.colocated_names(cut(resolve.colocation_groups(e)), e)


@catalog.query(sql=f"SELECT token, count(*) AS df FROM (SELECT unnest({FLAG.format(c='name')}) AS token FROM (SELECT DISTINCT id, name FROM entity WHERE id IS NOT NULL)) GROUP BY token")
def q10_token_df(spark, d):
    return resolve.token_frequency(entities(spark, d).select("name"))


@catalog.query(
    sql=f"""WITH e AS (SELECT DISTINCT id, name, lat, lon, jurisdiction, city FROM entity WHERE id IS NOT NULL),
 gone AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(city, '') || ' ' || coalesce(jurisdiction, '')), '[a-z0-9]{{4,}}')) AS token FROM e),
 t AS (SELECT id, token FROM (SELECT id, unnest({FLAG.format(c='name')}) AS token FROM e) WHERE token NOT IN (SELECT token FROM gone)),
 df AS (SELECT token, count(*) AS n FROM t GROUP BY token),
 s AS (SELECT t.id, list(token) AS t, list(CASE WHEN n <= 4 THEN token END) AS rare FROM t JOIN df USING (token) GROUP BY t.id),
 r AS (SELECT e.id, e.lat, e.lon, e.jurisdiction, s.t, list_filter(s.rare, lambda x: x IS NOT NULL) AS rare FROM e JOIN s USING (id) WHERE lat IS NOT NULL AND lon IS NOT NULL)
 SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM r a JOIN r b
   ON a.id < b.id AND a.jurisdiction IS NOT DISTINCT FROM b.jurisdiction AND abs(a.lat - b.lat) < 0.02 AND {DIST.format(a='a', b='b')} <= 1.2
  AND list_has_any(a.t, b.t) AND (list_has_any(a.rare, b.rare) OR len(list_intersect(a.t, b.t)) >= 2)
  AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.55"""
)
def q11_near_duplicates(spark, d):
    return resolve.near_duplicates(entities(spark, d).select("id", "name", "lat", "lon", "jurisdiction", "city"))


def _ordered_records(spark, d):
    """Records with `ord`: permit registry first, then the recall sweep, then the rest, longer notes and lower numbers first."""
    r = resolve.clean_coordinates(table(spark, d, "site_record").filter("rec_id IS NOT NULL"))
    weight = F.when(F.col("source_name") == "permit_registry", 10000).when(F.col("source_name") == "recall_sweep", 5000).otherwise(0) + F.when(F.col("existence") == "registry", 200).otherwise(0)
    first = F.lpad((F.lit(99_999) - weight - F.length(F.coalesce("note", F.lit("")))).cast("string"), 6, "0")
    # before deliveries are joined, so that notes are not shuffled where only their length is asked for
    return r.withColumn("ord", F.concat_ws("|", first, F.lpad(F.col("rec_id").cast("string"), 19, "0"))).dropDuplicates(["rec_id"])


def _leaders(spark, d):
    """Records and their leaders. Only what matching reads is written; repeated deliveries are equal, so the records may be read again."""
    rows = _ordered_records(spark, d)
    few = pack(rows.select("ord", "name", "lat", "lon", "coord_precision"))
    matches = resolve.fold_matches(few)
    leaders = resolve.greedy_leaders(rows, matches)
    free(few, matches)
    return rows, leaders


# the pass in order, row by row, with the rows kept so far as a list
FOLDED_SQL = (
    f"""WITH RECURSIVE s AS (SELECT DISTINCT ON (rec_id) * FROM site_record WHERE rec_id IS NOT NULL),
 c AS (SELECT rec_id, name, lat, CASE WHEN lon > 0 THEN -lon ELSE lon END AS lon, coalesce(coord_precision = 'site', false) AS exact, source_name, note, parent, employees, sqft, operator,
   lpad((99999 - CASE source_name WHEN 'permit_registry' THEN 10000 WHEN 'recall_sweep' THEN 5000 ELSE 0 END - CASE WHEN existence = 'registry' THEN 200 ELSE 0 END - length(coalesce(note, '')))::varchar, 6, '0') || '|' || lpad(rec_id::varchar, 19, '0') AS ord
   FROM s WHERE lat <> 0 AND lon <> 0 AND (CASE WHEN lon > 0 THEN -lon ELSE lon END) >= -78.9 AND lat > 36.4 AND lat < 39.3),
 r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS n, {FOLD.format(c='name')} AS t FROM c),
 p AS (SELECT a.n AS a, b.n AS b, a.exact AND b.exact AS both_exact, {DIST.format(a='a', b='b')} AS dist, len(list_intersect(a.t, b.t)) AS common, len(a.t) AS la, len(b.t) AS lb
   FROM r a JOIN r b ON a.n < b.n AND abs(a.lat - b.lat) <= 0.06 AND abs(a.lon - b.lon) <= 0.06 AND list_has_any(a.t, b.t)),"""
    + """
 m AS MATERIALIZED (SELECT a, b FROM p WHERE CASE WHEN both_exact THEN dist <= 0.6 AND (common / (la + lb - common) >= 0.34 OR common = least(la, lb)) ELSE dist <= 3.0 AND (common / (la + lb - common) >= 0.5 OR common = least(la, lb)) END),
 nb AS MATERIALIZED (SELECT r.n, coalesce(list(m.a) FILTER (m.a IS NOT NULL), []) AS earlier FROM r LEFT JOIN m ON m.b = r.n GROUP BY r.n),
 walk(n, kept) AS (SELECT 0::bigint, []::bigint[] UNION ALL SELECT nb.n, CASE WHEN list_has_any(walk.kept, nb.earlier) THEN walk.kept ELSE list_append(walk.kept, nb.n) END FROM walk JOIN nb ON nb.n = walk.n + 1),
 kept AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)),
 lead AS (SELECT r.n, coalesce(k.n, l.a) AS leader FROM r LEFT JOIN kept k ON k.n = r.n LEFT JOIN (SELECT m.b, min(m.a) AS a FROM m JOIN kept ON kept.n = m.a GROUP BY m.b) l ON l.b = r.n)"""
)


@catalog.query(sql=FOLDED_SQL + " SELECT a.rec_id, b.rec_id AS leader_id FROM lead JOIN r a ON a.n = lead.n JOIN r b ON b.n = lead.leader")
def q12_greedy_dedupe(spark, d):
    """Each record and the record it is folded into (itself if kept)."""
    rows, leaders = _leaders(spark, d)
    at = rows.select("ord", "rec_id")
    return leaders.join(at, "ord").join(at.select(F.col("ord").alias("leader"), F.col("rec_id").alias("leader_id")), "leader").select("rec_id", "leader_id")


@catalog.query(sql=FOLDED_SQL + " SELECT a.name AS donor, b.name AS leader FROM lead JOIN r a ON a.n = lead.n JOIN r b ON b.n = lead.leader WHERE lead.n <> lead.leader")
def q12_fold_log(spark, d):
    """Who was folded into whom, by name."""
    rows, leaders = _leaders(spark, d)
    return resolve.fold_log(rows, leaders).select("donor", "leader")


@catalog.query(
    sql=FOLDED_SQL
    + """ SELECT max(r.name) FILTER (r.n = leader) AS name, max(r.lat) FILTER (r.n = leader) AS lat, max(r.lon) FILTER (r.n = leader) AS lon, arg_min(note, r.n) FILTER (note <> '') AS note, arg_min(parent, r.n) FILTER (parent <> '') AS parent,
          arg_min(employees, r.n) FILTER (employees <> 0) AS employees, arg_min(sqft, r.n) FILTER (sqft <> 0) AS sqft, arg_min(operator, r.n) FILTER (operator <> '') AS operator, list_sort(list(DISTINCT source_name)) AS sources, count(*) AS records
          FROM lead JOIN r USING (n) GROUP BY leader"""
)
def q13_survivorship_fold(spark, d):
    rows, leaders = _leaders(spark, d)
    # the records are whole once a number, so their leaders are brought to them by number
    leaders = leaders.join(rows.select("ord", "rec_id"), "ord").select("rec_id", "leader")
    return resolve.survivors(rows, leaders, on="rec_id").drop("leader")


@catalog.query(
    sql="""WITH s AS (SELECT DISTINCT rec_id, source_name, name, employees, operator, lower(trim(address)) AS place FROM site_record WHERE rec_id IS NOT NULL),
             p AS (SELECT place AS k, max(employees) AS employees, min(operator) AS operator FROM s WHERE source_name = 'recall_sweep' AND place <> '' GROUP BY 1)
         SELECT r.rec_id, r.name, CASE WHEN p.k IS NOT NULL THEN p.employees ELSE r.employees END AS employees, CASE WHEN p.operator IS NOT NULL THEN p.operator ELSE r.operator END AS operator
         FROM s r LEFT JOIN p ON p.k = r.place WHERE r.source_name = 'trade_list'"""
)
def q14_overlay_update(spark, d):
    """What the recall sweep says of an address, over the trade list's records there: stated keys win even where null (employees always, operator only where it has a value)."""
    r = table(spark, d, "site_record").filter("rec_id IS NOT NULL").select("rec_id", "source_name", "name", "employees", "operator", F.lower(F.trim("address")).alias("place")).distinct()
    patch = r.filter("source_name = 'recall_sweep' AND place <> ''").groupBy("place").agg(F.max("employees").alias("employees"), F.min("operator").alias("operator"))
    keys = F.array_compact(F.array(F.lit("employees"), F.when(F.col("operator").isNotNull(), F.lit("operator"))))
    rows = r.filter("source_name = 'trade_list'").select("rec_id", "place", "name", "employees", "operator")
    return resolve.overlay(rows, patch.withColumn("present_keys", keys), "place").drop("place")


@catalog.query(
    sql=MATCH_SQL
    + """, j AS (SELECT b.b.id AS id, list(struct_pack(p := p.plant_id, mw := p.mw, g := p.gen_mwh, f := p.fuel) ORDER BY p.plant_id) AS turns
          FROM best b JOIN power_plant p USING (plant_id) GROUP BY 1),
         k AS (SELECT DISTINCT id, sector, CASE potential.band WHEN 'High' THEN 'B' WHEN 'Medium' THEN 'C' WHEN 'Low' THEN 'D' ELSE '' END AS tier FROM entity)
         SELECT j.id, len(turns)::int AS plants,
           CASE WHEN sector NOT IN ('power-generation', 'district-energy') THEN tier ELSE
             list_reduce(list_prepend(tier, list_transform(turns, lambda t: CASE WHEN t.g = 0 THEN '0' WHEN t.mw >= 400 THEN '4' WHEN t.mw >= 100 THEN '1' ELSE '-' END)),
               lambda a, x: CASE WHEN x = '0' THEN 'D' WHEN x = '4' AND a IN ('', 'B', 'C', 'D') THEN 'A' WHEN x = '1' AND a IN ('', 'C', 'D') THEN 'B' ELSE a END) END AS tier,
           CASE WHEN sector IN ('power-generation', 'district-energy') THEN turns[-1].mw END AS mw
         FROM j JOIN k USING (id)"""
)
def q15_sequential_promotions(spark, d):
    sites = entities(spark, d).select("id", "name", "lat", "lon", "sector", F.expr("CASE potential.band WHEN 'High' THEN 'B' WHEN 'Medium' THEN 'C' WHEN 'Low' THEN 'D' ELSE '' END AS tier"))
    plants = table(spark, d, "power_plant")
    return resolve.attach_generation(resolve.best_match(plants, sites), plants, sites).select("id", "plants", "tier", "mw")


@catalog.query(
    sql="""WITH r AS (SELECT DISTINCT rec_id, left(upper(regexp_replace(name, '[^A-Za-z]', '', 'g')), 10) AS id, name, lat, lon FROM site_record WHERE rec_id IS NOT NULL),
             c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r),
             u AS (SELECT *, CASE WHEN n > 1 THEN id || '-' || left(sha1(coalesce(name, '') || '|' || printf('%.4f', coalesce(lat, 0)) || '|' || printf('%.4f', coalesce(lon, 0))), 6) ELSE id END AS k FROM c WHERE id IS NOT NULL),
             v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rec_id) AS i FROM u)
         SELECT rec_id, CASE WHEN i > 1 THEN k || '-' || i ELSE k END AS unique_id FROM v"""
)
def q16_unique_ids(spark, d):
    """Ids made of ten letters of the name collide; each row gets one of its own."""
    short = F.substring(F.upper(F.regexp_replace("name", "[^A-Za-z]", "")), 1, 10)
    r = site_records(spark, d).select("rec_id", short.alias("id"), "name", "lat", "lon", F.lit(None).cast("string").alias("registration")).filter("id IS NOT NULL")
    return resolve.unique_ids(r, ["rec_id"]).select("rec_id", "unique_id")


# ------------------------------------------------------------------ scoring


def site_facts(spark, d):
    e = entities(spark, d).filter("kind = 'facility'")
    return e.select(
        "id", "name", "sector", "subindustry", "note", "existence", "facts.employees", "facts.sqft", "facts.mw", "facts.fuel", "facts.gen_mwh", "facts.cogen",
        F.expr("transform(sources, s -> s.label)").alias("labels"), F.col("timing.k").alias("plan_status"),
    )


def scored(spark, d):
    return score.assess(site_facts(spark, d))


def _case(values: dict, what: str, key: str = "family") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v[what]}" for k, v in values.items()) + " END"


_FAM = score.MODEL["families"]
_SUB = score.MODEL["subtypes"]
FACT_SQL = f"""WITH e AS (SELECT DISTINCT ON (id) id, name, sector, subindustry, note, existence, facts.employees AS employees, facts.sqft AS sqft, facts.mw AS mw, facts.fuel AS fuel,
   facts.gen_mwh AS gen_mwh, facts.cogen AS cogen, list_transform(sources, lambda s: s.label) AS labels, timing.k AS plan_status FROM entity WHERE kind = 'facility' AND id IS NOT NULL),
 f AS (SELECT *, coalesce(CASE sector {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in score.MODEL['sector_family'].items())} END, 'other-mfg') AS family FROM e),
 g AS (SELECT *, CASE {_case({k: {'m': "'" + v['metric'] + "'"} for k, v in _FAM.items()}, 'm')} WHEN 'employees' THEN employees::double WHEN 'sqft' THEN sqft::double ELSE mw END AS metric,
   lower(coalesce(fuel, '') || ' ' || regexp_extract(coalesce(note, ''), '(?i)fuel:\\s*([^|]+)', 1)) AS fuels, lower(coalesce(name, '')) AS low FROM f),
 h AS (SELECT *, CASE WHEN coalesce(metric, 0) = 0 THEN 1.5 WHEN metric >= {_case(_FAM, 'big')} THEN 3.0 WHEN metric >= {_case(_FAM, 'small')} THEN 2.0 ELSE 1.0 END::double AS scale,
   least(3.0, (CASE WHEN coalesce(mw, 0) <> 0 AND coalesce(gen_mwh, 0) <> 0 THEN 1.5 ELSE 0 END) + (CASE WHEN coalesce(cogen, false) THEN 1.0 ELSE 0 END)
     + (CASE WHEN list_contains(labels, 'Emission report') THEN 0.75 ELSE 0 END) + (CASE WHEN list_contains(labels, 'Toxics filing') THEN 0.75 ELSE 0 END)
     + (CASE WHEN coalesce(sqft, 0) <> 0 AND coalesce(employees, 0) <> 0 THEN 0.25 ELSE 0 END))::double AS verified,
   (coalesce(mw, 0) <> 0)::int + coalesce(cogen, false)::int + coalesce(list_contains(labels, 'Emission report'), false)::int + coalesce(list_contains(labels, 'Toxics filing'), false)::int
     + (coalesce(sqft, 0) <> 0 AND coalesce(employees, 0) <> 0)::int AS n_facts,
   CASE WHEN sector = 'power-generation' THEN CASE
     WHEN regexp_matches(low, 'landfill|\\blfg\\b|gas.to.energy') OR contains(fuels, 'landfill') THEN 'landfill_gas'
     WHEN contains(low, 'hydro') OR contains(fuels, 'hydro') OR trim(fuels) = 'water' THEN 'hydro'
     WHEN regexp_matches(fuels, 'nuclear|coal|biomass|black liquor|municipal|wood|refuse') OR regexp_matches(low, 'nuclear|cogen|resource recovery|biomass') OR coalesce(cogen, false) THEN 'steam'
     WHEN regexp_matches(low, 'combustion turbine|peaking|peaker|\\bct\\b|combustion station') OR (CASE WHEN mw <> 0 THEN gen_mwh / (mw * 8760) END) < 0.10 THEN 'peaker'
     WHEN coalesce(mw, 0) = 0 AND coalesce(employees, 0) <= 5 THEN 'small_unit' ELSE 'thermal' END END AS subtype FROM g),
 i AS (SELECT *, coalesce({_case(_SUB, 'intensity', 'subtype')}, {_case(_FAM, 'intensity')})::double AS inten0, coalesce({_case(_SUB, 'breadth', 'subtype')}, {_case(_FAM, 'breadth')})::double AS brea0,
   sector IN ('logistics', 'distribution', 'solar-storage', 'aggregates-mining') AS low_flow FROM h),
 j AS (SELECT *, CASE WHEN coalesce(low_flow, false) THEN least(inten0, 0.5) ELSE inten0 END AS intensity, CASE WHEN coalesce(low_flow, false) THEN least(brea0, 0.5) ELSE brea0 END AS breadth,
   regexp_matches(coalesce(name, ''), '(?i)\\b(plants|systems|facilities|campuses|central (utility )?plants|secondary sites|area\\b.*plants|regional campus)\\b') AS placeholder FROM i),
 k AS (SELECT *, 30.0::double * intensity / 3.0 + 30.0::double * scale / 3.0 + 20.0::double * breadth / 3.0 + 20.0::double * verified / 3.0 AS raw,
   placeholder OR (family = 'other-mfg' AND coalesce(employees, 0) = 0 AND coalesce(sqft, 0) = 0 AND n_facts = 0 AND coalesce(trim(subindustry), '') = '') AS unrated FROM j),
 l AS (SELECT *, CASE WHEN unrated THEN 'Insufficient information' WHEN raw >= 68 THEN 'High' WHEN raw >= 46 THEN 'Medium' ELSE 'Low' END AS free_band,
   CASE subtype WHEN 'hydro' THEN 1 WHEN 'peaker' THEN 1 WHEN 'landfill_gas' THEN 0 WHEN 'small_unit' THEN 0 END AS cap FROM k),
 m AS (SELECT *, coalesce((CASE free_band WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 0 END) > cap, false) AS capped FROM l),
 n AS (SELECT *, CASE WHEN capped THEN CASE cap WHEN 1 THEN 'Medium' ELSE 'Low' END ELSE free_band END AS band FROM m)
"""


@catalog.query(sql=FACT_SQL + "SELECT id, family, scale, coalesce(metric, 0) <> 0 AS scale_verified FROM n")
def q17_scale_factor(spark, d):
    return scored(spark, d).select("id", "family", "scale", "scale_verified")


@catalog.query(sql=FACT_SQL + "SELECT id, verified, n_facts AS facts FROM n")
def q18_verified_points(spark, d):
    return scored(spark, d).select("id", "verified", F.size("fact_list").alias("facts"))


@catalog.query(
    sql=FACT_SQL
    + """SELECT id, round_even(least(3.0, v0 + CASE WHEN regexp_matches(permit, '(?i)major|title\\s*v') THEN 0.75 WHEN permit <> '' THEN 0.25 ELSE 0 END + CASE WHEN onsite <> 0 THEN 1.0 ELSE 0 END), 6) AS verified,
         n_facts + (permit <> '')::int + (onsite <> 0)::int AS facts FROM (SELECT *, CASE WHEN sqft >= 300000 THEN 'Title V' WHEN sqft >= 100000 THEN 'minor' ELSE '' END AS permit, CASE WHEN employees >= 400 THEN employees / 10 ELSE 0 END AS onsite,
         (CASE WHEN coalesce(mw, 0) <> 0 AND coalesce(gen_mwh, 0) <> 0 THEN 1.5 ELSE 0 END) + (CASE WHEN coalesce(cogen, false) THEN 1.0 ELSE 0 END) + (CASE WHEN list_contains(labels, 'Emission report') THEN 0.75 ELSE 0 END)
          + (CASE WHEN list_contains(labels, 'Toxics filing') THEN 0.75 ELSE 0 END) + (CASE WHEN coalesce(sqft, 0) <> 0 AND coalesce(employees, 0) <> 0 THEN 0.25 ELSE 0 END) AS v0 FROM n)"""
)
def q18_onsite_permit_points(spark, d):
    """Evidence points with on-site generation and air permits, both made from staff and floor area (the tables have neither)."""
    sites = site_facts(spark, d).withColumn("onsite_mw", F.when(F.col("employees") >= 400, F.col("employees") / 10)).withColumn("permit_class", F.when(F.col("sqft") >= 300000, "Title V").when(F.col("sqft") >= 100000, "minor"))
    return score.assess(sites).select("id", F.bround("verified", 6).alias("verified"), F.size("fact_list").alias("facts"))


@catalog.query(
    sql=FACT_SQL
    + "SELECT id, list_sort(list_filter(CASE family " + " ".join(f"WHEN '{k}' THEN {v['apps']}" for k, v in score.MODEL["families"].items())
    + """ END, lambda a: (a IN ('steam_header', 'bfw', 'cond_return', 'fuel_gas') AND (coalesce(mw, 0) <> 0 OR coalesce(cogen, false))) OR (a IN ('process_liquid', 'corrosive', 'effluent') AND coalesce(list_contains(labels, 'Toxics filing'), false)))) AS apps FROM n"""
)
def q69_verified_applications(spark, d):
    return scored(spark, d).select("id", F.col("apps_verified").alias("apps"))


@catalog.query(sql=FACT_SQL + "SELECT id, subtype FROM n WHERE subtype IS NOT NULL")
def q19_subtype_rules(spark, d):
    return scored(spark, d).filter("subtype IS NOT NULL").select("id", "subtype")


@catalog.query(sql=FACT_SQL + "SELECT id, round_even(raw, 1) AS score, free_band FROM n")
def q20_score_band(spark, d):
    return scored(spark, d).select("id", "score", "free_band")


@catalog.query(sql=FACT_SQL + "SELECT id, band, capped, CASE band WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END AS marker FROM n")
def q21_cap_and_insufficient(spark, d):
    return scored(spark, d).select("id", "band", "capped", "marker")


@catalog.query(
    sql=FACT_SQL
    + """SELECT id, list_filter([CASE WHEN placeholder THEN 'placeholder' END, CASE WHEN coalesce(low_flow, false) THEN 'low_flow' END, CASE WHEN existence = 'recall' THEN 'unverified' END], lambda x: x IS NOT NULL) AS flags FROM n"""
)
def q22_flags_array(spark, d):
    """Flags that need no neighbours; duplicates and shared sites are q22_flags_near."""
    return scored(spark, d).select("id", "flags")


def _of_facilities(name: str) -> str:
    return catalog.sql[name].replace("FROM entity", "FROM (SELECT * FROM entity WHERE kind = 'facility') AS entity")


@catalog.query(
    sql=f"""WITH e AS (SELECT DISTINCT ON (id) id, name, sector, existence FROM entity WHERE kind = 'facility' AND id IS NOT NULL),
 dup AS (SELECT a AS id FROM ({_of_facilities("q11_near_duplicates")}) UNION SELECT b FROM ({_of_facilities("q11_near_duplicates")})),
 near AS ({_of_facilities("q09_colocated_names")}),
 x AS (SELECT e.*, dup.id IS NOT NULL AS dup, near.id IS NOT NULL AS near, {FLAG.format(c="e.name")} AS t, coalesce(colocated, []) AS others FROM e LEFT JOIN dup ON dup.id = e.id LEFT JOIN near ON near.id = e.id),
 y AS (SELECT *, list_transform(others, lambda o: {FLAG.format(c="o")}) AS ts FROM x),
 z AS (SELECT *, len(t) > 0 AND len(list_filter(ts, lambda u: len(u) > 0 AND len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) >= 0.3)) > 0 AS echo FROM y)
 SELECT id, list_filter([CASE WHEN regexp_matches(coalesce(name, ''), '{score.PLACEHOLDER}') THEN 'placeholder' END, CASE WHEN dup THEN 'dupe' END, CASE WHEN near AND echo AND NOT dup THEN 'dupe' END,
   CASE WHEN near AND NOT (echo AND NOT dup) THEN 'shared_site' END, CASE WHEN sector IN ('logistics', 'distribution', 'solar-storage', 'aggregates-mining') THEN 'low_flow' END,
   CASE WHEN existence = 'recall' THEN 'unverified' END], lambda f: f IS NOT NULL) AS flags FROM z"""
)
def q22_flags_near(spark, d):
    """All review flags, with near-duplicate and co-located names attached."""
    e = cut(entities(spark, d).filter("kind = 'facility'").select("id", "name", "lat", "lon", "jurisdiction", "city", "sector", "existence"))
    pairs = cut(resolve.near_duplicates(e))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("o")))
    names = e.select(F.col("id").alias("o"), F.col("name").alias("o_name"))
    # three names are ever shown, so no more are kept of each entry's list
    dupes = both.join(names, "o").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "o_name"))), 1, 3).alias("x")).select("id", F.transform("x", lambda v: v["o_name"]).alias("dupes"))
    near = resolve.colocated_names(cut(resolve.colocation_groups(e)), e)
    return e.join(dupes, "id", "left").join(near, "id", "left").select("id", score.flags().alias("flags"))


@catalog.query(
    sql=FACT_SQL
    + """SELECT id, CASE WHEN band = 'Insufficient information' THEN [CASE WHEN placeholder THEN 'names a group of plants' ELSE 'too little is known' END, 'not a judgement of worth']
         ELSE [coalesce(subtype, family) || CASE WHEN capped THEN ' (band capped)' ELSE '' END,
               CASE WHEN coalesce(metric, 0) = 0 THEN 'size not reported, taken as typical' WHEN scale = 3 THEN 'large for its industry' WHEN scale = 2 THEN 'mid-size for its industry' ELSE 'small for its industry' END,
               CASE WHEN n_facts = 0 THEN 'no operating facts reported' ELSE 'fact' END] END AS reasons FROM n"""
)
def q23_reasons_slice(spark, d):
    """Reasons; the text of a fact is given as 'fact' here, so that number formats stay out of the comparison."""
    r = scored(spark, d)
    plain = F.transform("reasons", lambda x, i: F.when((i == 2) & (F.size("fact_list") > 0), "fact").otherwise(x))
    return r.select("id", plain.alias("reasons"))


@catalog.query(
    sql=FACT_SQL
    + """SELECT id, CASE WHEN coalesce(mw, 0) <> 0 AND coalesce(gen_mwh, 0) = 0 THEN 'idle' WHEN lower(plan_status) = 'under construction' THEN 'construction' WHEN lower(plan_status) IN ('proposed', 'operating', 'expansion') THEN lower(plan_status)
            WHEN lower(plan_status) = 'on hold' THEN 'hold' ELSE 'unknown' END AS timing,
          CASE WHEN existence = 'recall' THEN 'low' WHEN coalesce(metric, 0) <> 0 AND coalesce(subindustry, '') <> '' AND n_facts > 0 THEN 'high'
            WHEN (coalesce(metric, 0) <> 0 AND coalesce(subindustry, '') <> '') OR n_facts > 0 THEN 'medium' ELSE 'low' END AS confidence FROM n"""
)
def q24_timing_confidence(spark, d):
    return scored(spark, d).select("id", "timing", "confidence")


@catalog.query(
    sql="""WITH e AS (SELECT DISTINCT id, facts.employees AS employees, potential.band AS band, miles FROM entity WHERE kind = 'facility' AND id IS NOT NULL),
             x AS (SELECT *, employees BETWEEN 2 AND 10000 AS on_, (employees % 7)::double AS c, (employees % 5)::double AS g, (employees % 3)::double AS v, 0.2 AS turn, (employees % 4)::double AS points, 0.35 AS capture, (coalesce(band, 0) * 1000)::double AS adder
                   FROM (SELECT id, employees, CASE band WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 END AS band FROM e)),
             y AS (SELECT *, points * capture * 11000 AS fx, c * turn * 9000 + g * turn * 4000 + v * turn * 5000 + points * capture * 11000 + adder AS bk FROM x)
         SELECT id, coalesce(CASE WHEN on_ THEN round_even(bk, 0) END, 0)::double AS bookings, coalesce(CASE WHEN on_ THEN round_even(fx, 0) END, 0)::double AS clamp_dollars,
           CASE WHEN coalesce(on_, false) THEN CASE WHEN bk >= 250000 THEN 'A' WHEN bk >= 100000 THEN 'B' WHEN bk >= 25000 THEN 'C' ELSE 'D' END ELSE '' END AS tier_modeled FROM y"""
)
def q25_bookings_tier(spark, d):
    """Bookings over installed counts made from the staff figure (the tables have no enrichment)."""
    e = entities(spark, d).filter("kind = 'facility'")
    n = F.col("facts.employees")
    installed = F.when(n.between(2, 10000), F.create_map(F.lit("coriolis"), (n % 7).cast("double"), F.lit("magnetic"), (n % 5).cast("double"), F.lit("vortex"), (n % 3).cast("double")))
    weight = F.expr("coalesce(CASE potential.band WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 END, 0)")
    s = e.select("id", installed.alias("installed"), F.lit(0.2).alias("turn"), (n % 4).cast("double").alias("points"), F.lit(0.35).alias("capture"), (weight * 1000).cast("double").alias("adder"), F.lit("").alias("tier"))
    return score.bookings(s).select("id", "bookings", "clamp_dollars", "tier_modeled")


@catalog.query(
    sql="WITH a(family, app_pos, app, tech_pos, tech) AS (VALUES "
    + ", ".join(f"('{f}', {i}, '{a}', {j}, '{t}')" for f, v in _FAM.items() for i, a in enumerate(v["apps"]) for j, t in enumerate(score.MODEL["app_tech"][a]))
    + ") SELECT family, tech, sum(CASE WHEN tech_pos = 0 THEN 2 ELSE 1 END)::bigint AS weight, min(app_pos * 100 + tech_pos)::int AS first, list(app ORDER BY app_pos)[1:4] AS apps FROM a GROUP BY family, tech"
)
def q26_family_catalog(spark, d):
    return score.catalogue(spark)


@catalog.query(
    sql="""SELECT id, name, city FROM (SELECT DISTINCT ON (id) id, name, parent, city, jurisdiction, subindustry FROM entity WHERE id IS NOT NULL)
           WHERE contains(lower(concat_ws(' ', name, parent, city, jurisdiction, subindustry)), 'brewing') ORDER BY name, id LIMIT 50"""
)
def q61_search_topn(spark, d):
    """A search over names, parents, places and industries, best 50 by name."""
    e = entities(spark, d)
    hit = F.lower(F.concat_ws(" ", "name", "parent", "city", "jurisdiction", "subindustry")).contains("brewing")
    return e.filter(hit).select("id", "name", "city").orderBy("name", "id").limit(50)


@catalog.query(
    sql=f"""SELECT rec_id, a, len(b)::int AS tokens_b FROM (SELECT rec_id, {FOLD.format(c='name')} AS a, {FLAG.format(c='name')} AS b FROM (SELECT DISTINCT rec_id, name FROM site_record WHERE rec_id IS NOT NULL))"""
)
def q62_tokens(spark, d):
    """Both tokenisers over record names."""
    return site_records(spark, d).select("rec_id", fold_tokens("name").alias("a"), F.size(flag_tokens("name")).alias("tokens_b"))


@catalog.query(
    sql="""SELECT id, kind, CASE WHEN coalesce(name, '') <> '' THEN name ELSE id END AS name, coalesce(parent, '') AS parent, coalesce(band, 1) AS band,
             round_even(sqrt(pow((lon - -77.44) * 69 * cos(radians(37.5)), 2) + pow((lat - 37.54) * 69, 2)), 1) AS miles_now,
             len(sources)::int AS n_sources
           FROM (SELECT DISTINCT ON (e.id) e.* FROM entity e WHERE id IS NOT NULL)"""
)
def q63_entity_projection(spark, d):
    """The contract projection: defaults, rounding, distance from home."""
    from ..functions.geo import HOME_LATITUDE, miles

    e = entities(spark, d)
    far = F.bround(miles(F.col("lat"), F.col("lon"), F.lit(HOME[0]), F.lit(HOME[1]), at=HOME_LATITUDE), 1)
    n = F.when(F.col("sources").isNotNull(), F.size("sources"))
    return e.select("id", "kind", F.when(truthy("name"), F.col("name")).otherwise(F.col("id")).alias("name"), F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("band", F.lit(1)).alias("band"), far.alias("miles_now"), n.alias("n_sources"))


@catalog.query(
    sql="""SELECT e.id, e.s.label AS label, coalesce(c.what, e.s.label) AS what FROM (SELECT id, unnest(sources) AS s FROM (SELECT DISTINCT ON (id) id, sources FROM entity WHERE id IS NOT NULL)) e LEFT JOIN source_catalog c ON c.label = e.s.label"""
)
def q64_source_labels(spark, d):
    """Source labels with their meaning; an unlisted label stands for itself."""
    said = entities(spark, d).select("id", F.explode("sources").alias("s")).select("id", F.col("s.label").alias("label"))
    return said.join(table(spark, d, "source_catalog").select("label", F.col("what").alias("w")), "label", "left").select("id", "label", F.coalesce("w", "label").alias("what"))
