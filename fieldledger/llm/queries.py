"""Queries of the corpus operators on the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.skew import block_join
from ..functions.time import period_end
from ..plans.catalog import Catalog
from ..session import cut, free, table
from .canon import AFTER, BEFORE, SHORT_FORMS, map_values
from .components import connected_components
from .linkage import compare, decide, prepare, score
from .mixing import mix, report
from .names import is_stand_in
from .packing import pack
from .quality import line_groups, text_statistics, text_types
from .survivor import preferred_entry, truth_discovery
from .tokens import token_count
from .variants import link_spellings

catalog = Catalog()

# ---------------------------------------------------------------- problem 6


@catalog.query(
    sql="""
WITH RECURSIVE edge AS (SELECT DISTINCT entity_id AS u, duplicate_of AS v FROM ledger_change
    WHERE change = 'mark_duplicate' AND entity_id IS NOT NULL AND duplicate_of IS NOT NULL AND entity_id <> duplicate_of),
 both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
 reach(id, root) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.id)
SELECT id AS entity_id, min(root) AS group_id FROM reach GROUP BY id
"""
)
def p6_found(spark, d):
    """Duplicate marks as a graph; blank ids are ids like any other."""
    marks = table(spark, d, "ledger_change").filter("change = 'mark_duplicate'").select("entity_id", "duplicate_of")
    return connected_components(marks, "entity_id", "duplicate_of").select(F.col("id").alias("entity_id"), "group_id")


# ---------------------------------------------------------------- problem 4


def ranked_claims(spark, d):
    """Usable values of reviewed entries with the best source behind each: (group_id, entry, field, value, rank, day)."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s_]+", " ")))
    ranks = table(spark, d, "source_catalog").select(fold("label").alias("folded"), "trust_rank").groupBy("folded").agg(F.min("trust_rank").alias("trust_rank"))
    review = table(spark, d, "review_group").dropna().distinct()
    e = table(spark, d, "entity").select("id", "operator", "facts.employees", "facts.sqft", "sources")
    e = e.join(review.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi")
    said = e.select("id", F.explode_outer("sources").alias("s")).select("id", fold("s.label").alias("folded"), period_end("s.as_of").alias("day"))
    # the catalogue has a fixed, small number of labels; left to the size check of the session
    said = said.join(ranks, "folded", "left").withColumn("rank", F.coalesce("trust_rank", F.lit(2**31 - 1)))
    # least rank first, the latest day among its sources
    best = said.groupBy("id").agg(F.min(F.struct("rank", (-F.coalesce(F.datediff("day", F.lit("1900-01-01").cast("date")), F.lit(-10_000_000))).alias("age"), "day")).alias("b"))
    best = best.select("id", "b.rank", "b.day")
    values = e.select(
        "id",
        F.expr(
            """stack(3, 'employees', CASE WHEN employees BETWEEN 2 AND 10000 THEN cast(employees AS string) END,
                        'sqft', CASE WHEN sqft BETWEEN 2 AND 5000000 THEN cast(sqft AS string) END,
                        'operator', operator) AS (field, value)"""
        ),
    ).filter(F.col("value").isNotNull() & ((F.col("field") != "operator") | ~is_stand_in("value")))
    values = values.groupBy("id", "field").agg(F.min("value").alias("value"))
    return review.withColumnRenamed("entity_id", "id").join(values, "id").join(best, "id").withColumnRenamed("id", "entry")


@catalog.query(
    sql="""
WITH ranks AS (SELECT lower(trim(regexp_replace(label, '[\\s_]+', ' ', 'g'))) AS folded, min(trust_rank) AS trust_rank FROM source_catalog GROUP BY 1),
 e AS (SELECT DISTINCT id, operator, facts.employees AS employees, facts.sqft AS sqft, sources FROM entity),
 s AS (SELECT DISTINCT id, lower(trim(regexp_replace(x.label, '[\\s_]+', ' ', 'g'))) AS folded, upper(trim(x.as_of)) AS a FROM (SELECT id, unnest(sources) AS x FROM e)),
 t AS (SELECT s.id, coalesce(trust_rank, 2147483647) AS rank, coalesce(
   CASE WHEN regexp_full_match(a, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(a AS date) END,
   CASE WHEN regexp_full_match(a, '[0-9]{4}-[0-9]{2}') THEN last_day(try_cast(a || '-01' AS date)) END,
   CASE WHEN regexp_full_match(a, '[A-Z]{3,9}\\.? [0-9]{4}') THEN last_day(try_cast(right(a, 4) || '-' ||
        lpad(((strpos('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', left(a, 3)) + 2) // 3)::varchar, 2, '0') || '-01' AS date)) END,
   CASE WHEN regexp_full_match(a, 'Q[1-4] [0-9]{4}') THEN last_day(try_cast(right(a, 4) || '-' || lpad((3 * a[2:2]::int)::varchar, 2, '0') || '-01' AS date)) END,
   CASE WHEN regexp_full_match(a, '[0-9]{4}') THEN try_cast(a || '-12-31' AS date) END, DATE '1500-01-01') AS day
   FROM s LEFT JOIN ranks USING (folded)),
 best AS (SELECT id, min(rank) AS rank, arg_min(day, struct_pack(r := rank, d := -epoch(day))) AS day FROM t GROUP BY id),
 v AS (SELECT DISTINCT id, 'employees' AS field FROM e WHERE employees BETWEEN 2 AND 10000
       UNION SELECT id, 'sqft' FROM e WHERE sqft BETWEEN 2 AND 5000000
       UNION SELECT id, 'operator' FROM e WHERE regexp_matches(operator, '[A-Za-z]') AND lower(trim(operator)) NOT IN
         ('n/a', 'tbd', 'null', 'see parent', 'none listed', 'not reported', 'same', 'unknown', 'none', 'unk'))
SELECT g.group_id, v.field, arg_min(v.id, struct_pack(r := coalesce(rank, 2147483647), d := -epoch(coalesce(day, DATE '1500-01-01')), i := v.id)) AS entity_id
FROM (SELECT DISTINCT group_id, entity_id FROM review_group) g JOIN v ON v.id = g.entity_id LEFT JOIN best ON best.id = v.id GROUP BY 1, 2
"""
)
def p4_found(spark, d):
    return preferred_entry(ranked_claims(spark, d)).select("group_id", "field", F.col("entry").alias("entity_id"))


NO_SOURCE = "(no source)"  # what entries without a source speak as
TRUTH_ROUNDS = 6


def _truth_sql() -> str:
    """The same rounds, each a set of materialised steps."""
    sql = P4_CLAIMS_SQL + f""",
 said AS (SELECT DISTINCT id, coalesce(lower(trim(regexp_replace(x.label, '[\\s_]+', ' ', 'g'))), '{NO_SOURCE}') AS source FROM (SELECT id, unnest(sources) AS x FROM e UNION ALL SELECT id, NULL FROM e WHERE coalesce(len(sources), 0) = 0)),
 v AS (SELECT id, field, min(value) AS value FROM claimed GROUP BY 1, 2),
 c AS MATERIALIZED (SELECT g.group_id, v.field, v.value, s.source, count(*) AS n FROM (SELECT DISTINCT group_id, entity_id FROM review_group WHERE group_id IS NOT NULL) g JOIN v ON v.id = g.entity_id JOIN said s ON s.id = v.id GROUP BY ALL),
 t0 AS MATERIALIZED (SELECT DISTINCT source, 0.8::double AS t FROM c)"""
    for k in range(TRUTH_ROUNDS + 1):
        sql += f""",
 w{k} AS MATERIALIZED (SELECT c.*, -ln(1 - t) AS weight FROM c JOIN t{k} USING (source)),
 b{k} AS MATERIALIZED (SELECT group_id, field, value, sum(weight) AS support, sum(n) AS claims FROM w{k} GROUP BY ALL),
 a{k} AS MATERIALIZED (SELECT group_id, field, sum(support) AS total FROM b{k} GROUP BY ALL),
 o{k} AS (SELECT source, CASE WHEN total - weight > 1e-9 THEN (support - weight) / (total - weight) END AS o FROM w{k} JOIN b{k} USING (group_id, field, value) JOIN a{k} USING (group_id, field)),
 t{k + 1} AS MATERIALIZED (SELECT source, least(greatest((coalesce(sum(o), 0) + 1.6) / (count(o) + 2), 0.05), 0.99) AS t FROM o{k} GROUP BY 1)"""
    return sql + f""",
 won AS (SELECT group_id, field, arg_max(struct_pack(v := value, s := support, c := claims), struct_pack(s := round_even(support, 9), c := claims, v := value)) AS b FROM b{TRUTH_ROUNDS} GROUP BY 1, 2)
 SELECT group_id, field, b.v AS value, b.c::bigint AS claims, round_even(b.s / total, 6) AS confidence FROM won JOIN a{TRUTH_ROUNDS} USING (group_id, field)"""


P4_CLAIMS_SQL = """WITH e AS (SELECT DISTINCT id, operator, facts.employees AS employees, facts.sqft AS sqft, sources FROM entity),
 claimed AS (SELECT id, 'employees' AS field, employees::varchar AS value FROM e WHERE employees BETWEEN 2 AND 10000 UNION SELECT id, 'sqft', sqft::varchar FROM e WHERE sqft BETWEEN 2 AND 5000000
       UNION SELECT id, 'operator', operator FROM e WHERE regexp_matches(operator, '[A-Za-z]') AND lower(trim(operator)) NOT IN
         ('n/a', 'tbd', 'null', 'see parent', 'none listed', 'not reported', 'same', 'unknown', 'none', 'unk'))"""


@catalog.query(sql=_truth_sql())
def p4_truth(spark, d):
    """The same fields by iterative truth discovery over source labels, with the support of each winner."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s_]+", " ")))
    said = table(spark, d, "entity").select(F.col("id").alias("entry"), F.explode_outer("sources").alias("s")).select("entry", F.coalesce(fold("s.label"), F.lit(NO_SOURCE)).alias("source")).distinct()
    claims = ranked_claims(spark, d).select("group_id", "field", "entry", "value").join(said, "entry")
    return truth_discovery(claims, rounds=TRUTH_ROUNDS)[0].select("group_id", "field", "value", "claims", F.bround("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- problem 7


def _ornament_rows(table: dict) -> str:
    return ", ".join(f"('{f}', '{w}', {c})" for f, ws in table.items() for w, c in {"": False, **ws}.items())


# the same rules by comparing every form with every entry
P7_SQL = f"""
WITH before(field, w, c) AS (VALUES {_ornament_rows(BEFORE)}), after(field, w, c) AS (VALUES {_ornament_rows(AFTER)}),
 short(long_form, s) AS (VALUES {", ".join(f"('{w}', '{s}')" for w, ss in SHORT_FORMS.items() for s in ss)}),
 entry AS (SELECT 'jurisdiction' AS field, place_id, label AS literal, lower(short_name) AS n, kind = 'city' AS is_city FROM place_ref WHERE kind IN ('county', 'city')
           UNION ALL SELECT 'city', place_id, short_name, lower(short_name), false FROM place_ref WHERE kind IN ('city', 'town')),
 fst AS (SELECT * FROM entry UNION SELECT field, place_id, literal, s || n[length(long_form) + 1:], is_city FROM entry JOIN short ON starts_with(n, long_form || ' ')),
 lst AS (SELECT * FROM fst UNION SELECT field, place_id, literal, n[:length(n) - length(long_form)] || s, is_city FROM fst JOIN short ON ends_with(n, ' ' || long_form)),
 ref AS (SELECT DISTINCT field, place_id, is_city, regexp_replace(n, '[^a-z]', '', 'g') AS ref FROM lst WHERE length(regexp_replace(n, '[^a-z]', '', 'g')) >= 3),
 said AS (SELECT DISTINCT id, 'jurisdiction' AS field, jurisdiction AS value FROM entity WHERE id IS NOT NULL UNION SELECT DISTINCT id, 'city', city FROM entity WHERE id IS NOT NULL),
 cases AS (SELECT * FROM said WHERE trim(value) <> '' AND NOT EXISTS (SELECT 1 FROM entry e WHERE e.field = said.field AND e.literal = said.value)),
 typed AS (SELECT DISTINCT field, value, regexp_replace(lower(value), '[^a-z]', '', 'g') AS s FROM cases),
 led AS (SELECT t.field, value, b.c AS lc, s[length(b.w) + 1:] AS s FROM typed t JOIN before b ON b.field = t.field AND starts_with(s, b.w)),
 form AS (SELECT DISTINCT l.field, value, lc OR a.c AS says, s[:length(s) - length(a.w)] AS form FROM led l JOIN after a ON a.field = l.field AND ends_with(s, a.w) WHERE length(s) - length(a.w) >= 3),
 near AS (SELECT f.field, f.value, f.says, r.place_id, r.is_city, levenshtein(f.form, r.ref) AS d, length(r.ref) AS n FROM form f JOIN ref r ON r.field = f.field AND abs(length(f.form) - length(r.ref)) <= 3),
 best AS (SELECT field, value, min(struct_pack(d := d, k := says <> is_city, p := place_id)).p AS place_id FROM near WHERE d <= 3 AND d * 3 <= n GROUP BY 1, 2)
SELECT DISTINCT c.id AS entity_id, c.field, coalesce(b.place_id, -1)::int AS place_id FROM cases c LEFT JOIN best b ON b.field = c.field AND b.value = c.value
"""


@catalog.query(sql=P7_SQL)
def p7_found(spark, d):
    place = table(spark, d, "place_ref")
    county_city = place.filter("kind IN ('county', 'city')").select(F.lit("jurisdiction").alias("field"), F.col("place_id").alias("ref_id"), "label", F.col("short_name").alias("name"), (F.col("kind") == "city").alias("is_city"))
    city_town = place.filter("kind IN ('city', 'town')").select(F.lit("city").alias("field"), F.col("place_id").alias("ref_id"), F.col("short_name").alias("label"), F.col("short_name").alias("name"), F.lit(False).alias("is_city"))
    refs = county_city.unionByName(city_town)
    e = table(spark, d, "entity").select("id", F.expr("stack(2, 'jurisdiction', jurisdiction, 'city', city) AS (field, value)"))
    found = map_values(e, refs, refs.select("field", F.col("label").alias("value")))
    return found.select(F.col("id").alias("entity_id"), "field", F.coalesce("ref_id", F.lit(-1)).cast("int").alias("place_id")).distinct()


# ---------------------------------------------------------------- problem 10


def typed_lines(spark, d):
    return line_groups(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "common_word"))


@catalog.query()
def p10_found(spark, d):
    types = text_types(cut(typed_lines(spark, d).select("doc_id", "pattern", "chars", "lines")))
    return types.filter("kind <> 'prose'").select("doc_id", "kind")


@catalog.query()
def p10_statistics(spark, d):
    """Every document's statistics with its type and how much of it is of that type."""
    groups = cut(typed_lines(spark, d))
    rounded = [F.bround(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "marked_lines", "common_share", "distinct_share")]
    types = text_types(groups).select("doc_id", "kind", F.bround("confidence", 4).alias("confidence"))
    return text_statistics(groups).select("doc_id", "chars", "words", "lines", *rounded).join(types, "doc_id")


# ---------------------------------------------------------------- problem 5


def owner_spellings(spark, d):
    e = table(spark, d, "entity").select("kind", "name", "operator", "parent")
    return e.select(F.explode(F.array("operator", "parent", F.when(F.col("kind") != "facility", F.col("name")))).alias("spelling"))


@catalog.query()
def p5_found(spark, d):
    linked = cut(link_spellings(owner_spellings(spark, d), "spelling"))
    side = lambda name: linked.select(F.col("spelling").alias(name), F.array("group_id").alias("keys"))
    # the pairs of a group are what is asked for; a large group is paired in slices
    return block_join(side("spelling_a"), side("spelling_b"), "spelling_a", "spelling_b").filter("spelling_a < spelling_b")


@catalog.query()
def p5_canonical(spark, d):
    """Every spelling with the canonical one of its group."""
    return link_spellings(owner_spellings(spark, d), "spelling").select("spelling", "canonical", "n")


# ---------------------------------------------------------------- problem 2


def linked_sites(spark, d):
    places = table(spark, d, "place_ref")
    registry = prepare(table(spark, d, "entity").select("id", "name", "lat", "lon", "jurisdiction"), places)
    said = table(spark, d, "site_record").select(F.col("rec_id").alias("id"), "name", "lat", "lon", "jurisdiction")
    raw = prepare(said, places)
    levels = compare(registry, raw)
    free(registry, raw)
    return decide(score(levels))


@catalog.query()
def p2_found(spark, d):
    return linked_sites(spark, d).select(F.col("l_id").alias("entity_id"), F.col("r_id").alias("rec_id"))


@catalog.query()
def p2_confidence(spark, d):
    return linked_sites(spark, d).select(F.col("l_id").alias("entity_id"), F.col("r_id").alias("rec_id"), F.bround("confidence", 4).alias("confidence"))


# ---------------------------------------------------------------- problem 8

CAPACITY = 2048


@catalog.query()
def p8_containers(spark, d):
    """The container of every document, or of each piece of one longer than a container."""
    sized = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return pack(sized, "doc_id", "n_tokens", CAPACITY).select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


@catalog.query()
def p8_fill(spark, d):
    """Containers used, by how full they are in tenths."""
    filled = p8_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    tenth = F.least(F.floor(F.col("used") * 10 / CAPACITY), F.lit(9)).cast("int")
    return filled.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))


# ---------------------------------------------------------------- problem 9


def sized_documents(spark, d):
    # only texts of listed sources are counted
    docs = table(spark, d, "documents").filter("text IS NOT NULL").join(table(spark, d, "mix_target").select("source"), "source", "left_semi")
    return docs.select("doc_id", "source", F.md5("text").alias("content"), token_count(F.col("text")).alias("tokens"))


@catalog.query()
def p9_mix(spark, d):
    return mix(sized_documents(spark, d), table(spark, d, "mix_target"))


@catalog.query()
def p9_shares(spark, d):
    targets = table(spark, d, "mix_target")
    return report(cut(mix(sized_documents(spark, d), targets)), targets)
