"""The change ledger over the registry: checks, latest-wins fold, duplicate chains.

Changes come as rows (entity_id, field, instant, ord, change_id, change, value, reason,
duplicate_of), each id once (see changefeed.first_deliveries). Changes apply by (instant, ord).
Nulls: a change without entity, instant or kind takes no effect. The base is never changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import HOME_LATITUDE, miles
from .graph import follow
from .validate import errors_of

# fixed values of the ledger
STATUS_OF = {"mark_defunct": "defunct", "mark_not_a_fit": "not_a_fit", "mark_assigned_elsewhere": "assigned_elsewhere", "mark_duplicate": "duplicate", "reinstate": "active"}
CORRECTABLE = ["name", "lat", "lon", "subindustry", "parent"]


def status_column(change: str):
    return F.coalesce(*[F.when(F.col(change) == k, v) for k, v in STATUS_OF.items()])


def latest_status(changes: DataFrame) -> DataFrame:
    """(entity_id, status, change_id, reason, duplicate_of, instant): the last change of status of each entity."""
    s = changes.filter(F.col("change").isin(*STATUS_OF) & F.col("instant").isNotNull() & F.col("entity_id").isNotNull())
    last = s.groupBy("entity_id").agg(F.max(F.struct("instant", "ord", "change_id", "change", "reason", "duplicate_of")).alias("r"))
    dup = F.when(F.col("r.change") == "mark_duplicate", F.col("r.duplicate_of"))
    return last.select("entity_id", status_column("r.change").alias("status"), "r.change_id", "r.reason", dup.alias("duplicate_of"), "r.instant")


def latest_corrections(changes: DataFrame) -> DataFrame:
    """(entity_id, name, lat, lon, subindustry, parent): the last corrected text of each field, null where none."""
    c = changes.filter((F.col("change") == "correct") & F.col("field").isin(CORRECTABLE) & F.col("value").isNotNull() & F.col("instant").isNotNull() & F.col("entity_id").isNotNull())
    pick = [F.max(F.when(F.col("field") == f, F.struct("instant", "ord", "value"))).alias(f) for f in CORRECTABLE]
    return c.groupBy("entity_id").agg(*pick).select("entity_id", *[F.col(f)["value"].alias(f) for f in CORRECTABLE])


# what an added entry brings along, as JSON text
ENTRY = "id string, kind string, name string, parent string, lat double, lon double, cluster string, scope string, band int, subindustry string, miles double"


def additions(changes: DataFrame) -> DataFrame:
    """(id, kind, ..., miles of ENTRY, existence, since): the entry of the first add_entity of each id, by (instant, ord), and its instant.

    `changes` has `entity`, its JSON text. Text that is null, unreadable or names another id adds nothing.
    """
    c = changes.filter("change = 'add_entity' AND entity_id IS NOT NULL AND instant IS NOT NULL").withColumn("e", F.from_json("entity", ENTRY)).filter("e.id = entity_id")
    first = c.groupBy("entity_id").agg(F.min_by("e", F.struct("instant", "ord")).alias("e"), F.min("instant").alias("since"))
    return first.select("e.*", F.lit("ledger").alias("existence"), "since")


def apply_ledger(base: DataFrame, changes: DataFrame, home: tuple[float, float], added: DataFrame | None = None) -> DataFrame:
    """The effective registry: base rows and added ones, with corrections and status on top; miles anew where a coordinate was corrected.

    `added` as from `additions`; an id that the base has is not added again. Changes to an added entry count whether they
    stand before or after its addition, as in the change feed's own rule.
    """
    if added is not None:
        fresh = added.drop("since").join(base.select("id"), "id", "left_anti")
        base = base.unionByName(fresh, allowMissingColumns=True)
    fixed = latest_corrections(changes).select("entity_id", *[F.col(c).alias(f"_{c}") for c in CORRECTABLE])
    status = latest_status(changes).select("entity_id", F.col("status").alias("_status"), F.col("duplicate_of").alias("_dup"), F.col("change_id").alias("_change"))
    b = base.withColumnRenamed("id", "entity_id").join(fixed, "entity_id", "left").join(status, "entity_id", "left")
    lat, lon = F.coalesce(F.expr("try_cast(_lat AS double)"), "lat"), F.coalesce(F.expr("try_cast(_lon AS double)"), "lon")
    moved = F.expr("try_cast(_lat AS double) IS NOT NULL OR try_cast(_lon AS double) IS NOT NULL")
    far = F.bround(miles(lat, lon, F.lit(home[0]), F.lit(home[1]), at=HOME_LATITUDE), 1)
    return b.select(
        F.col("entity_id").alias("id"), "kind", F.coalesce("_name", "name").alias("name"), F.coalesce("_parent", "parent").alias("parent"), lat.alias("lat"), lon.alias("lon"),
        "cluster", "scope", "band", F.coalesce("_subindustry", "subindustry").alias("subindustry"), F.when(moved, far).otherwise(F.col("miles")).alias("miles"),
        F.coalesce("_status", F.lit("active")).alias("status"), F.col("_dup").alias("duplicate_of"), F.col("_change").alias("change_id"), *[c for c in ("existence",) if c in base.columns],
    )


def audit_trail(changes: DataFrame) -> DataFrame:
    """(change_id, entity_id, effect, instant, ord): what each change did, to be read in order of (instant, ord)."""
    effect = F.when(F.col("change") == "add_entity", "added").when(F.col("change") == "correct", F.concat(F.lit("corrected "), "field")).otherwise(F.concat(F.lit("status "), status_column("change")))
    return changes.filter("instant IS NOT NULL").select("change_id", "entity_id", effect.alias("effect"), "instant", "ord")


# fixed values of an added entry's contract
ENTRY_CONTRACT = {
    "type": "object", "required": ["id", "kind", "name", "lat", "lon"],
    "properties": {
        "id": {"type": "string", "minLength": 3, "maxLength": 80, "pattern": "^[A-Za-z0-9_.:-]+$"}, "kind": {"enum": ["facility", "oem", "engineering_office", "integrator", "distributor"]},
        "name": {"type": "string", "minLength": 1, "maxLength": 200}, "lat": {"type": "number", "minimum": 36, "maximum": 40}, "lon": {"type": "number", "minimum": -80, "maximum": -74}, "scope": {"enum": ["core", "extended"]},
    },
}


def violations(changes: DataFrame, known: DataFrame, contract: dict | None = None) -> DataFrame:
    """(change_id, problem): changes that break a rule, against ids known from the base or added earlier in the ledger.

    `known`: id of the base. An added id is known from its first add_entity on. With a `contract` the JSON text in
    `entity` of an addition must keep it and carry the id of its change.
    """
    base = known.select(F.col("id").alias("entity_id")).filter("entity_id IS NOT NULL").distinct().withColumn("in_base", F.lit(True))
    order = F.struct("instant", "ord")
    added = changes.filter("change = 'add_entity' AND entity_id IS NOT NULL").groupBy("entity_id").agg(F.min(order).alias("since"))
    target = lambda d: d.select([F.col(c).alias(c if c == "x" else f"t_{c}") for c in d.columns])
    c = changes.join(base, "entity_id", "left").join(added, "entity_id", "left")
    c = c.join(target(base).withColumnRenamed("t_entity_id", "duplicate_of"), "duplicate_of", "left").join(target(added).withColumnRenamed("t_entity_id", "duplicate_of"), "duplicate_of", "left")
    is_known = F.coalesce("in_base", F.lit(False)) | F.coalesce(F.col("since") < order, F.lit(False))
    target_known = F.coalesce("t_in_base", F.lit(False)) | F.coalesce(F.col("t_since") < order, F.lit(False))
    number = F.expr("try_cast(value AS double)")
    rules = [
        (F.col("instant").isNull(), "unreadable ts"),
        ((F.col("change") == "add_entity") & is_known, "added twice"),
        ((F.col("change") != "add_entity") & ~is_known, "unknown entity"),
        ((F.col("change") == "mark_duplicate") & F.col("duplicate_of").isNull(), "duplicate of nothing"),
        ((F.col("change") == "mark_duplicate") & (F.col("duplicate_of") == F.col("entity_id")), "duplicate of itself"),
        ((F.col("change") == "mark_duplicate") & F.col("duplicate_of").isNotNull() & ~target_known, "unknown target"),
        ((F.col("change") == "correct") & ~F.coalesce(F.col("field").isin(CORRECTABLE), F.lit(False)), "field not correctable"),
        ((F.col("change") == "correct") & F.col("value").isNull(), "no value"),
        ((F.col("change") == "correct") & F.col("field").isin("lat", "lon") & F.col("value").isNotNull() & number.isNull(), "not a number"),
    ]
    if contract is not None:
        own = F.try_variant_get(F.try_parse_json("entity"), "$.id", "string")
        rules += [
            ((F.col("change") == "add_entity") & ~own.eqNullSafe(F.col("entity_id")), "entry of another id"),
            ((F.col("change") == "add_entity") & (F.size(errors_of(F.coalesce("entity", F.lit("")), contract)) > 0), "entry breaks its contract"),
        ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in rules]))
    return c.select("change_id", F.explode(found).alias("problem"))


def duplicate_chains(status: DataFrame) -> DataFrame:
    """(id, root, depth, looped) of every entity whose last status is duplicate; root is null in or before a loop."""
    return follow(status.filter("status = 'duplicate'"), "entity_id", "duplicate_of")
