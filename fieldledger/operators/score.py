"""The explainable score of a site: factors, bands, flags, reasons, timing and confidence, as one projection.

Input columns: id, name, sector, subindustry, note, existence, employees, sqft, mw, fuel, gen_mwh,
cogen, labels (array of source labels), and, where known, dupes and colocated (arrays of names),
onsite_mw and onsite_fuel of generation on the site, and permit_class of its air permit.
Nulls, zeros and empty texts alike mean "not reported". No join and no shuffle: all tables of the
model are literals from config/scoring.json.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flag_tokens, truthy
from .resolve import names_echo

MODEL = json.loads((Path(__file__).parent.parent / "config" / "scoring.json").read_text())
PLACEHOLDER = MODEL["placeholder"]
MARKER = {"High": 4, "Medium": 3, "Low": 2, "Insufficient information": 1}
UNRATED = "Insufficient information"


def _lookup(values: dict, key: Column, default=None) -> Column:
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    got = F.try_element_at(m, F.coalesce(key, F.lit("")))
    return got if default is None else F.coalesce(got, F.lit(default))


def _family(what: str) -> dict:
    return {k: float(v[what]) if isinstance(v[what], (int, float)) else v[what] for k, v in MODEL["families"].items()}


def family() -> Column:
    return _lookup(MODEL["sector_family"], F.col("sector"), MODEL["default_family"])


def scale_factor() -> Column:
    """3, 2 or 1 by the industry's own measure and thresholds; 1.5 where it is not reported."""
    value = metric_value()
    big, small = _lookup(_family("big"), F.col("family")), _lookup(_family("small"), F.col("family"))
    return F.when(~truthy(value, "number"), 1.5).when(value >= big, 3.0).when(value >= small, 2.0).otherwise(1.0)


def metric_value() -> Column:
    metric = _lookup({k: v["metric"] for k, v in MODEL["families"].items()}, F.col("family"))
    return F.when(metric == "employees", F.col("employees").cast("double")).when(metric == "sqft", F.col("sqft").cast("double")).otherwise(F.col("mw"))


def _has(label: str) -> Column:
    return F.coalesce(F.array_contains("labels", MODEL["fact_sources"][label]), F.lit(False))


def fact_list() -> Column:
    """array<struct(fact, points)> of what sources report about this very plant, in fixed order."""
    mw, gen = truthy("mw", "number"), truthy("gen_mwh", "number")
    number = lambda c, d=0: F.format_number(F.col(c), d)
    facts = [
        (mw & gen, F.concat(number("mw"), F.lit(" MW, "), number("gen_mwh"), F.lit(" MWh generated")), 1.5),
        (mw & ~gen, F.concat(number("mw"), F.lit(" MW, nothing generated")), 0.0),
        (F.coalesce("cogen", F.lit(False)), F.lit("cogeneration on site"), 1.0),
        (_has("greenhouse"), F.lit("greenhouse gas filing"), 0.75),
        (_has("toxics"), F.lit("toxics filing"), 0.75),
        (truthy("onsite_mw", "number"), F.concat(number("onsite_mw"), F.lit(" MW of "), F.coalesce("onsite_fuel", F.lit("unknown fuel")), F.lit(" generated on site")), 1.0),
        (F.col("permit_class").rlike(r"(?i)major|title\s*v"), F.concat(F.lit("major air source: "), "permit_class"), 0.75),
        (truthy("permit_class") & ~F.col("permit_class").rlike(r"(?i)major|title\s*v"), F.concat(F.lit("air permit: "), "permit_class"), 0.25),
        (truthy("sqft", "number") & truthy("employees", "number"), F.concat(number("employees"), F.lit(" employees on "), number("sqft"), F.lit(" sq ft")), 0.25),
    ]
    return F.array_compact(F.array(*[F.when(c, F.struct(t.alias("fact"), F.lit(p).alias("points"))) for c, t, p in facts]))


def verified_points() -> Column:
    return F.least(F.lit(3.0), F.aggregate("fact_list", F.lit(0.0), lambda a, x: a + x["points"]))


def subtype() -> Column:
    """Kind of generating plant, from name, recorded fuel, duty and size, in that order; null for other sectors."""
    name = F.lower(F.coalesce("name", F.lit("")))
    fuel = F.lower(F.concat_ws(" ", F.coalesce("fuel", F.lit("")), F.regexp_extract(F.coalesce("note", F.lit("")), r"(?i)fuel:\s*([^|]+)", 1)))
    used = F.try_divide("gen_mwh", F.col("mw") * 8760)
    found = []
    for rule in MODEL["plant_kinds"]:
        signs = [name.rlike(rule["name"])] if "name" in rule else []
        signs += [fuel.rlike(rule["fuel"])] if "fuel" in rule else []
        signs += [F.coalesce("cogen", F.lit(False))] if rule.get("cogen") else []
        signs += [F.coalesce(used < rule["use_below"], F.lit(False))] if "use_below" in rule else []
        signs += [~truthy("mw", "number") & (F.coalesce("employees", F.lit(0)) <= rule["no_mw_and_staff_up_to"])] if "no_mw_and_staff_up_to" in rule else []
        found.append(F.when(F.exists(F.array(*signs), lambda x: x), rule["kind"]))
    return F.when(F.col("sector") == "power-generation", F.coalesce(*found, F.lit("thermal")))


def flags() -> Column:
    """array<string> of review flags in fixed order."""
    echo = names_echo(flag_tokens("name"), F.col("colocated"))
    dup, near = truthy("dupes", "array"), truthy("colocated", "array")
    rules = [
        (F.coalesce("name", F.lit("")).rlike(PLACEHOLDER), "placeholder"),
        (dup, "dupe"),
        (near & echo & ~dup, "dupe"),
        (near & ~(echo & ~dup), "shared_site"),
        (F.col("sector").isin(MODEL["low_flow_sectors"]), "low_flow"),
        (F.col("existence") == "recall", "unverified"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in rules]))


def band_of(points: Column) -> Column:
    bands = MODEL["bands"]
    out = F.when(points >= bands[0][1], bands[0][0])
    for name, least in bands[1:]:
        out = out.when(points >= least, name)
    return out


def timing() -> Column:
    status, said = F.lower(F.coalesce("plan_status", F.lit(""))), F.lower(F.coalesce("said_status", F.lit("")))
    return (
        F.when(truthy("mw", "number") & ~truthy("gen_mwh", "number"), "idle").when(status == "under construction", "construction").when(status == "proposed", "proposed")
        .when(status == "on hold", "hold").when(status == "expansion", "expansion").when(said.contains("verify"), "verify").when((status == "operating") | said.contains("operating"), "operating").otherwise("unknown")
    )


def confidence() -> Column:
    strong = F.col("scale_verified") & truthy("subindustry")
    facts = F.size("fact_list") > 0
    return F.when(F.col("existence") == "recall", "low").when(strong & facts, "high").when(strong | facts, "medium").otherwise("low")


def assess(sites: DataFrame) -> DataFrame:
    """Every derived column of the model, beside the input columns."""
    have = dict(sites.dtypes)
    for c, t in (("dupes", "array<string>"), ("colocated", "array<string>"), ("plan_status", "string"), ("said_status", "string"), ("onsite_mw", "double"), ("onsite_fuel", "string"), ("permit_class", "string")):
        if c not in have:
            sites = sites.withColumn(c, F.lit(None).cast(t))
    low = F.coalesce(F.col("sector").isin(MODEL["low_flow_sectors"]), F.lit(False))
    r = sites.withColumn("family", family()).withColumn("subtype", subtype()).withColumn("fact_list", fact_list()).withColumn("scale", scale_factor()).withColumn("verified", verified_points())
    r = r.withColumn("scale_verified", truthy(metric_value(), "number")).withColumn("flags", flags())
    of = lambda what: {k: float(v[what]) for k, v in MODEL["subtypes"].items()}
    for what in ("intensity", "breadth"):
        base = F.coalesce(_lookup(of(what), F.col("subtype")), _lookup(_family(what), F.col("family")))
        r = r.withColumn(what, F.when(low, F.least(base, F.lit(0.5))).otherwise(base))
    w = MODEL["weights"]
    r = r.withColumn("raw_score", sum(F.lit(float(w[k])) * F.col(k) / 3.0 for k in w)).withColumn("score", F.bround("raw_score", 1))
    bare = (F.col("family") == MODEL["default_family"]) & ~truthy("employees", "number") & ~truthy("sqft", "number") & (F.size("fact_list") == 0) & ~truthy(F.trim(F.coalesce("subindustry", F.lit(""))))
    unrated = F.array_contains("flags", "placeholder") | bare
    cap = _lookup({k: v["max_band"] for k, v in MODEL["subtypes"].items() if v["max_band"]}, F.col("subtype"))
    rank = lambda c: _lookup({"High": 2, "Medium": 1, "Low": 0}, c)
    r = r.withColumn("free_band", F.when(unrated, UNRATED).otherwise(band_of(F.col("raw_score"))))
    r = r.withColumn("capped", F.coalesce(rank(F.col("free_band")) > rank(cap), F.lit(False))).withColumn("band", F.when(F.col("capped"), cap).otherwise(F.col("free_band")))
    r = r.withColumn("marker", _lookup(MARKER, F.col("band"))).withColumn("timing", timing()).withColumn("confidence", confidence())
    scale_text = F.when(~F.col("scale_verified"), "size not reported, taken as typical").when(F.col("scale") == 3, "large for its industry").when(F.col("scale") == 2, "mid-size for its industry").otherwise("small for its industry")
    first = F.coalesce(F.try_element_at("fact_list", F.lit(1))["fact"], F.lit("no operating facts reported"))
    why = F.concat_ws(" ", F.coalesce("subtype", "family"), F.when(F.col("capped"), F.lit("(band capped)")))
    rated = F.slice(F.array(why, scale_text, first), 1, 3)
    r = r.withColumn("reasons", F.when(F.col("band") == UNRATED, F.array(F.when(F.array_contains("flags", "placeholder"), "names a group of plants").otherwise("too little is known"), F.lit("not a judgement of worth"))).otherwise(rated))
    return r.withColumn("apps_verified", apps_verified())


def apps_verified() -> Column:
    """The industry's applications that a reported fact implies, sorted."""
    apps = F.create_map(*[x for k, v in MODEL["families"].items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v["apps"]]))])
    own = F.try_element_at(apps, F.col("family"))
    none = F.array().cast("array<string>")
    steam = F.when(truthy("mw", "number") | F.coalesce("cogen", F.lit(False)), F.array(*map(F.lit, ["steam_header", "bfw", "cond_return", "fuel_gas"]))).otherwise(none)
    toxics = F.when(_has("toxics"), F.array(*map(F.lit, ["process_liquid", "corrosive", "effluent"]))).otherwise(none)
    return F.array_sort(F.array_distinct(F.array_intersect(own, F.concat(steam, toxics))))


def catalogue(spark: SparkSession) -> DataFrame:
    """(family, tech, weight, first, apps): technologies of each industry by weight (first choice 2, others 1), with up to four applications."""
    rows = [(f, i, a, j, t) for f, v in MODEL["families"].items() for i, a in enumerate(v["apps"]) for j, t in enumerate(MODEL["app_tech"][a])]
    each = spark.createDataFrame(rows, "family string, app_pos int, app string, tech_pos int, tech string")
    by = each.groupBy("family", "tech").agg(
        F.sum(F.when(F.col("tech_pos") == 0, 2).otherwise(1)).alias("weight"), F.min(F.col("app_pos") * 100 + F.col("tech_pos")).alias("first"),
        F.array_sort(F.collect_list(F.struct("app_pos", "app"))).alias("a"),
    )
    return by.select("family", "tech", "weight", "first", F.expr("transform(slice(a, 1, 4), x -> x.app)").alias("apps"))


def bookings(sites: DataFrame) -> DataFrame:
    """Modelled bookings. Input: id, installed map<string,double>, turn, points, capture, adder, tier; not enriched (installed null): zeros.

    Rounding is half to even.
    """
    b = MODEL["bookings"]
    price = b["price"]
    kept = sum(F.coalesce(F.try_element_at("installed", F.lit(t)), F.lit(0.0)) * F.col("turn") * F.lit(float(price[t])) for t in ("coriolis", "magnetic", "vortex"))
    clamp = F.col("points") * F.col("capture") * F.lit(float(price["clamp_on"]))
    r = sites.withColumn("_clamp", clamp).withColumn("_all", kept + F.col("_clamp") + F.col("adder"))
    enriched = F.col("installed").isNotNull()
    tier = F.when(F.col("_all") >= b["tiers"]["A"], "A").when(F.col("_all") >= b["tiers"]["B"], "B").when(F.col("_all") >= b["tiers"]["C"], "C").otherwise("D")
    zero = lambda c: F.when(enriched, F.bround(c, 0)).otherwise(0.0)
    return r.select(
        "id", zero(F.col("_all")).alias("bookings"), zero(F.col("_clamp")).alias("clamp_dollars"), zero(F.coalesce(F.try_divide(100 * F.col("_clamp"), F.col("_all")), F.lit(0.0))).alias("clamp_pct"),
        zero(F.col("_all") - F.col("_clamp") + b["multiplier"] * F.col("_clamp")).alias("weighted"), F.when(enriched, tier).otherwise("").alias("tier_modeled"),
        F.coalesce(enriched & (tier != F.coalesce("tier", F.lit(""))), F.lit(False)).alias("tier_delta"),
    )
