"""Entity resolution: placing, folding, matching, co-locating and flagging site records.

All spatial joins go through grid cells, all name joins through tokens, so no operator compares
all pairs. Null names have no tokens and match nothing; null coordinates are nowhere. Order
matters in several operators and is given by an explicit column, never by partition order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MILES_PER_DEGREE, SITE_LATITUDE, miles
from ..functions.grid import with_cell, with_near_cells
from ..functions.rounding import fixed4
from ..functions.skew import numbered
from ..functions.text import FLAG_STOP, flag_tokens, fold_tokens, jaccard, squeeze, subset_either, truthy, words
from ..session import cut, free, pack

POWER_SECTORS = ["power-generation", "district-energy"]
ANCHOR_MILES = 25.0
# fixed values: what a folded record hands on to its leader, and the figures of which the greatest counts
FOLD_FIELDS = ["note", "clamp_why", "triggers", "parent", "naics", "subparts", "permit_class", "permit_reg", "employees", "sqft", "url", "operator"]
MAX_FIELDS = ["clamp_on", "coriolis", "magnetic", "vortex"]
# fixed values: sectors outside the portfolio, and what a row says where it says nothing
MUNICIPAL = ["municipal-water", "municipal-wastewater"]
DEFAULTS = {"enriched": False, "subparts": "", "employees": 0, "clamp_why": "", "triggers": "", "plan_status": ""}
OUT_OF_TERRITORY, OUT_OF_PORTFOLIO = "out_of_territory", "out_of_portfolio"


# ------------------------------------------------------------------ placing


def jurisdiction_dims(places: DataFrame) -> DataFrame:
    """(label, key, is_city, cluster): counties by name, cities by name without ' (City)'."""
    kept = places.filter("kind IN ('county', 'city')")
    return kept.select("label", F.lower("short_name").alias("key"), (F.col("kind") == "city").alias("is_city"), "cluster")


def official_jurisdiction(rows: DataFrame, column: str, dims: DataFrame, out: str, strict: bool = False) -> DataFrame:
    """Adds `out` (label) and `out`_cluster: county by exact name, city by ' city' or ' cit' at the end, else city by bare name.

    A county wins over a city of the same bare name. `strict` leaves the official spelling
    'X (City)' unrecognised, as a reader that only knows typed suffixes would.
    """
    s = squeeze(column)
    if not strict:
        s = F.regexp_replace(s, r"\s*\(city\)$", " city")
    says_city = s.rlike(r"\s(city|cit)$")
    base = F.regexp_replace(s, r"\s+(city|cit)$", "")
    d = lambda city, p: dims.filter(F.col("is_city") == city).select(F.col("key").alias(f"_{p}k"), F.col("label").alias(f"_{p}l"), F.col("cluster").alias(f"_{p}c"))
    r = rows.withColumn("_s", s).withColumn("_base", base).withColumn("_says", says_city)
    # the dimensions are the territory's own list; the session's size check decides on broadcasting
    r = r.join(d(False, "e"), F.col("_s") == F.col("_ek"), "left").join(d(False, "b"), F.col("_base") == F.col("_bk"), "left").join(d(True, "t"), F.col("_base") == F.col("_tk"), "left")
    pick = lambda x: F.coalesce(F.col(f"_e{x}"), F.when(F.col("_says"), F.col(f"_t{x}")), F.when(~F.col("_says"), F.col(f"_b{x}")), F.col(f"_t{x}"))
    return r.withColumn(out, pick("l")).withColumn(f"{out}_cluster", pick("c")).drop("_s", "_base", "_says", "_ek", "_el", "_ec", "_bk", "_bl", "_bc", "_tk", "_tl", "_tc")


def clean_coordinates(rows: DataFrame) -> DataFrame:
    """Rows with both coordinates (not zero), western longitude, inside 36.4 < lat < 39.3, lon >= -78.9."""
    r = rows.filter(truthy("lat", "number") & truthy("lon", "number"))
    r = r.withColumn("lon", F.when(F.col("lon") > 0, -F.col("lon")).otherwise(F.col("lon")))
    return r.filter((F.col("lon") >= -78.9) & (F.col("lat") > 36.4) & (F.col("lat") < 39.3))


def nearest_anchor(rows: DataFrame, anchors: DataFrame, most: float = ANCHOR_MILES) -> DataFrame:
    """(id, anchor_id, dist) of the nearest anchor closer than `most` miles; of equally near ones the least id.

    Rings: a fine grid first. A nearest anchor found within the reach of a ring (a cell's side) is
    final; only rows still without one go on to the next, five times coarser, ring. Both inputs
    have id, lat, lon; anchors at one place are first reduced to the least id.
    """
    spots = anchors.filter("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min("id").alias("anchor_id"))
    spots = cut(spots.withColumnRenamed("lat", "a_lat").withColumnRenamed("lon", "a_lon"))
    open_rows = rows.filter("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon").distinct()
    found = None
    side = most / 25 / MILES_PER_DEGREE
    while True:
        last = side * MILES_PER_DEGREE * 0.76 >= most  # a degree of longitude is at least 0.76 of one of latitude here
        near = with_near_cells(open_rows, "lat", "lon", side).join(with_cell(spots, "a_lat", "a_lon", side), "cell")
        dist = miles(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"))
        best = near.withColumn("dist", dist).groupBy("id", "lat", "lon").agg(F.min(F.struct("dist", "anchor_id")).alias("b"))
        sure = best.filter(F.col("b.dist") < most) if last else best.filter(F.col("b.dist") <= side * MILES_PER_DEGREE * 0.76)
        sure = cut(sure.select("id", "lat", "lon", F.col("b.anchor_id").alias("anchor_id"), F.col("b.dist").alias("dist")))
        found = sure if found is None else found.unionByName(sure)
        if last:
            return found.filter(F.col("dist") < most).select("id", "anchor_id", "dist")
        open_rows = cut(open_rows.join(sure.select("id", "lat", "lon"), ["id", "lat", "lon"], "left_anti"))
        side *= 5


def place_rows(rows: DataFrame, placed: str, anchors: DataFrame, most: float = ANCHOR_MILES) -> DataFrame:
    """Every row with `anchor_id`, `dist` and `scope`: rows without a value in `placed` take their nearest anchor closer than `most` miles.

    A row without either keeps its place in the table, its scope is out_of_territory. `rows` has id, lat, lon, scope.
    """
    near = nearest_anchor(rows.filter(F.col(placed).isNull()), anchors, most)
    j = rows.join(near, "id", "left")
    lost = F.col(placed).isNull() & F.col("anchor_id").isNull()
    return j.withColumn("scope", F.when(lost, OUT_OF_TERRITORY).otherwise(F.col("scope")))


def municipal_scope(rows: DataFrame) -> DataFrame:
    """Municipal sectors are out of the portfolio, unless the row is out of the territory."""
    moved = F.coalesce(F.col("sector").isin(MUNICIPAL), F.lit(False)) & ~F.col("scope").eqNullSafe(OUT_OF_TERRITORY)
    return rows.withColumn("scope", F.when(moved, OUT_OF_PORTFOLIO).otherwise(F.col("scope")))


def fill_defaults(rows: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Columns that the rows lack, or hold null, filled with the defaults; zeros and blanks stay."""
    have = rows.columns
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()})


# ------------------------------------------------------------------ folding


COMMON_WORDS = 200  # words told apart by how common they are; of the rest none is common
LONG_NAME = 12  # names of more words meet by single words instead of pairs
FOLD_MILES = 3.0
FOLD_CELL = 0.36  # degrees; more than eight times the reach
FOLD_SLICES, SLICE_ROWS = 8, 30_000  # the cells are joined in slices: at most so many, of about so many rows or more
FOLD_PAIRS = 500_000  # pairs that are given their words at once, as far as FOLD_SLICES parts allow


def _near_word_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) of `id` near one another whose `words`, sorted, the rarest first, may agree as fold_matches asks.

    Two sets of two words or more with a Jaccard of 0.34 share two words, and so do two of which one holds the other.
    The larger set stands in its cell under every pair of its words. The smaller looks into the cells in reach under the pairs
    that the two rarest shared words can be: none lies beyond its last but least shared ones. Sets of one word meet by it,
    those of more than LONG_NAME meet by the single words. Judged in the join: the distance, on coordinates cut to 1e-4 degree,
    and the most words the two can share, by a bit of 64 for each word. The cells are joined slice by slice, so that the keys of
    one slice at a time are on disk.
    Rows: id, lat, lon, exact, words.
    """
    r = rows.withColumn("n", F.size("words")).withColumn("bits", F.expr("aggregate(words, 0L, (m, w) -> m | shiftleft(1L, cast(pmod(xxhash64(w), 64) AS int)))"))
    seen = r.agg(F.max("n").alias("longest"), F.count("*").alias("rows")).first()
    some_long = (seen["longest"] or 0) > LONG_NAME
    slices = max(1, min(FOLD_SLICES, seen["rows"] // SLICE_ROWS))
    number = lambda y, x: f"(cast(floor(({y}) / {FOLD_CELL}) AS bigint) * 100000 + cast(floor(({x}) / {FOLD_CELL}) AS bigint))"
    up, side = FOLD_MILES / MILES_PER_DEGREE * 1.001, FOLD_MILES / MILES_PER_DEGREE / math.cos(math.radians(SITE_LATITUDE)) * 1.001
    stands = f"array({number('lat', 'lon')})"
    looks = "array_distinct(array(" + ", ".join(number(f"lat {v} {up}", f"lon {h} {side}") for v in "-+" for h in "-+") + "))"
    none = "cast(array() AS array<bigint>)"
    pairs = lambda last: f"flatten(transform(slice(words, 1, greatest({last} - 1, 0)), (p, i) -> transform(slice(words, i + 2, greatest({last} - i - 1, 0)), q -> xxhash64('p', p, q))))"
    single = lambda tag, last: f"transform(slice(words, 1, {last}), p -> xxhash64('{tag}', p))"
    # the smaller of two sets shares at least 2t / (1 + t) of its words, where it is not the larger's part, of which any word does
    t = "CASE WHEN exact THEN 0.34D ELSE 0.5D END"
    shared = f"greatest(cast(ceil(2 * ({t}) / (1 + ({t})) * n - 1e-9D) AS int), 1)"
    larger = [f"CASE WHEN n BETWEEN 2 AND {LONG_NAME} THEN {pairs('n')} ELSE {none} END", single("s", "n")]
    smaller = [f"CASE WHEN n BETWEEN 2 AND {LONG_NAME} THEN {pairs(f'least(n - greatest({shared}, 2) + 2, n)')} ELSE {none} END", f"CASE WHEN n = 1 THEN {single('s', '1')} ELSE {none} END"]
    if some_long:
        larger.append(f"CASE WHEN n > {LONG_NAME} THEN {single('l', 'n')} ELSE {none} END")
        smaller.append(f"CASE WHEN n > 1 THEN {single('l', f'n - {shared} + 1')} ELSE {none} END")
    spot = [(F.floor(F.col("lat") * 10_000) * 2 + F.col("exact").cast("int")).cast("int"), F.floor(F.col("lon") * 10_000).cast("int")]
    far = miles(F.floor(F.col("ay") / 2) / 10_000, F.col("ax") / 10_000, F.floor(F.col("by") / 2) / 10_000, F.col("bx") / 10_000)
    both = (F.col("ay") % 2 != 0) & (F.col("by") % 2 != 0)
    # shared words share their bits; of words of a set that share one, all may be shared
    most = F.expr("least(bit_count(abits & bbits) + least(an - bit_count(abits), bn - bit_count(bbits)), an, bn)")
    agree = (most >= F.least("an", "bn")) | (most >= F.when(both, 0.34).otherwise(0.5) * (F.col("an") + F.col("bn") - most) - 1e-9)
    found = None
    for k in range(slices):
        own = lambda cells: cells if slices == 1 else f"filter({cells}, c -> pmod(xxhash64(c), {slices}) = {k})"  # noqa: B023, E731
        key = lambda keys, cells: F.explode(F.expr(f"flatten(transform({own(cells)}, c -> transform(concat({', '.join(keys)}), k -> xxhash64(c, k))))"))  # noqa: B023, E731
        side = lambda p, keys, cells: r.select(F.col("id").alias(p), spot[0].alias(f"{p}y"), spot[1].alias(f"{p}x"), F.col("n").alias(f"{p}n"), F.col("bits").alias(f"{p}bits"), key(keys, cells).alias("key"))  # noqa: B023, E731
        # the size of the rows says little of that of their keys, so none is broadcast
        met = side("a", smaller, looks).join(side("b", larger, stands).hint("merge"), "key").filter((F.col("a") != F.col("b")) & (far <= F.when(both, 0.6).otherwise(FOLD_MILES) + 0.02) & agree)
        pairs = cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def fold_matches(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of `ord`, a before b, that describe one plant.

    Both placed exactly: within 0.6 miles and Jaccard >= 0.34, or one name within the other; else
    within 3 miles and Jaccard >= 0.5, or one within the other. Latitudes differ by 0.06 at most.
    `rows` are read several times and should be cut or packed; the pairs are cut.
    """
    r = rows.filter("lat IS NOT NULL AND lon IS NOT NULL").select("ord", "name", "lat", "lon", F.coalesce(F.col("coord_precision") == "site", F.lit(False)).alias("exact")).withColumn("tokens", fold_tokens("name")).filter("size(tokens) > 0")
    # at most COMMON_WORDS reach the driver; they only order the words
    most = r.select(F.explode("tokens").alias("token")).groupBy("token").count().orderBy(F.desc("count"), "token").limit(COMMON_WORDS).collect()
    common = F.array(*[F.lit(w["token"]) for w in reversed(most)]) if most else F.array(F.lit(""))
    ranked = F.array_sort(F.transform("tokens", lambda w: F.struct(F.array_position(common, w).alias("p"), w.alias("w"))))
    # the hash of `ord` stands for it; should two agree, the test below sees both
    hashed = pack(r.select("ord", "lat", "lon", "exact", F.xxhash64("ord").alias("id"), F.transform(ranked, lambda w: w["w"]).alias("tokens")))
    side = lambda p: hashed.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("ord", "lat", "lon", "exact", "tokens")])
    near = cut(_near_word_pairs(hashed.select("id", "lat", "lon", "exact", F.col("tokens").alias("words"))))
    parts = max(1, min(FOLD_SLICES, near.count() // FOLD_PAIRS))
    d, j, sub = miles("a_lat", "a_lon", "b_lat", "b_lon"), jaccard("a_tokens", "b_tokens"), subset_either("a_tokens", "b_tokens")
    both = F.col("a_exact") & F.col("b_exact")
    ok = (both & (d <= 0.6) & ((j >= 0.34) | sub)) | (~both & (d <= 3.0) & ((j >= 0.5) | sub))
    met = None
    for k in range(parts):
        own = F.pmod(F.xxhash64("a"), F.lit(parts)) == k
        p = near.filter(own).join(side("a").filter(own), "a").join(side("b"), "b").filter((F.abs(F.col("a_lat") - F.col("b_lat")) <= 0.06) & ok & (F.col("a_ord") != F.col("b_ord")))
        part = cut(p.select(F.least("a_ord", "b_ord").alias("a"), F.greatest("a_ord", "b_ord").alias("b")))
        met = part if met is None else met.unionByName(part)
    pairs = cut(met.distinct())
    free(near)
    free(hashed)
    return pairs


def greedy_leaders(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """(ord, leader): each row folded into the first kept row that matches it, as a pass in order would.

    A row is kept if no earlier kept row matches it. Rounds decide rows whose earlier neighbours
    are all decided: with a kept one it is folded, without it is kept; at the end each folded row
    goes to its least kept earlier neighbour. A round is a join of the open edges with the rows decided last.
    `matches` are read several times and should be cut; afterwards they may be freed.
    """
    m = matches
    # rows that match none are kept; they take no part in the rounds
    first = cut(m.select(F.col("a").alias("ord")).distinct().join(m.select(F.col("b").alias("ord")).distinct(), "ord", "left_anti").withColumn("kept", F.lit(True)))
    # only the newly decided rows meet the edges, and an edge leaves once either end decides it
    decided, fresh, edges = [first], first, m
    while True:
        state = fresh.withColumnRenamed("ord", "a")
        seen = edges.join(state, "a", "left")
        verdict = seen.groupBy("b").agg(F.max(F.coalesce("kept", F.lit(False))).alias("folded"), F.max(F.col("kept").isNull()).alias("waiting"))
        done = cut(verdict.filter("folded OR NOT waiting").select(F.col("b").alias("ord"), (~F.col("folded")).alias("kept")))
        if not done.limit(1).count():
            break
        decided.append(done)
        left = cut(seen.filter("kept IS NULL").select("a", "b").join(done.select(F.col("ord").alias("b")), "b", "left_anti"))
        if edges is not m:
            free(edges)
        fresh, edges = done, left
    state = decided[0]
    for d in decided[1:]:
        state = state.unionByName(d)
    state = cut(state)
    free(*decided)
    kept = state.filter("kept").select("ord")
    folded = cut(m.join(kept.withColumnRenamed("ord", "a"), "a").join(state.filter("NOT kept").select(F.col("ord").alias("b")), "b").groupBy("b").agg(F.min("a").alias("leader")))
    free(state)
    return rows.select("ord").distinct().join(folded.withColumnRenamed("b", "ord"), "ord", "left").select("ord", F.coalesce("leader", "ord").alias("leader"))


def survivors(rows: DataFrame, leaders: DataFrame, fields: list[str] = FOLD_FIELDS, on: str = "ord") -> DataFrame:
    """One row a leader: each field from the leader if it has a value, else from the first folded row that has one; all sources.

    Of the figures MAX_FIELDS the greatest counts (none: 0), and of `enriched` rows the last id is kept as `enriched_id`.
    Only columns that the rows have take part. `leaders` has the column `on` of a row, and its leader.
    """
    types = dict(rows.dtypes)
    fields = [f for f in fields if f in types]
    j = rows.join(leaders, on)
    has = lambda f: truthy(f, "string" if types[f] == "string" else "number")
    most = [F.max(F.coalesce(F.col(f), F.lit(0))).alias(f) for f in MAX_FIELDS if f in types]
    if {"enriched", "id"} <= set(types):
        most.append(F.max_by(F.when(F.col("enriched"), F.col("id")), F.when(F.col("enriched"), F.col("ord"))).alias("enriched_id"))
    folds = [F.min_by(F.when(has(f), F.col(f)), F.when(has(f), F.col("ord"))).alias(f) for f in fields]
    own = [F.max(F.when(F.col("ord") == F.col("leader"), F.col(c))).alias(c) for c in ("name", "lat", "lon")]
    return j.groupBy("leader").agg(*own, *folds, *most, F.array_sort(F.collect_set("source_name")).alias("sources"), F.count("*").alias("records"))


def fold_log(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """(ord, donor, leader): each folded record's name and its leader's, to be read in order of `ord`."""
    n = rows.select("ord", "name")
    folded = leaders.filter("ord <> leader").join(n, "ord").select("ord", F.col("name").alias("donor"), F.col("leader").alias("_l"))
    return folded.join(n.select(F.col("ord").alias("_l"), F.col("name").alias("leader")), "_l").select("ord", "donor", "leader")


def overlay(rows: DataFrame, patch: DataFrame, key: str, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows with every value that `patch` states put over theirs, except the columns in `keep`.

    A column is stated if its name is in the patch's `present_keys`, even where its value is null.
    """
    cols = [c for c in patch.columns if c not in (key, "present_keys", *keep) and c in rows.columns]
    p = patch.select(key, F.col("present_keys").alias("_keys"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    j = rows.join(p, key, "left")
    put = {c: F.when(F.coalesce(F.array_contains("_keys", c), F.lit(False)), F.col(f"_p_{c}")).otherwise(F.col(c)) for c in cols}
    return j.withColumns(put).drop("_keys", *[f"_p_{c}" for c in cols])


# ------------------------------------------------------------------ matching and co-locating


def best_match(plants: DataFrame, sites: DataFrame, radius: float = 2.0) -> DataFrame:
    """(plant_id, id, score) of the best site of each plant: within `radius` miles, sharing a name token.

    score = 2 * shared tokens + 10 for a power sector; of equal scores the first by id.
    """
    side = radius / MILES_PER_DEGREE / 0.76
    p = with_near_cells(plants.filter("lat IS NOT NULL AND lon IS NOT NULL").select("plant_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), fold_tokens("name").alias("p_tokens")), "p_lat", "p_lon", side)
    s = with_cell(sites.filter(truthy("lat", "number") & truthy("lon", "number")).select("id", "lat", "lon", "sector", fold_tokens("name").alias("tokens")), "lat", "lon", side)
    j = p.join(s, "cell").filter((miles("p_lat", "p_lon", "lat", "lon") <= radius) & F.arrays_overlap("p_tokens", "tokens"))
    score = F.size(F.array_intersect("p_tokens", "tokens")) * 2 + F.when(F.col("sector").isin(POWER_SECTORS), 10).otherwise(0)
    # the greatest score, then the least id
    best = j.groupBy("plant_id").agg(F.min(F.struct((-score).alias("s"), "id")).alias("b"))
    return best.select("plant_id", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def attach_generation(matches: DataFrame, plants: DataFrame, sites: DataFrame) -> DataFrame:
    """Per matched site its generation and tier after each plant in order of plant id.

    `sites`: id, sector, tier. A power site takes the last plant's figures; 400 MW and more lift tiers
    B, C, D and none to A, 100 MW lift C, D and none to B, no generation sets D and idle.
    """
    j = matches.join(plants.select("plant_id", "mw", "fuel", "gen_mwh"), "plant_id").join(sites.select("id", "sector", "tier"), "id")
    turns = j.groupBy("id", "sector", "tier").agg(F.array_sort(F.collect_list(F.struct("plant_id", "mw", "fuel", "gen_mwh"))).alias("turns"))
    tier = F.expr(
        """aggregate(turns, coalesce(tier, ''), (t, p) -> CASE
             WHEN p.gen_mwh = 0 THEN 'D'
             WHEN p.mw >= 400 AND t IN ('', 'B', 'C', 'D', 'BC', 'CD', 'BCD') THEN 'A'
             WHEN p.mw >= 100 AND t IN ('', 'C', 'D', 'CD') THEN 'B' ELSE t END)"""
    )
    power = F.col("sector").isin(POWER_SECTORS)
    last = F.element_at("turns", -1)
    return turns.select(
        "id", F.size("turns").alias("plants"), F.when(power, tier).otherwise(F.coalesce("tier", F.lit(""))).alias("tier"),
        F.when(power, last["mw"]).alias("mw"), F.when(power, last["fuel"]).alias("fuel"), F.when(power, last["gen_mwh"]).alias("gen_mwh"),
        F.coalesce(power & F.exists("turns", lambda p: p["gen_mwh"] == 0), F.lit(False)).alias("idle"),
        F.when(~power, last["mw"]).alias("onsite_mw"), F.when(~power, last["fuel"]).alias("onsite_fuel"),
    )


def _spots(rows: DataFrame) -> DataFrame:
    """Distinct places with the least two ids and the number of ids there, so equal places make no pairs."""
    one = rows.filter("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon", "id").agg(F.count("*").alias("_"))
    by = one.groupBy("lat", "lon").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # the second least id of a place, again by an aggregation that combines early
    second = one.join(by.select("lat", "lon", "first"), ["lat", "lon"]).filter("id > first").groupBy("lat", "lon").agg(F.min("id").alias("second"))
    return by.join(second, ["lat", "lon"], "left")


def _near_spots(spots: DataFrame, radius: float) -> DataFrame:
    """Ordered pairs of different places within `radius` miles and 0.01 degree of latitude: (lat, lon, o_first, o_n)."""
    side = radius / MILES_PER_DEGREE / 0.76
    o = spots.select(F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("first").alias("o_first"), F.col("n").alias("o_n"))
    j = with_near_cells(spots.select("lat", "lon"), "lat", "lon", side).join(with_cell(o, "o_lat", "o_lon", side), "cell")
    apart = (F.col("lat") != F.col("o_lat")) | (F.col("lon") != F.col("o_lon"))
    return j.filter(apart & (F.abs(F.col("lat") - F.col("o_lat")) <= 0.01) & (miles("lat", "lon", "o_lat", "o_lon") <= radius)).select("lat", "lon", "o_first", "o_n")


def colocation_links(rows: DataFrame, radius: float = 0.3) -> DataFrame:
    """(id, links): how many other ids lie within `radius` miles; ids at one place are counted, not paired."""
    spots = cut(_spots(rows))
    around = _near_spots(spots, radius).groupBy("lat", "lon").agg(F.sum("o_n").alias("around"))
    at = spots.join(around, ["lat", "lon"], "left").select("lat", "lon", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("links"))
    return rows.filter("id IS NOT NULL").select("id", "lat", "lon").distinct().join(at, ["lat", "lon"]).select("id", "links")


def colocation_groups(rows: DataFrame, radius: float = 0.3) -> DataFrame:
    """(id, site_group) of ids with a neighbour, as pairs taken in order of ids would assign them.

    In that order a row joins the group of its least earlier neighbour; a row without an earlier
    one opens a group with its first later neighbour, unless that neighbour already has an earlier
    one, whose group it then joins. So every row points at an earlier row or is a root, and the
    chains are followed by doubling. Groups that exist are never merged, which is why this is not
    a connected component. The group's name is its root's id. One id has one place here.
    """
    from .graph import follow

    one = rows.filter("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.*")
    spots = cut(_spots(one))
    around = _near_spots(spots, radius).groupBy("lat", "lon").agg(F.min("o_first").alias("o_first"))
    at = spots.join(around, ["lat", "lon"], "left")
    own = one.join(at, ["lat", "lon"])
    least = F.least(F.when(F.col("id") > F.col("first"), F.col("first")).otherwise(F.col("second")), "o_first")  # least() skips nulls
    m = cut(own.select("id", least.alias("m")).filter("m IS NOT NULL"))
    ahead = m.select(F.col("id").alias("m"), F.col("m").alias("mm"))
    to = F.when(F.col("m") < F.col("id"), F.col("m")).when(F.col("mm") < F.col("id"), F.col("mm"))
    pointed = cut(m.join(ahead, "m", "left").select("id", to.alias("to")))
    roots = pointed.filter("to IS NULL").select("id", F.col("id").alias("site_group"))
    return roots.unionByName(follow(pointed.filter("to IS NOT NULL"), "id", "to").select("id", F.col("root").alias("site_group")))


def colocated_names(groups: DataFrame, rows: DataFrame, most: int = 8) -> DataFrame:
    """(id, colocated): the names of the other members, in order of ids, of groups of at most `most` members."""
    sizes = groups.groupBy("site_group").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    named = groups.join(sizes, "site_group").join(rows.groupBy("id").agg(F.min("name").alias("name")), "id")
    members = named.groupBy("site_group").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("members"))
    return named.join(members, "site_group").select("id", F.expr("transform(filter(members, m -> m.id <> id), m -> m.name)").alias("colocated"))


def token_frequency(rows: DataFrame, stop: Column | None = None) -> DataFrame:
    """(token, df): in how many rows' names a token occurs."""
    tokens = flag_tokens("name") if stop is None else F.array_except(flag_tokens("name"), stop)
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def place_words(rows: DataFrame) -> DataFrame:
    """(token): every word of four letters or more in a city or jurisdiction."""
    said = F.regexp_extract_all(F.lower(F.concat_ws(" ", "city", "jurisdiction")), F.lit("[a-z0-9]{4,}"), 0)
    return rows.select(F.explode(F.array_distinct(said)).alias("token")).distinct()


def near_duplicates(rows: DataFrame, most: float = 1.2, least: float = 0.55, rare: int = 4, shared: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of ids in one jurisdiction whose names nearly agree, with their Jaccard.

    Tokens without place words; a shared token is rare (in at most `rare` names) or `shared` are
    shared; Jaccard >= `least`; within `most` miles. Names meet through the rare end of their token
    sets and through grid cells. Rows: id, name, lat, lon, jurisdiction, city; one row an id.
    """
    gone = place_words(rows)
    t = rows.filter("id IS NOT NULL").select("id", F.explode(flag_tokens("name")).alias("token")).join(gone, "token", "left_anti")
    df = cut(t.groupBy("token").agg(F.count("*").alias("df")))
    sets = t.join(df, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    r = cut(rows.filter("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon", "jurisdiction").join(sets, "id"))
    side = most / MILES_PER_DEGREE / 0.76
    pre = r.withColumn("token", F.explode(F.expr(f"slice(ts, 1, cast(size(ts) - ceil(size(ts) * {least}) + 1 AS int)).token"))).drop("ts")
    a = with_near_cells(pre, "lat", "lon", side).select(F.col("id").alias("a"), "jurisdiction", "cell", "token")
    b = with_cell(pre, "lat", "lon", side).select(F.col("id").alias("b"), "jurisdiction", "cell", "token")
    same = F.col("x.jurisdiction").eqNullSafe(F.col("y.jurisdiction"))
    met = a.alias("x").join(b.alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.token") == F.col("y.token")) & same).filter("a < b").select("a", "b").distinct()
    full = lambda p: r.select(F.col("id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"), F.col("ts").alias(f"{p}_ts"))
    j = met.join(full("a"), "a").join(full("b"), "b").withColumn("common", F.array_intersect("a_ts", "b_ts"))
    close = F.try_divide(F.size("common"), F.size(F.array_union("a_ts", "b_ts")))
    telling = F.exists("common", lambda x: x["df"] <= rare) | (F.size("common") >= shared)
    return j.withColumn("jaccard", close).filter(telling & (F.col("jaccard") >= least) & (miles("a_lat", "a_lon", "b_lat", "b_lon") <= most)).select("a", "b", F.bround("jaccard", 6).alias("jaccard"))


def names_echo(tokens: Column, others: Column) -> Column:
    """Some other name shares at least 0.3 of its words with `tokens`; `others` is an array of names."""
    stop = words(FLAG_STOP)
    of = lambda name: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]{4,}"), 0)), stop)
    return F.coalesce(F.exists(others, lambda o: F.coalesce(jaccard(tokens, of(o)) >= 0.3, F.lit(False)) & (F.size(of(o)) > 0)), F.lit(False)) & (F.size(tokens) > 0)


# ------------------------------------------------------------------ rules


def exclusion_rule(rows: DataFrame, rules: list[dict], text: list[str]) -> DataFrame:
    """Adds `excluded_by`: the id of the first enabled rule whose sector or pattern (case ignored) fits, else null."""
    blob = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text])
    hits = []
    for rule in rules:
        if not rule.get("enabled"):
            continue
        fits = F.coalesce(F.col("sector").isin(rule.get("match_sector") or []), F.lit(False)) if rule.get("match_sector") else F.lit(False)
        if rule.get("match_text"):
            fits = fits | blob.rlike("(?i)" + rule["match_text"])
        hits.append(F.when(fits, F.lit(rule["id"])))
    return rows.withColumn("excluded_by", F.coalesce(*hits) if hits else F.lit(None).cast("string"))


def unique_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `unique_id`: an id met once stays; others get the registration number or six hex digits of a hash of name and place,
    and rows still equal get -2, -3 ... in `order`.

    Rows: id, name, lat, lon, registration. `order` must not tie. A row copied very often is numbered in parts.
    """
    counts = rows.groupBy("id").agg(F.count("*").alias("_n"))
    place = F.concat_ws("|", F.coalesce("name", F.lit("")), fixed4(F.coalesce("lat", F.lit(0.0))), fixed4(F.coalesce("lon", F.lit(0.0))))
    tail = F.coalesce(F.when(truthy("registration"), F.col("registration")), F.substring(F.sha1(place), 1, 6))
    r = rows.join(counts, "id").withColumn("_u", F.when(F.col("_n") > 1, F.concat_ws("-", "id", tail)).otherwise(F.col("id")))
    return numbered(r, ["_u"], order, "_k").withColumn("unique_id", F.when(F.col("_k") > 1, F.concat_ws("-", "_u", F.col("_k").cast("string"))).otherwise(F.col("_u"))).drop("_n", "_u", "_k")
