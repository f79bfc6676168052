import random

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import ledger, progress, signals

CHANGE = "entity_id string, field string, instant long, ord long, change_id string, change string, value string, reason string, duplicate_of string"
TAP = "tap_id string, entity_id string, rank int, instant long, band string"


def change(entity, kind, at, n, value=None, field="status", dup=None):
    return (entity, field, at, n, f"lc{n}", kind, value, "because", dup)


def base(spark):
    rows = [(f"A{i}", "facility", f"n{i}", "", 37.5, -77.4, "C1", "core", 1, "x", 5.0) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "id string, kind string, name string, parent string, lat double, lon double, cluster string, scope string, band int, subindustry string, miles double")


def applied(spark, changes):
    df = spark.createDataFrame(changes, CHANGE)
    return {r["id"]: r for r in ledger.apply_ledger(base(spark), df, (37.54, -77.44)).collect()}


def test_latest_wins_out_of_order_and_ties(spark):
    got = applied(spark, [change("A1", "reinstate", 2, 1), change("A1", "mark_defunct", 1, 2), change("A2", "mark_defunct", 5, 3), change("A2", "reinstate", 5, 4)])
    assert got["A1"]["status"] == "active" and got["A2"]["status"] == "active" and got["A3"]["status"] == "active"
    assert applied(spark, [change("A2", "reinstate", 5, 3), change("A2", "mark_defunct", 5, 4)])["A2"]["status"] == "defunct"


def test_corrections_last_per_field_and_new_miles(spark):
    got = applied(spark, [change("A1", "correct", 1, 1, "old", "name"), change("A1", "correct", 2, 2, "new", "name"), change("A1", "correct", 1, 3, "38.0", "lat"), change("A2", "correct", 1, 4, "bad", "lat")])
    assert got["A1"]["name"] == "new" and got["A1"]["lat"] == 38.0 and got["A1"]["miles"] == 31.8 and got["A1"]["lon"] == -77.4
    assert got["A2"]["lat"] == 37.5 and got["A2"]["miles"] == 5.0 and got["A3"]["name"] == "n3"


def test_base_is_unchanged_and_empty_ledger(spark):
    assert {r["status"] for r in applied(spark, []).values()} == {"active"}


def test_duplicate_redirect_and_loop(spark):
    df = spark.createDataFrame([change("A2", "mark_duplicate", 1, 1, dup="A1")], CHANGE)
    assert [(r["id"], r["root"]) for r in ledger.duplicate_chains(ledger.latest_status(df)).collect()] == [("A2", "A1")]
    df = spark.createDataFrame([change("A2", "mark_duplicate", 1, 1, dup="A1"), change("A1", "mark_duplicate", 1, 2, dup="A2")], CHANGE)
    assert ledger.duplicate_chains(ledger.latest_status(df)).filter("looped").count() == 2


def test_violations(spark):
    rows = [
        change("A1", "add_entity", 1, 1, field="record"), change("N1", "mark_defunct", 1, 2), change("N1", "add_entity", 2, 3, field="record"), change("N1", "mark_defunct", 3, 4),
        change("A1", "mark_duplicate", 1, 5), change("A1", "mark_duplicate", 1, 6, dup="A1"), change("A1", "mark_duplicate", 1, 7, dup="zz"), change("A1", "correct", 1, 8, "v", "potential"), change("A1", "correct", 1, 9, "x", "lat"), change("A1", "correct", 1, 10, "38", "lat"),
    ]
    got = sorted((r["change_id"], r["problem"]) for r in ledger.violations(spark.createDataFrame(rows, CHANGE), base(spark).select("id")).collect())
    assert got == sorted([("lc1", "added twice"), ("lc2", "unknown entity"), ("lc5", "duplicate of nothing"), ("lc6", "duplicate of itself"), ("lc7", "unknown target"), ("lc8", "field not correctable"), ("lc9", "not a number")])


def taps_df(spark, rows):
    return spark.createDataFrame(rows, TAP).withColumn("seq", F.struct("instant", F.col("tap_id").alias("tap")))


def test_cumulative_weighted_points(spark):
    t = taps_df(spark, [("t1", "H", 3, 1, "High"), ("t2", "H", 1, 2, "Low"), ("t3", "O", 2, 1, None)])
    ents = spark.createDataFrame([("H", "facility", "Low"), ("O", "oem", None)], "id string, kind string, base_band string")
    paid = {r["tap_id"]: (r["old_rank"], r["new_rank"], r["points"]) for r in progress.stage_points(progress.advancing_taps(t), ents).collect()}
    assert paid == {"t1": (0, 3, (1 + 3 + 5) * 3), "t3": (0, 2, (1 + 3) * 3)}


def test_advancing_taps_equal_a_replay(spark):
    rng = random.Random(10)
    rows = [(f"t{i}", rng.choice("abc"), rng.randint(1, 4), rng.randrange(15), None) for i in range(200)]
    got = {r["tap_id"]: (r["old_rank"], r["new_rank"]) for r in progress.advancing_taps(taps_df(spark, rows)).collect()}
    stage, want = {}, {}
    for t, e, k, at, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if k > stage.get(e, 0):
            want[t] = (stage.get(e, 0), k)
            stage[e] = k
    assert got == want


def test_undo_removes_tap_and_itself(spark):
    e = spark.createDataFrame([("a", "won", None), ("b", "undo", "a"), ("c", "met", None), ("d", "undo", None)], "id string, action string, undo_of string")
    assert [r["id"] for r in progress.without_undone(e).collect()] == ["c"]


def test_rank_ladder_and_boundaries(spark):
    ladder = progress.rank_ladder(spark)
    floors = [r["min_points"] for r in ladder.orderBy("level").collect()]
    assert len(floors) == 22 and floors[:4] == [0, 10, 40, 95] and floors[-1] == 5760 and all(a < b for a, b in zip(floors, floors[1:]))
    p = spark.createDataFrame([(0,), (9,), (10,), (10**7,)], "points long")
    assert [(r["level"], r["next_at"]) for r in progress.rank_of(p, ladder).orderBy("points").collect()] == [(1, 10), (1, 10), (2, 40), (22, None)]


def replay_shares(pool, taps, statuses):
    live, done, out, fired = {e: True for e in pool}, set(), {}, {}
    stream = sorted([(at, 0, n, e, s) for e, at, n, s in statuses] + [(at, 1, i, e, None) for i, (e, at) in enumerate(taps)])
    for at, src, _, e, s in stream:
        if e not in pool:
            continue
        if src == 0:
            live[e] = s == "active"
        else:
            done.add(e)
        alive = [x for x in pool if live[x]]
        out[at] = (sum(x in done for x in alive), len(alive))
        if src == 1:
            for m, _ in progress.MILESTONES:
                if alive and out[at][0] / len(alive) >= m:
                    fired.setdefault(m, at)
    return out, fired


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_share_timeline_and_milestones_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    pool = [f"e{i}" for i in range(8)]
    taps = [(e, 10 * rng.randint(1, 30) + 1) for e in rng.sample(pool, 6)]
    statuses = [(rng.choice(pool), 10 * rng.randint(1, 30), n, rng.choice(["active", "defunct", "not_a_fit"])) for n in range(14)]
    first = spark.createDataFrame(taps, "entity_id string, instant long")
    st = spark.createDataFrame(statuses, "entity_id string, instant long, ord long, status string")
    tl = progress.share_timeline(first, st, spark.createDataFrame([(e, "C1") for e in pool], "id string, cluster string")).cache()
    want, fired = replay_shares(pool, taps, statuses)
    for r in tl.collect():
        assert (r["done"], r["size"]) == want[r["instant"]]
    adv = spark.createDataFrame([("C1", at) for _, at in taps], "cluster string, instant long")
    assert {r["share"]: r["instant"] for r in progress.milestones(tl, adv).collect()} == fired


def replay_transfers(events):
    stage, adv = {}, []
    for kind, _, rec in events:
        if kind == "mark":
            change_id, source, target = rec
            if source in stage:
                old = stage.pop(source)
                if old > stage.get(target, 0):
                    stage[target] = old
        else:
            tap, target, rank = rec
            if rank > stage.get(target, 0):
                adv.append(tap)
                stage[target] = rank
    return stage, adv


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_transferred_stages_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    events = []
    for at in range(40):
        if rng.random() < 0.25:
            i = rng.randrange(1, 8)
            target = f"e{rng.randrange(0, i)}"  # always to a lower one: no loops
            events.append(("mark", at, (f"c{at}", f"e{i}", target)))
        else:
            events.append(("tap", at, (f"t{at}", f"e{rng.randrange(8)}", rng.randint(1, 4))))
    taps = spark.createDataFrame([(r[0], r[1], r[2], at) for k, at, r in events if k == "tap"], "tap_id string, target string, rank int, seq long")
    marks = spark.createDataFrame([(r[0], r[1], r[2], at) for k, at, r in events if k == "mark"], "change_id string, source string, target string, seq long")
    stages, adv = progress.transferred_stages(taps, marks)
    want, want_adv = replay_transfers(events)
    assert {r["entity"]: r["rank"] for r in stages.collect()} == want
    assert sorted(r["tap_id"] for r in adv.collect()) == sorted(want_adv)


def test_a_stage_is_handed_on_any_number_of_times(spark):
    n = 60
    marks = [(f"c{i:03d}", f"e{i}", f"e{i + 1}", i + 1) for i in range(n)]
    taps = [("t0", "e0", 3, 0), ("t1", "e20", 4, 50), ("t2", "e0", 2, 99)]
    stages, adv = progress.transferred_stages(
        spark.createDataFrame(taps, "tap_id string, target string, rank int, seq long"),
        spark.createDataFrame(marks, "change_id string, source string, target string, seq long"),
    )
    assert {r["entity"]: r["rank"] for r in stages.collect()} == {f"e{n}": 3, "e20": 4, "e0": 2}
    assert sorted((r["tap_id"], r["old_rank"]) for r in adv.collect()) == [("t0", 0), ("t1", 0), ("t2", 0)]


def test_chains_of_marks_have_any_length(spark):
    n = 150
    marks = [(f"e{i}", i, i, f"e{i + 1}") for i in range(n)]
    rows = [("early", "e0", 49), ("late", "e0", n), ("before", "e0", -1), ("beside", "x", 3), ("nobody", None, 3), ("never", "e0", None)]
    got = progress.targets_as_of(
        spark.createDataFrame(rows, "row_id string, entity_id string, instant long"),
        spark.createDataFrame(marks, "entity_id string, instant long, ord long, duplicate_of string"),
    )
    want = {"early": "e50", "late": f"e{n}", "before": "e0", "beside": "x", "nobody": None, "never": "e0"}
    assert {r["row_id"]: r["target"] for r in got.collect()} == want


def test_merge_order_is_one_numbering(spark):
    c = spark.createDataFrame([(f"c{i}", i // 3, i) for i in range(50)], "id string, instant long, ord long")
    e = spark.createDataFrame([(f"e{i}", i // 2, i) for i in range(60)], "id string, instant long, ord long")
    got = [(r["source"], r["id"]) for r in progress.merge_order(c, e).orderBy("turn").collect()]
    want = sorted([(i // 3, 0, i, "ledger", f"c{i}") for i in range(50)] + [(i // 2, 1, i, "log", f"e{i}") for i in range(60)])
    assert got == [(w[3], w[4]) for w in want]


def test_review_window(spark):
    day = 86_400_000_000
    s = spark.createDataFrame([("a", 0), ("b", 0), ("c", 10 * day)], "signal_id string, received long")
    r = spark.createDataFrame([("a", 1 * day, 1), ("a", 2 * day, 2), ("b", 10 * day, 3), ("c", day, 4)], "signal_id string, instant long, ord long")
    assert {x["signal_id"]: x["points"] for x in progress.review_points(r, s).collect()} == {"a": 1, "b": 0, "c": 0}


def test_freshness_curve_and_snapshots(spark):
    hour = 3_600_000_000
    now = 1_000 * hour
    rows = [("a", now - 10 * hour, "manual"), ("b", now - 96 * hour, "manual"), ("c", now - 192 * hour, "manual"), ("d", now - hour, "registry_snapshot"), ("e", now + hour, "manual"), ("f", None, "manual")]
    df = spark.createDataFrame(rows, "k string, received long, t string").select("k", signals.freshness(F.col("received"), F.col("t"), now).alias("v"))
    assert {r["k"]: r["v"] for r in df.collect()} == {"a": 1.0, "b": 0.75, "c": 0.0, "d": 0.0, "e": 1.0, "f": 0.0}


def test_seed_scope_is_repeatable(spark):
    e = spark.createDataFrame([("1", "n", "core", "proposed", "P"), ("2", "n", "core", "construction", "C"), ("3", "n", "core", "operating", "O"), ("4", "n", "out_of_portfolio", "proposed", "P")], "id string, name string, scope string, timing_k string, timing_label string")
    one = signals.seed(e)
    assert sorted(r["signal_id"] for r in one.collect()) == ["sig-snap-1-proposed", "sig-snap-2-construction"]
    assert signals.append_new(one, signals.seed(e)).count() == 0


def test_triage_last_wins(spark):
    a = spark.createDataFrame([("s", "signal_dismissed", 1, 1), ("s", "signal_pinned", 1, 2), ("s", "surveyed", 9, 3), (None, "signal_pinned", 1, 4)], "signal_id string, action string, instant long, ord long")
    assert [(r["signal_id"], r["status"]) for r in signals.triage(a).collect()] == [("s", "pinned")]


def test_orphans_and_unplaced(spark):
    s = spark.createDataFrame([("a", "E1", "manual", None, 1), ("b", "zz", "manual", None, 1), ("c", None, "manual", "design", 1)], "signal_id string, entity_id string, source_type string, stage string, received long")
    known = spark.createDataFrame([("E1",)], "id string")
    none = spark.createDataFrame([], "signal_id string, status string")
    assert sorted(r["signal_id"] for r in signals.view(s, none, known, 10).collect()) == ["a", "c"]
    assert [r["signal_id"] for r in signals.orphans(s, known).collect()] == ["b"]


RAW = CHANGE + ", entity string"


def test_added_entries_enter_the_registry(spark):
    """The first readable addition counts; an id of the base is not added again; corrections and status apply to added entries."""
    entry = lambda i, name: f'{{"id": "{i}", "kind": "facility", "name": "{name}", "lat": 38.0, "lon": -77.0, "cluster": "C2", "scope": "core", "miles": 40.0}}'
    rows = [
        (*change("N1", "add_entity", 2, 1, field="record"), entry("N1", "later")), (*change("N1", "add_entity", 1, 2, field="record"), entry("N1", "first")),
        (*change("A1", "add_entity", 1, 3, field="record"), entry("A1", "again")), (*change("N2", "add_entity", 1, 4, field="record"), entry("N9", "other id")),
        (*change("N3", "add_entity", 1, 5, field="record"), "{broken"), (*change("N4", "add_entity", 1, 6, field="record"), None),
        (*change("N1", "correct", 3, 7, "new", "name"), None), (*change("N1", "mark_defunct", 4, 8), None), (*change("N1", "correct", 3, 9, "37.5", "lat"), None),
    ]
    df = spark.createDataFrame(rows, RAW)
    added = ledger.additions(df)
    assert {(r["id"], r["name"], r["since"]) for r in added.collect()} == {("N1", "first", 1), ("A1", "again", 1)}
    got = {r["id"]: r for r in ledger.apply_ledger(base(spark).withColumn("existence", F.lit("registry")), df, (37.54, -77.44), added).collect()}
    assert set(got) == {"A1", "A2", "A3", "N1"} and got["A1"]["name"] == "n1"
    n = got["N1"]
    assert (n["name"], n["status"], n["existence"], n["lat"], n["miles"], n["cluster"]) == ("new", "defunct", "ledger", 37.5, 24.2, "C2")


def test_additions_keep_a_contract(spark):
    good = '{"id": "N01", "kind": "facility", "name": "n", "lat": 38, "lon": -77.5}'
    texts = {"N01": good, "N02": good, "N03": '{"id": "N03", "kind": "ship", "name": "n", "lat": 38, "lon": -77.5}', "N04": None, "N05": '{"id": "N05", "kind": "oem", "name": "n", "lat": 99, "lon": -77.5}'}
    rows = [(*change(i, "add_entity", 1, n, field="record"), t) for n, (i, t) in enumerate(texts.items())]
    got = {(r["change_id"], r["problem"]) for r in ledger.violations(spark.createDataFrame(rows, RAW), base(spark).select("id"), ledger.ENTRY_CONTRACT).collect()}
    assert got == {("lc1", "entry of another id"), ("lc2", "entry breaks its contract"), ("lc3", "entry of another id"), ("lc3", "entry breaks its contract"), ("lc4", "entry breaks its contract")}


def test_a_share_grows_and_shrinks_with_its_pool(spark):
    pool = spark.createDataFrame([("A", "C1", None), ("B", "C1", None), ("N", "C1", 20)], "id string, cluster string, since long")
    first = spark.createDataFrame([("A", 10), ("N", 30)], "entity_id string, instant long")
    none = spark.createDataFrame([], "entity_id string, instant long, ord long, status string")
    got = [(r["instant"], r["done"], r["size"]) for r in progress.share_timeline(first, none, pool).orderBy("instant").collect()]
    assert got == [(10, 1, 2), (20, 1, 3), (30, 2, 3)]


def test_signal_counters(spark):
    s = spark.createDataFrame([("a", "E1", "manual", "x", "rule"), ("b", "zz", "manual", "x", "rule"), ("c", None, "web", None, "person")], "signal_id string, entity_id string, source_type string, kind string, generated_by string")
    t = spark.createDataFrame([("a", "pinned")], "signal_id string, status string")
    got = {(r["what"], r["value"]): r["n"] for r in signals.counters(s, t, spark.createDataFrame([("E1",), ("E1",)], "id string")).collect()}
    assert got[("signals_by_place", "placed")] == got[("signals_by_place", "orphaned")] == got[("signals_by_place", "unplaced")] == 1
    assert got[("signals_by_status", "pinned")] == 1 and got[("signals_by_status", "new")] == 2 and got[("signals_by_kind", None)] == 1 and got[("signals_by_generator", "rule")] == 2


def test_targets_are_as_of_each_row(spark):
    rng = random.Random(3)
    ids = "ABCDEF"
    marks = [(rng.choice(ids), i, i, rng.choice([None, *ids])) for i in range(60)]
    marks = [(e, at, n, to if to != e else None) for e, at, n, to in marks]
    rows = [(f"r{i}", rng.choice(ids), rng.randrange(60)) for i in range(80)]

    def target(entity, at):
        now = {}
        for e, when, _, to in marks:
            if when <= at:
                now[e] = to
        seen, cur = {entity}, entity
        while now.get(cur):
            cur = now[cur]
            if cur in seen:
                return entity
            seen.add(cur)
        return cur

    s = spark.createDataFrame(marks, "entity_id string, instant long, ord long, duplicate_of string")
    got = {r["row_id"]: r["target"] for r in progress.targets_as_of(spark.createDataFrame(rows, "row_id string, entity_id string, instant long"), s).collect()}
    assert got == {r: target(e, at) for r, e, at in rows}


def test_notifications_and_clutter(spark, tmp_path):
    s = spark.createDataFrame([("a", "E1"), ("b", "E2"), ("c", None), ("d", "zz")], "signal_id string, entity_id string")
    r = spark.createDataFrame([("E1", "active"), ("E2", "defunct")], "id string, status string")
    assert sorted(x["signal_id"] for x in signals.of_active(s, r).collect()) == ["a", "c", "d"]
    e = spark.createDataFrame([("E1", "Low"), ("E2", "Low"), ("E3", None), ("E4", "High")], "id string, band string")
    assert sorted(x["id"] for x in signals.decluttered(e, spark.createDataFrame([("E2",), ("E2",), (None,)], "entity_id string")).collect()) == ["E2", "E3", "E4"]
    from fieldledger.sources.stores import save_json

    save_json(r, str(tmp_path / "out"))
    assert sorted(x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":"E1","status":"active"}', '{"id":"E2","status":"defunct"}']
