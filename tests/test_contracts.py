import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldledger.operators import geo_etl, score
from fieldledger.operators.validate import SchemaError, check_schema, errors_of
from fieldledger.sources import geojson, stores
from fieldledger.streaming import activity

CONTRACT = {
    "type": "object", "additionalProperties": False, "required": ["id", "ts"],
    "definitions": {"place": {"type": "object", "required": ["lat"], "properties": {"lat": {"type": "number", "minimum": 36, "maximum": 40}}}},
    "properties": {
        "id": {"type": "string", "pattern": "^lb-[a-z0-9]{3}$"}, "ts": {"type": "string", "format": "date-time"}, "n": {"type": "integer"}, "x": {"type": ["number", "null"]},
        "role": {"type": "string", "maxLength": 12, "pattern": "^[^@0-9]*$"}, "kind": {"enum": ["a", "b", None]}, "at": {"$ref": "#/definitions/place"}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "minLength": 2}},
    },
}


def errors(spark, value, schema=CONTRACT):
    raw = value if isinstance(value, str) or value is None else json.dumps(value)
    return spark.createDataFrame([(raw,)], "raw string").select(errors_of("raw", schema).alias("e")).first()["e"]


OK = {"id": "lb-abc", "ts": "2026-01-02T03:04:05.5Z"}


def test_valid_and_absent_parts(spark):
    assert errors(spark, OK) == []
    assert errors(spark, OK | {"n": 3, "x": None, "kind": None, "at": {"lat": 37.5}, "tags": ["aa"], "role": "plant lead"}) == []


@pytest.mark.parametrize(
    ("extra", "want"),
    [
        ({"n": True}, "$.n: not integer"), ({"n": 3.5}, "$.n: not integer"), ({"n": "3"}, "$.n: not integer"), ({"zz": 1}, "$: unknown zz"), ({"ts": "2026-13-02T03:04:05Z"}, "$.ts: no instant"), ({"ts": "2026-01-02T03:04:05+01:00"}, "$.ts: no instant"),
        ({"role": "a@b"}, "$.role: pattern"), ({"role": "call 555"}, "$.role: pattern"), ({"role": "far too long a role"}, "$.role: too long"), ({"kind": "c"}, "$.kind: not an allowed value"), ({"at": {"lat": 99}}, "$.at.lat: too large"), ({"at": {}}, "$.at: lacks lat"),
        ({"tags": ["aa", "b"]}, "$.tags[]: too short"), ({"tags": ["aa", "bb", "cc"]}, "$.tags: too many items"), ({"x": "1"}, "$.x: not number/null"),
    ],
)
def test_one_error_each(spark, extra, want):
    assert errors(spark, OK | extra) == [want]


def test_missing_unreadable_null(spark):
    assert errors(spark, {"id": "lb-abc"}) == ["$: lacks ts"]
    assert errors(spark, "{oops") == ["$: unreadable"] and errors(spark, None) == ["$: unreadable"]
    assert errors(spark, [1]) == ["$: not object"]


def test_unknown_keyword_is_refused():
    with pytest.raises(SchemaError):
        check_schema({"oneOf": []})
    with pytest.raises(SchemaError):
        check_schema({"properties": {"a": {"items": {"format": "email"}}}})


SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("ts", T.StringType()), T.StructField("n", T.LongType())])


def test_store_round_trip_and_refusals(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "log"), CONTRACT, SCHEMA)
    assert s.raw().count() == 0
    rec = lambda i, n: spark.createDataFrame([(i, "2026-01-02T03:04:05Z", n)], SCHEMA)
    assert s.append(rec("lb-abc", 1)) == 1 and s.append(rec("lb-abd", None)) == 1
    assert sorted((r["id"], r["n"]) for r in s.read().collect()) == [("lb-abc", 1), ("lb-abd", None)]
    for bad in (rec("lb-abc", 2), rec("nope", 1)):
        with pytest.raises(stores.StoreError):
            s.append(bad)
    (tmp_path / "log" / "extra.txt").write_text('\n{"id": "lb-xyz"}\n{"id": "lb-abc", "ts": "2026-01-02T03:04:05Z"}\n')
    assert sorted(e for r in s.check().collect() for e in r["errors"]) == ["$.id: repeated lb-abc", "$.id: repeated lb-abc", "$: lacks ts"]
    with pytest.raises(stores.StoreError):
        s.read()


def test_json_scans(spark, tmp_path):
    one = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    assert stores.read_json(spark, str(tmp_path / "none.json"), one).count() == 0
    (tmp_path / "a.json").write_text('[{"id": "x", "v": 1}]')
    (tmp_path / "b.json").write_text('[{"id": "x", "v": 2}, {"id": "y", "v": 3}]')
    rows = stores.read_json_files(spark, str(tmp_path / "*.json"), one)
    assert sorted(map(tuple, stores.last_file_wins(rows, "id").collect())) == [("x", 2), ("y", 3)]
    (tmp_path / "c.json").write_text("{nope")
    with pytest.raises(Exception):  # noqa: B017
        stores.read_json(spark, str(tmp_path / "c.json"), one).collect()
    m = {r["file"]: r["bytes"] for r in stores.manifest(spark, str(tmp_path / "a.json")).collect()}
    assert m == {"a.json": 21}


def test_geojson_source(spark, tmp_path):
    fc = {"features": [{"properties": {"NAME": "R"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}}, {"geometry": {"type": "Point", "coordinates": [0, 0]}}]}
    (tmp_path / "x.geojson").write_text(json.dumps(fc))
    geojson.register(spark)
    by = lambda at: spark.read.format("geojson").load(at).count()
    assert by(f"file://{tmp_path}") == by(f"{tmp_path}/x.*json") == by(f"{tmp_path}/x.geojson") == by(str(tmp_path)) and by(f"{tmp_path}/none.geojson") == 0
    df = spark.read.format("geojson").load(str(tmp_path))
    rings = geo_etl.geojson_rings(df).select("kind", F.size("ring").alias("n")).collect()
    assert sorted((r["kind"], r["n"]) for r in rings) == [("MultiLineString", 2), ("MultiLineString", 2), ("Polygon", 3)]


LINE = "k string, line array<struct<lon:double,lat:double>>"


def pts(*xy):
    return [{"lon": float(x), "lat": float(y)} for x, y in xy]


def test_simplify_clip_delta(spark):
    df = spark.createDataFrame([("a", pts((0, 0), (1, 0.01), (2, 0), (3, 1), (4, 0)))], LINE)
    assert [(p["lon"], p["lat"]) for p in df.select(geo_etl.simplify("line", 0.05).alias("s")).first()["s"]] == [(0, 0), (2, 0), (3, 1), (4, 0)]
    d = df.select("line", geo_etl.delta_encode("line").alias("d")).select("line", "d", geo_etl.delta_decode("d").alias("back")).first()
    assert d["d"][:4] == [0, 0, 10000, 100] and d["back"] == d["line"]
    c = geo_etl.clip_line(spark.createDataFrame([("a", pts((0, 0), (5, 0), (6, 0), (7, 0), (20, 0), (6, 0), (30, 0), (31, 0)))], LINE), "k", "line", 4.5, -1, 6.5, 1)
    assert sorted(len(r["line"]) for r in c.collect()) == [7] or sorted(len(r["line"]) for r in c.collect()) == [3, 4]


def test_outline_of_two_squares(spark):
    r = spark.createDataFrame([("a", pts((0, 0), (1, 0), (1, 1), (0, 1))), ("b", pts((1, 0), (2, 0), (2, 1), (1, 1)))], "k string, ring array<struct<lon:double,lat:double>>")
    edges = geo_etl.boundary_edges(r, "k").withColumn("g", F.lit("all"))
    assert edges.count() == 6
    ring = geo_etl.chain_rings(edges, "g").collect()
    assert len(ring) == 1 and len(ring[0]["ring"]) == 6


def test_raster(spark):
    px = spark.createDataFrame([(x, y, 10 * x + y) for x in range(4) for y in range(4)], "x int, y int, value int")
    got = {(r["row"], r["col"]): r["value"] for r in geo_etl.resample(px, 2, 2).collect()}
    assert got == {(0, 0): 11, (0, 1): 31, (1, 0): 13, (1, 1): 33}
    h, lo = geo_etl.quantise(F.lit(99999.0))
    assert tuple(spark.range(1).select(h, lo).first()) == (255, 255)


SITE = "id string, name string, sector string, subindustry string, note string, existence string, employees int, sqft int, mw double, fuel string, gen_mwh double, cogen boolean, labels array<string>"


def assess(spark, **kw):
    base = dict(id="x", name="Acme", sector="chemical", subindustry="acids", note="", existence="registry", employees=0, sqft=0, mw=0.0, fuel="", gen_mwh=None, cogen=False, labels=[])
    return score.assess(spark.createDataFrame([tuple((base | kw).values())], SITE)).first()


def test_score_rules(spark):
    plain = assess(spark)
    assert plain["scale"] == 1.5 and not plain["scale_verified"] and plain["score"] == 65.0 and plain["band"] == "Medium"  # industry alone never reaches High
    assert assess(spark, employees=300, labels=["Toxics filing"])["band"] == "High"
    peaker = assess(spark, sector="power-generation", name="Acme Peaking", mw=500.0, gen_mwh=1e6, labels=["Toxics filing", "Emission report"], cogen=False)
    assert peaker["subtype"] == "peaker" and peaker["band"] == "Medium"
    assert assess(spark, name="Several plants in town")["band"] == score.UNRATED
    assert assess(spark, sector="logistics")["intensity"] == 0.5
    assert assess(spark, existence="recall")["confidence"] == "low"
    assert assess(spark, mw=5.0, gen_mwh=0.0)["timing"] == "idle"
    nulls = assess(spark, name=None, sector=None, subindustry=None, note=None, existence=None, employees=None, sqft=None, mw=None, fuel=None, cogen=None, labels=None)
    assert nulls["family"] == "other-mfg" and nulls["band"] == score.UNRATED


def test_evidence_of_generation_and_permits(spark):
    with_ = lambda **kw: score.assess(spark.createDataFrame([("x", "Acme", "chemical", "acids", "", "registry", 0, 0, 0.0, "", None, False, [], kw.get("onsite"), kw.get("fuel"), kw.get("permit"))], SITE + ", onsite_mw double, onsite_fuel string, permit_class string")).first()
    assert with_()["verified"] == 0.0 and with_(onsite=12.0, fuel="gas")["verified"] == 1.0 and with_(onsite=12.0)["fact_list"][0]["fact"] == "12 MW of unknown fuel generated on site"
    assert with_(permit="Title  V")["verified"] == 0.75 and with_(permit="Synthetic Minor")["verified"] == 0.25 and with_(permit="")["verified"] == 0.0


def test_cached_base_follows_the_file(spark, tmp_path):
    from fieldledger.sources.stores import CachedBase

    at = str(tmp_path / "base")
    spark.range(3).write.parquet(at)
    held = CachedBase(spark, at)
    assert held.get().count() == 3 and held.get() is held.get()
    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(at)
    assert held.get().count() == 5


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from fieldledger.session import shared_folder

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))


@pytest.mark.parametrize("wait", [30.0, 0.0])
def test_counts_come_with_the_cut_or_after_it(spark, monkeypatch, wait):
    from fieldledger import session

    monkeypatch.setattr(session, "WAIT", wait)
    for n in (0, 7):
        out, seen = session.cut_counted(spark.range(n), n=F.count(F.lit(1)), most=F.max("id"))
        assert seen == {"n": n, "most": n - 1 if n else None} and out.count() == n


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    return {f.rsplit("/", 1)[-1] for f in files if "shuffle_" in f}


def test_what_is_cut_or_packed_leaves_no_shuffle_files(spark):
    from fieldledger.session import cut, free, pack

    before = shuffle_files(spark)
    made = spark.range(5000).groupBy((F.col("id") % 977).alias("k")).agg(F.max("id").alias("m"))
    rows = {tuple(r) for r in made.collect()}
    before |= shuffle_files(spark)  # an ordinary action leaves its own
    twice = [cut(made), pack(made.filter("k >= 0"))]
    deadline = time.time() + 20
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert all({tuple(r) for r in x.collect()} == rows for x in twice)
    free(*twice)
    assert not os.path.exists(twice[1].packed_at.removeprefix("file:"))


def test_freed_frames_leave_the_folder(spark):
    from pathlib import Path

    from fieldledger.session import cut, free

    a = cut(spark.range(10))
    at = Path(a._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert at.exists() and a.count() == 10
    free(a, None, spark.range(3))
    assert not at.exists()


def test_admission(spark):
    known = spark.createDataFrame([("E1", "active", "High"), ("E2", "defunct", "Low")], "id string, status string, band string")
    log = spark.createDataFrame([("t1", "met", None), ("t2", "met", None), ("u2", "undo", "t2")], "id string, action string, undo_of string")
    f = "id string, ts string, actor string, action string, entity_id string, undo_of string, role string, band string"
    rows = [("a", "", "", "met", "E1", None, "buyer", None), ("b", "", "", "met", "E2", None, None, None), ("c", "", "", "won", "zz", None, None, None), ("d", "", "", "dance", "E1", None, None, None), ("e", "", "", "undo", None, "t1", None, None), ("f", "", "", "undo", None, "t2", None, None), ("g", "", "", "undo", None, "zz", None, None), ("h", "", "", "won", "E1", None, "buyer", None), ("t1", "", "", "won", "E1", None, None, None)]
    ok, bad = activity.admit(spark.createDataFrame(rows, f), known, log)
    assert {(r["id"], r["band"]) for r in ok.collect()} == {("a", "High"), ("e", None)}
    assert {r["id"]: r["code"] for r in bad.collect()} == {"b": 409, "c": 400, "d": 400, "f": 409, "g": 400, "h": 400, "t1": 409}


def test_admission_within_a_batch(spark):
    """Taps count for later undos of the batch, one undo a tap, the entity's own band, the tap's entity, triage of known signals."""
    known = spark.createDataFrame([("E1", "active", "Low"), ("E2", "active", None)], "id string, status string, band string")
    log = spark.createDataFrame([("t1", "met", "E2", None), ("s1", "signal_pinned", None, None)], "id string, action string, entity_id string, undo_of string")
    signs = spark.createDataFrame([("sig-1",)], "signal_id string")
    f = "id string, ts string, actor string, action string, entity_id string, undo_of string, role string, band string, signal_id string"
    row = lambda i, ts, action, **k: (i, ts, "desk", action, k.get("e"), k.get("u"), None, k.get("b"), k.get("s"))
    rows = [
        row("a", "1", "won", e="E1", b="High"), row("b", "2", "undo", u="a", e="E2"), row("c", "3", "undo", u="a"), row("d", "0", "undo", u="a"), row("e", "4", "undo", u="t1", e="E1"), row("f", "5", "undo", u="t1"),
        row("g", "1", "signal_reviewed", s="sig-1"), row("h", "1", "signal_reviewed", s="zz"), row("i", "1", "signal_pinned"), row("j", "9", "undo", u="s1"), row("k", "9", "undo", u="b"), row("l", "1", None, e="E1"),
    ]
    ok, bad = activity.admit(spark.createDataFrame(rows, f), known, log, signs)
    assert {(r["id"], r["entity_id"], r["band"], r["signal_id"]) for r in ok.collect()} == {("a", "E1", "Low", None), ("b", "E1", None, None), ("e", "E2", None, None), ("g", None, None, "sig-1")}
    assert {r["id"]: r["code"] for r in bad.collect()} == {"c": 409, "d": 400, "f": 409, "h": 400, "i": 400, "j": 400, "k": 400, "l": 400}


def test_admitted_changes_refuse_loops(spark):
    s = "entity_id string, field string, instant long, ord long, change_id string, change string, value string, reason string, duplicate_of string"
    old = spark.createDataFrame([("A2", "status", 1, 1, "c1", "mark_duplicate", None, "r", "A1")], s)
    new = spark.createDataFrame([("A1", "status", 2, 2, "c2", "mark_duplicate", None, "r", "A2"), ("A3", "status", 2, 3, "c3", "mark_defunct", None, "r", None), ("A3", "record", 2, 4, "c4", "add_entity", None, "r", None)], s)
    ok, bad = activity.admit_changes(new, old, spark.createDataFrame([("A1",), ("A2",), ("A3",)], "id string"))
    assert [r["change_id"] for r in ok.collect()] == ["c3"] and sorted(r["change_id"] for r in bad.collect()) == ["c2", "c4"]


def test_streams(spark, tmp_path):
    rows = [("a", "surveyed", "E", "2026-01-01T00:00:00Z"), ("b", "won", "E", "2026-01-02T00:00:00Z"), ("b", "won", "E", "2026-01-02T00:00:00Z"), ("c", "met", "E", "2026-01-03T00:00:00Z"), (None, "met", "E", None)]
    df = spark.createDataFrame(rows, "id string, action string, entity_id string, ts string").withColumn("arrived_at", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "log.parquet"))
    assert {r["action"]: r["n"] for r in activity.count_actions(spark, str(tmp_path / "log.parquet")).collect()} == {"surveyed": 1, "won": 1, "met": 1}
    seen = []
    once = activity.once(activity.read_log(spark, str(tmp_path / "log.parquet")))
    activity.run_available(once, "append", lambda b, e: seen.extend(r["id"] for r in b.collect()))
    assert sorted(seen) == ["a", "b", "c"]


def test_live_stages(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [("a", "surveyed", "E", "2026-01-01T00:00:00Z"), ("b", "won", "E", "2026-01-02T00:00:00Z"), ("c", "met", "E", "2026-01-03T00:00:00Z"), ("d", "met", "F", "2026-01-03T00:00:00Z"), ("e", "met", None, None)]
        spark.createDataFrame(rows, "id string, action string, entity_id string, ts string").write.parquet(str(tmp_path / "log.parquet"))
        seen = []
        activity.run_available(activity.live_stages(activity.read_log(spark, str(tmp_path / "log.parquet"))), "append", lambda b, e: seen.extend(map(tuple, b.collect())))
        assert sorted(seen) == [("E", "a", 0, 1, 1, 1), ("E", "b", 1, 4, 16, 17), ("F", "d", 0, 2, 4, 4)]
        known = spark.createDataFrame([("E", "facility", "High"), ("F", "oem", None), ("F", "oem", None)], "id string, kind string, base_band string")
        log = activity.read_log(spark, str(tmp_path / "log.parquet")).withColumn("band", F.when(F.col("id") == "b", "Low"))
        seen.clear()
        activity.run_available(activity.live_stages(log, known), "append", lambda b, e: seen.extend(map(tuple, b.collect())))
        assert sorted(seen) == [("E", "a", 0, 1, 3, 3), ("E", "b", 1, 4, 16, 19), ("F", "d", 0, 2, 12, 12)]
    finally:
        spark.conf.set(key, old)


def test_late_rows_are_kept_for_the_replay(spark, tmp_path):
    s = "id string, action string, arrived_at timestamp"
    at = lambda d: datetime.datetime(2026, 1, d)
    spark.createDataFrame([("a", "met", at(9))], s).write.parquet(str(tmp_path / "log"))
    spark.createDataFrame([("b", "met", at(8)), ("c", "met", at(6)), ("c", "met", at(6)), ("a", "met", at(1)), ("d", None, None)], s).write.parquet(str(tmp_path / "in"))
    for run in ("1", "2"):  # the second reads the same rows again
        q = activity.keep_late(activity.read_log(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "late"), str(tmp_path / f"cp{run}"))
        q.trigger(availableNow=True).start().awaitTermination()
    ids = lambda f: sorted(r["id"] for r in spark.read.schema(s).parquet(str(tmp_path / f)).collect())
    assert ids("log") == ["a", "b", "c", "d"] and ids("late") == ["c"]


def test_admission_stream_appends_what_is_allowed(spark, tmp_path):
    f = "id string, ts string, actor string, action string, entity_id string, undo_of string, role string, band string"
    spark.createDataFrame([("t0", "", "", "met", "E1", None, None, None)], f).write.parquet(str(tmp_path / "log"))
    rows = [("a", "", "", "won", "E1", None, None, None), ("b", "", "", "won", "zz", None, None, None), ("t0", "", "", "won", "E1", None, None, None)]
    spark.createDataFrame(rows, f).write.parquet(str(tmp_path / "in"))
    known = lambda: spark.createDataFrame([("E1", "active", "High")], "id string, status string, band string")
    q = activity.admission_stream(activity.read_log(spark, str(tmp_path / "in")), known, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["id"], r["band"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("a", "High"), ("t0", None)]
    assert sorted((r["id"], r["code"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [("b", 400), ("t0", 409)]


def test_entry_works_without_the_llm_folder():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert len(q) > 60 and set(sql) <= set(q)
