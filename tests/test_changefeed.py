import random

import pytest

from fieldledger.operators.changefeed import apply_feed, first_deliveries, resolve_newest_first


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_last_change_wins_whatever_the_batches(spark, batches):
    rng = random.Random(3)
    rows = [(rng.choice("abcd") if rng.random() > 0.3 else "hot", rng.randrange(20), i, f"v{i}") for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, ord long, v string")
    got = {r["k"]: r["v"] for r in resolve_newest_first(df, ["k"], ["at", "ord"], batches).collect()}
    want = {}
    for k, at, o, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k] = v
    assert got == want


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None, 1, "x"), (None, 5, 2, "y")], "k string, at long, ord long, v string")
    assert resolve_newest_first(df, ["k"], ["at", "ord"]).count() == 0
    assert resolve_newest_first(df.limit(0), ["k"], ["at", "ord"]).count() == 0


def test_first_delivery_is_kept(spark):
    df = spark.createDataFrame([("x", 2, "late"), ("x", 1, "first"), (None, 3, "n"), ("y", None, "n")], "id string, ord long, v string")
    assert [(r["id"], r["v"]) for r in first_deliveries(df, "id", "ord").collect()] == [("x", "first")]


def test_feed_against_replay(spark):
    rng = random.Random(4)
    base = [(f"k{i}", i) for i in range(20)]
    feed = [(f"k{rng.randrange(30)}", rng.choice(["insert", "update", "delete"]), rng.randrange(9), i, 1000 + i) for i in range(120)]
    b = spark.createDataFrame([*base, base[0]], "id string, v long")
    f = spark.createDataFrame([(k, v, op, at, o) for k, op, at, o, v in feed], "id string, v long, op string, at long, ord long")
    got = {r["id"]: r["v"] for r in apply_feed(b, f, "id", ["at", "ord"], "op").collect()}
    want = dict(base)
    for k, op, at, o, v in sorted(feed, key=lambda r: (r[2], r[3])):
        if op == "delete":
            want.pop(k, None)
        else:
            want[k] = v
    assert got == want
