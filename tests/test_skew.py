import random

import pytest

from fieldledger.functions import skew


def test_numbering_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), i) for i in range(400)] + [(None, 1000), (None, 1001)]
    rng.shuffle(rows)
    for keys in (["k"], []):
        got = {r["i"]: r["n"] for r in skew.numbered(spark.createDataFrame(rows, "k string, i int"), keys, ["i"], "n").collect()}
        seen, want = {}, {}
        for k, i in sorted(rows, key=lambda r: r[1]):
            g = k if keys else 0
            seen[g] = seen.get(g, 0) + 1
            want[i] = seen[g]
        assert got == want


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_split_join_equals_a_join(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    rng = random.Random(2)
    big = [(rng.choice(["h"] * 6 + list("abcdefg")), i) for i in range(200)] + [(None, 900), ("lost", 901)]
    sizes = {}
    for k, _ in big:
        sizes[k] = sizes.get(k, 0) + 1
    table = [(k, n, f"v{k}") for k, n in sizes.items() if k not in (None, "lost")] + [("unused", 0, "u")]
    got = skew.split_join(spark.createDataFrame(big, "k string, i int"), spark.createDataFrame(table, "k string, n long, v string"), ["k"], "n", hot_rows)
    assert sorted((r["i"], r["v"]) for r in got.collect()) == sorted((i, f"v{k}") for k, i in big if k not in (None, "lost"))


def test_block_join_is_the_same_however_blocks_are_cut(spark):
    rng = random.Random(4)
    a = [(i, [rng.choice([0, 0, 0, rng.randrange(9)]), rng.randrange(9)]) for i in range(60)] + [(98, None), (99, [])]
    b = [(i, [rng.choice([0, 0, rng.randrange(9)])]) for i in range(50)] + [(98, None)]
    left, right = spark.createDataFrame(a, "l long, keys array<long>"), spark.createDataFrame(b, "r long, keys array<long>")
    want = sorted((x, y) for x, xs in a for y, ys in b for k in xs or [] for m in ys or [] if k == m)
    for rows, share in ((10**6, 1.0), (5, 1.0), (3, 0.5)):
        assert sorted(map(tuple, skew.block_join(left, right, "l", "r", block_rows=rows, share=share).collect())) == want
