from pathlib import Path

import numpy as np
import pytest

from fieldledger.llm import quality
from fieldledger.llm.names import edits, parse_owner, parse_site
from fieldledger.llm.tokens import token_count
from pyspark.sql import functions as F

COMMON = [("en", w) for w in "the of and to in a is that for it as was with be by on not at from but have they we so after before because who has its could".split()]

TEXTS = {
    "prose": [
        "The boiler in the hall was replaced because the old one leaked, and nobody has been back since.",
        "we asked the foreman about steam and he pointed to the yard\nthey plan to change the pump because it leaks",
        "He thought the tank could hold more, yet the\nplate says that it is the old one and that\nit was not to be used.",
        "It was not clear who owns the site. We asked at the gate, and they have no answer for us.\n- blend tank\n- dryer",
        "Nobody answered.",
    ],
    "list": ["- blend tank\n- dryer\n- pump, east bay", "1) mass meter\n2) 3 x valve\n3) older boiler", "To check:\n[ ] chiller\n[ ] mixer", "site: kiln hood\nowner = Brask Metals\nmedium: syrup", "blend tank; dryer; 4 x pump; old kiln; truck rack", "meter one ..... 3\nmeter two ..... 5\nmeter three ..... 9"],
    "table": ["a\tb\tc\n1\t2\t3\n4\t5\t6", "| x | y |\n| --- | --- |\n| 1 | 2 |", "site;flow;unit\nBrask;12;gpm\nVolt;9;psi", 'name,qty\n"mass meter",3,4\n"rotameter",5,6', "flow   unit   note\n12.5   gpm   ok\n13.1   psi   idle"],
    "junk": ["", None, "asdf", "n/a", "steam steam steam steam steam steam steam", "00000000  fe eb c3 31 7d 1d\n00000010  c8 4a a5 77 f9 4f", "tjUj2clQjdtavYaPtdgtsuVndYigJHZI4M8peY9oiiMw2QW37eKGHH8WMqikqVBx", "^#]--;@-?<|}!;%|[]@[\\?+&\\;@&];@/!*-_%", "<div class=\"nav\"><span id=\"1\"></span></div>", "Home | Products | Contact\nSign in\nCookie settings\nMenu", "2026-01-02 03:04:05 [WARN] 0x63f1 q=878;err=43985"],
}


WORDS = "lang string, word string"


@pytest.fixture(scope="module")
def typed(spark):
    rows, want = [], {}
    for kind, texts in TEXTS.items():
        for t in texts:
            want[len(rows)] = kind
            rows.append((len(rows), t))
    docs = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string")
    groups = quality.line_groups(docs, spark.createDataFrame(COMMON, WORDS)).cache()
    return want, rows, quality.text_statistics(groups), {r["doc_id"]: r for r in quality.text_types(groups).collect()}


def test_types(typed):
    want, rows, _, got = typed
    assert set(got) == set(want)
    wrong = [(rows[i][1], want[i], got[i]["kind"]) for i in want if got[i]["kind"] != want[i]]
    assert not wrong


def test_posteriors_are_probabilities(typed):
    for r in typed[3].values():
        assert abs(sum(r[f"p_{k}"] for k in quality.KINDS) - 1) < 1e-6
        assert r["confidence"] == r[f"p_{r['kind']}"] and (r["kind"] == "prose") == (r["p_prose"] > 0.5)


def test_statistics_of_blank_and_plain(typed):
    _, rows, stats, _ = typed
    s = {r["doc_id"]: r for r in stats.collect()}
    blank = [i for i, (_, t) in enumerate(rows) if not t]
    assert all(s[i]["words"] == 0 and s[i]["chars"] == 0 and s[i]["lines"] == 0 for i in blank)
    assert s[0]["words"] == 18 and s[0]["punctuated_lines"] == 1.0 and s[0]["common_share"] > 0.3


def test_empty_table_and_long_text(spark):
    words = spark.createDataFrame(COMMON, WORDS)
    none = quality.line_groups(spark.createDataFrame([], "doc_id long, text string"), words)
    assert quality.text_types(none).count() == 0
    long = "The pump was replaced because it leaked and they have another one in the yard.\n" * 20_000
    groups = quality.line_groups(spark.createDataFrame([(1, long), (2, "x" * 500_000)], "doc_id long, text string"), words)
    assert {r["doc_id"]: r["lines"] for r in quality.text_statistics(groups).collect()} == {1: 20_000, 2: 1}


def test_levels_round_trip():
    rng = np.random.default_rng(3)
    levels = np.stack([rng.integers(0, n, 500) for n in quality.SIZES.values()], 1)
    numbers = np.zeros(500, dtype=np.int64)
    for j, n in enumerate(quality.SIZES.values()):
        numbers = numbers * n + levels[:, j]
    assert (quality.levels_of(numbers) == levels).all() and numbers.max() < quality.MAX_PATTERNS


def drawn(rng, n, noisy):
    """Lines whose levels are drawn from the starting shapes; the function `noisy` is replaced by chance."""
    start = quality._start()
    shape = rng.integers(0, len(quality.SHAPES), n)
    levels = np.stack([np.array([rng.choice(size, p=start[f][c]) for c in shape]) if f != noisy else rng.integers(0, size, n) for f, size in quality.SIZES.items()], 1)
    number = np.zeros(n, dtype=np.int64)
    for j, size in enumerate(quality.SIZES.values()):
        number = number * size + levels[:, j]
    return np.array([quality.KINDS.index(quality.SHAPES[c][0]) for c in shape]), number


def test_em_finds_out_that_a_function_is_noise():
    kind, number = drawn(np.random.default_rng(1), 6000, "length")
    pats, inv, counts = np.unique(number, return_inverse=True, return_counts=True)
    first, learnt = quality.fit_types(pats, counts, rounds=1), quality.fit_types(pats, counts)
    right = (learnt[0].argmax(1)[inv.ravel()] == kind).mean()
    differ = lambda t: np.abs(t["length"] - t["length"].mean(0)).sum()  # noqa: E731  how far it tells types apart
    assert right > 0.85 and differ(learnt[1]) < 0.7 * differ({"length": quality._start()["length"][[0, 2, 6, 14]]})


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_the_posterior_overrules_every_function(spark):
    """No single function gives the result, nor do the starting values."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    groups = quality.line_groups(read("documents").select("doc_id", "text"), read("common_word"))
    lines = groups.filter("pattern >= 0").select("doc_id", "pattern", "chars", "lines").toPandas()
    pats, inv = np.unique(lines["pattern"].to_numpy(), return_inverse=True)
    counts = np.bincount(inv, weights=lines["lines"].to_numpy())
    post, learnt = quality.fit_types(pats, counts)
    levels = quality.levels_of(pats)

    def kinds(p):
        w = p[inv] * lines[["chars"]].to_numpy()
        by = lines[["doc_id"]].assign(**dict(zip(quality.KINDS, w.T))).groupby("doc_id").sum()
        return np.where(by["prose"] * 2 > by.sum(1), "prose", by[quality.KINDS[1:]].idxmax(axis=1))

    result = kinds(post)
    differ = {}
    for j, f in enumerate(quality.SIZES):
        alone = learnt["prior"] * learnt[f][:, levels[:, j]].T
        differ[f] = int((kinds(alone / alone.sum(1, keepdims=True)) != result).sum())
    # measured: the closest function, on the share of common words, differs on more than a twentieth of the texts
    assert min(differ.values()) > len(result) / 20, differ
    assert (kinds(quality.fit_types(pats, counts, rounds=1)[0]) != result).sum() > 0


def test_token_counts(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    n = [r[0] for r in df.select(token_count(F.col("t"))).collect()]
    assert n[0] == 2 and n[1] == 0 and n[2] == 0 and n[3] > 1


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Quist Instr Ltd", ("o", "quist", "instruments")), ("Textiles, Gweamoot Corp.", ("o", "gweamoot", "textiles")), ("She-azaish Coatings", ("o", "sheazaish", "coatings")), ("LeacrulpSystemsSupply Corpn", ("o", "leacrulp", "systems supply")),
        ("KNEANISOR, SUSAN D.", ("p", "kneanisor", "susan")), ("S.D. Kneanisor", ("p", "kneanisor", "s")), ("Mr/Ms Sam Goucluc & Sons", ("p", "goucluc", "samuel")), ("Trinovorst L.P.", ("o", "trinovorst", "")), ("", ("o", "", "")),
    ],
)
def test_owner_forms(raw, want):
    assert parse_owner(raw)[:3] == want


def test_site_forms():
    towns = frozenset(["elmgrove"])
    assert parse_site("Quist Metals LLC - Mill Rd. Plt", towns)[0][1:] == ("quist", "metals", "qst", "rmill", "plant")
    assert parse_site("Tank Farm #7, Quist Metals", towns)[0][4:] == ("n7", "tank farm")
    assert [x[1] for x in parse_site("Vrolp Depot (ex Quist Metals Elmgrove Dpt)", towns)] == ["vrolp", "quist"]
    assert parse_site("", towns) == []


def test_edits_counts_swaps_once():
    assert edits("abcd", "abdc", 3) == 1 and edits("abcd", "abcd", 0) == 0 and edits("a", "abcdef", 2) == 3
