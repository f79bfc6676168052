"""The corpus queries on the smallest tables, on empty ones, and on rows with nulls and clashing columns."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).parent.parent.parent
sys.path.insert(0, str(ROOT))
import verify  # noqa: E402
from fieldledger.llm.queries import catalog  # noqa: E402

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in SMALL.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.sql))
def test_query_equals_its_sql(spark, con, name):
    said = verify.compare(spark, con, name, catalog.queries[name], catalog.sql[name], str(SMALL))
    assert "DIFFER" not in said, said


def rebuilt(spark, folder, change):
    for p in SMALL.glob("*.parquet"):
        change(p.stem, spark.read.parquet(str(p))).write.parquet(str(folder / p.name))
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return rebuilt(spark, tmp_path_factory.mktemp("empty"), lambda name, t: t.limit(0))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    def spoil(name, t):
        if name not in ("entity", "site_record", "ledger_change", "documents", "review_group"):
            return t
        u = t.unionByName(t.limit(30))
        for c in t.columns:
            u = u.unionByName(t.limit(2).withColumn(c, F.lit(None).cast(t.schema[c].dataType)))
        if name == "entity":
            u = u.unionByName(t.limit(1).withColumns({"id": F.lit("zz-long"), "name": F.expr("repeat('Long Name ', 2000)"), "operator": F.expr("repeat('X', 9000)"), "city": F.expr("repeat('qz', 4000)")}))
        if name == "documents":
            u = u.unionByName(t.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.expr("repeat('It was the pump. ', 50000)")}))
        for c in ("n", "key", "row", "form", "group_id", "marks", "to", "tokens", "content", "source_", "size"):
            if c not in u.columns:
                u = u.withColumn(c, F.lit("clash"))
        return u

    return rebuilt(spark, tmp_path_factory.mktemp("odd"), spoil)


FOUND = ["p2_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_containers", "p9_mix", "p10_found"]


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables(spark, empty, name):
    assert catalog.queries[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_odd_tables(spark, odd, name):
    df = catalog.queries[name](spark, odd)
    assert df.count() > 0
    if name.endswith("found"):
        assert df.count() == df.distinct().count()
        assert df.dropna().count() == df.count()
