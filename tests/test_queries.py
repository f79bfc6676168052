"""Every query with an SQL twin against DuckDB on the smallest tables; all queries run on empty ones."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402
import verify  # noqa: E402

SMALL = Path("/root/testdata/sf0.001")
CORE = {name: f for c in (entry.general, entry.registry, entry.logs) for name, f in c.catalog.queries.items()}
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in SMALL.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_its_sql(spark, con, name):
    said = verify.compare(spark, con, name, CORE[name], entry.oracle_sql().get(name), str(SMALL))
    assert "DIFFER" not in said, said


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for p in SMALL.glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(d / p.name))
    return str(d)


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p3_state", "q01_jurisdiction_lookup", "q06_knn_anchor", "q09_colocated_groups", "q11_near_duplicates", "q12_greedy_dedupe", "q30_dup_chain_resolve", "q37_cluster_share_timeline", "q42_transferred_stages"])
def test_empty_tables(spark, empty, name):
    assert CORE[name](spark, empty).count() == 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
