"""Every registered query with a DuckDB form gives the same rows, over whole tables."""

import pytest
from check_oracle import compare, connect

from pairloom.plans.catalog import CATALOG

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [name for name, q in CATALOG.items() if q.sql]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_duckdb(spark, duck, name):
    q = CATALOG[name]
    assert compare(q.run(spark, SF_DIR), duck, q.sql) == ""


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_same_rows_under_one_and_many_partitions(spark):
    from check_oracle import rows_of

    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = CATALOG["sig02_paired_bootstrap"].run(spark, SF_DIR)
        caps = CATALOG["flt07_class_caps"].run(spark, SF_DIR)
        results.append([rows_of(d.columns, [tuple(r) for r in d.collect()]) for d in (df, caps)])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
