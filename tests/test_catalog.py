import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import database, rows_of, sql_rows

from netloom.plans import catalog, files, steps  # noqa: F401

BEYOND = sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    cols, got = rows_of(catalog.QUERIES[name](spark, sf))
    want_cols, want = sql_rows(database(sf), catalog.ORACLE_SQL[name])
    assert cols == want_cols
    assert got == want
    assert got or name in ("top_by_size", "connect_pairs", "bfs_hop1", "bfs_hop2", "bfs_top", "duplicate_genes", "read_gmt", "align_flags")


@pytest.mark.parametrize("name", BEYOND)
def test_runs_and_is_finite(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    for c, kind in df.dtypes:
        if kind == "double":
            assert all(r[c] is None or r[c] == r[c] for r in rows)


@pytest.mark.parametrize("name, column", [("monster_ols", "tf_from"), ("perturbed_networks", "tf")])
def test_every_tf_reaches_the_operator(spark, name, column):
    sf = "/root/testdata/sf0.01"
    want = {r.tf for r in catalog._net(spark, sf).select("tf").distinct().collect()}
    assert len(want) > 20
    assert {r[0] for r in catalog.QUERIES[name](spark, sf).select(column).distinct().collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["tf", "gene", "score", "cond"]
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
