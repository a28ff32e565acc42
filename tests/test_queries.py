"""Registered queries against their SQL on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.plans import proxy_queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(proxy_queries.queries()) <= set(entry.queries())


@needs_tables
def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return db


def same(value):
    return None if value is None or value != value else round(value, 9) if isinstance(value, float) else value


@needs_tables
@pytest.mark.parametrize("name", sorted(proxy_queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = proxy_queries.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = sorted(str([same(v) for v in row]) for row in found.select(*(f"`{c}`" for c in columns)).collect())
    table = duck.execute(proxy_queries.oracle_sql()[name])
    names = [d[0] for d in table.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(str([same(row[k]) for k in order]) for row in table.fetchall())


@needs_tables
@pytest.mark.parametrize("name", ["flagship_overlaps", "overlap_join", "blacklist_overlap", "blacklist_anti_padded", "point_in_interval", "near_gene_symmetric", "crossing_reads", "dbscan_core_points"])
def test_interval_plans_have_no_nested_loop(spark, name):
    plan = proxy_queries.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@needs_tables
def test_scans_read_only_what_they_need(spark):
    plan = proxy_queries.queries()["gene_extent"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan and "p_retailprice" not in plan
