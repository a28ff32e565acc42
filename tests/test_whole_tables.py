"""Queries take all reads and whole texts."""

import duckdb
import numpy as np
import pytest

from spanloom.functions import statistics as S
from spanloom.plans import proxies as X
from spanloom.plans import proxy_queries

LINEITEM = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"


@pytest.fixture(scope="module")
def reads(spark, tmp_path_factory):
    """60 reads of all qualities from 1 to 50 in three strips of 20,000 positions."""
    folder = tmp_path_factory.mktemp("reads")
    rows = [(k // 3, k % 3, k * 7 % 600, 5, float(1 + k * 11 % 50), 1.0, 0.0, 0.0, "R" if k % 5 else "N", "F" if k % 2 else "O", "1995-01-01") for k in range(60)]
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_permutation_test_takes_all_reads(spark, reads):
    groups = {}
    for r in X.alignments(spark, reads).collect():
        groups.setdefault(r["pos"] // 20000, []).append((r["pos"], r["pos_next"]))
    want = {}
    for g, pairs in groups.items():
        x, y = np.array(sorted(pairs), float).T
        want[g] = S.permutation_p(x, y, [S.SEED, g])
    assert len(want) == 3
    assert {r["g"]: r["p_value"] for r in proxy_queries.queries()["spearman_permutation_p"](spark, reads).collect()} == want


@pytest.mark.parametrize("name", ["window_islands", "sam_parse"])
def test_no_read_is_left_out(spark, reads, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{reads}/lineitem.parquet/*.parquet'")
    db.execute("CREATE VIEW part AS SELECT 0 AS p_partkey, 1 AS p_size")
    db.execute("CREATE VIEW supplier AS SELECT 0 AS s_suppkey, 's' AS s_name")
    assert proxy_queries.queries()[name](spark, reads).count() == 60
    table = db.execute(proxy_queries.oracle_sql()[name])
    assert len(table.fetchall()) == 60


def test_crossing_reads_are_the_reference_side(spark, tmp_path):
    rows = [(o, n, p, 5, 30.0, 1.0, 0.0, 0.0, "N", "O", "1995-01-01") for o, n, p in [(0, 0, 0), (1, 10, 4), (1, 11, 4), (2, 0, 3)]]
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 1)], "p_partkey long, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    # The insertion point is 501; two reads of the second source, at 471 and 478, cross it.
    got = proxy_queries.queries()["source_cross_retrocopy"](spark, str(tmp_path)).collect()
    assert sorted((r["source_id"], r["reference_depth"], r["alternate_depth"]) for r in got) == [(1, 0, 1), (2, 2, 2), (3, 0, 1)]
    line = proxy_queries.queries()["vcf_body_pivot"](spark, str(tmp_path)).first()["line"]
    assert [x.split(":")[1] for x in line.split("\t")[9:]] == ["0,1", "2,2", "0,1"]
    assert all(len(x.split(":")[2].split(",")) == 3 for x in line.split("\t")[9:])


def test_sets_are_of_whole_texts_and_null_rows_stay(spark, tmp_path):
    rows = [(1, 0, "user", "x" * 60 + "S" + "y" * 60 + "suser"), (2, 0, "user", None), (3, 0, None, "asb"), (4, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["u"], r["i"], r["m"], r["subset"]) for r in proxy_queries.queries()["set_algebra"](spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in (2, 3, 4)} == {
        2: (["er", "u"], [], ["er", "u"], False),
        3: (["a", "b"], [], [], True),
        4: ([], [], [], True),
    }
    assert got[1] == (["er", "u", "x" * 60, "y" * 60], ["er", "u"], [], True)
