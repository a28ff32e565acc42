"""What keeps queries within bounds as tables grow, with the same results."""

import math

import numpy as np
import pytest

from spanloom import session
from spanloom.functions import statistics as S
from spanloom.operators import clusters as C
from spanloom.operators import events as E
from spanloom.plans import proxy_queries


def test_permutation_test_has_many_even_tasks(spark):
    rows = spark.range(4000).selectExpr("id % 40 AS g", "id * 7 % 31 AS x", "id * 11 % 17 AS y")
    tested = S.spearman_test(rows, "g")
    assert tested.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert tested.count() == 40


def test_ranks_of_one_side_give_the_others():
    """Against ranks that each side takes by itself, with the same draws."""

    def ranks(v):
        return np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])

    def rho(a, b):
        n, a, b = len(a), ranks(a), ranks(b)
        bottom = (n * (a @ a) - a.sum() ** 2) * (n * (b @ b) - b.sum() ** 2)
        return (n * (a @ b) - a.sum() * b.sum()) / math.sqrt(bottom) if bottom > 0 else math.nan

    draw = np.random.default_rng(3)
    for n in (1, 2, 5, 30):
        x, y = draw.integers(0, n, n).astype(float), draw.integers(0, 3 * n, n).astype(float)
        pool, shuffles, hits = np.concatenate([x, y]), np.random.default_rng([S.SEED, n]), 0
        observed = rho(x, y)
        for _ in range(S.PERMUTATIONS):
            shuffles.shuffle(pool)
            hits += not abs(rho(pool[:n], pool[n:])) < abs(observed)
        got = S.rho_and_p(x, y, [S.SEED, n])
        assert got[1] == hits / S.PERMUTATIONS
        assert got[0] == observed or math.isnan(got[0]) and math.isnan(observed)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """300 orders of up to three reads over three strips, with exons and blacklisted regions."""
    folder = tmp_path_factory.mktemp("tables")
    kind = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    rows = [(k // 3, k % 3, k * 7 % 600, k % 3, float(10 + k * 11 % 40), 1.0, 0.0, 0.0, "N", "F" if k % 2 else "O", "1995-01-01") for k in range(900)]
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, 1 + k % 20) for k in range(600)], "p_partkey long, p_size long").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k, f"s{k}") for k in range(9)], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def tables_read(frame):
    """How often a plan scans the table of reads."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return sum("l_orderkey" in line and "Relation [" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["event_rows", "clip_mode_insertion_point"])
def test_reads_are_derived_once(spark, tables, name):
    found = proxy_queries.queries()[name](spark, tables)
    assert tables_read(found) == 0 and found.count() > 0


@pytest.mark.parametrize("name", ["event_rows", "clip_mode_insertion_point", "vcf_info_string", "vcf_body_pivot", "source_cross_retrocopy", "orientation_pairs"])
def test_strips_are_numbered_once(spark, tables, name):
    found = proxy_queries.queries()[name](spark, tables)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(chr" not in plan and found.count() > 0


@pytest.mark.parametrize("name", ["interval_dbscan", "recluster_supported", "dbscan_core_points"])
def test_fragments_are_judged_once(spark, tables, name, monkeypatch):
    calls = []
    judged = proxy_queries.P.fragment_filter
    monkeypatch.setattr(proxy_queries.P, "fragment_filter", lambda rows: calls.append(1) or judged(rows))
    proxy_queries.queries()[name](spark, tables).count()
    assert len(calls) == 1


def test_points_are_derived_once(spark):
    points = spark.range(100).selectExpr("id", "concat('c', id % 2) AS chr", "id * 3 AS low", "id * 3 + 5 AS high")
    found = C.core_points(points, ["chr"], 10, 3)
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 100


def test_orientation_takes_reads_once(spark):
    merging = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "retrocopy_id long, cluster_id long, cluster_sid long")
    clustering = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (2, 1, 12)], "cluster_id long, cluster_sid long, alignment_id long")
    # 11 lies in an exon itself: 10 brings it along for both. 12 is alone with itself, and 13 is its mate.
    reads = spark.createDataFrame([(10, "a", 1, 100, 1), (11, "a", 1, 200, 8), (12, "b", 1, 300, 8), (13, "b", 1, 400, 8)], "id long, qname string, source_id long, pos long, type int")
    found = E.orientation_pairs(merging, clustering, reads)
    assert sorted(map(tuple, found.collect())) == [(1, 100, 200), (1, 200, 200), (1, 300, 400)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3


def test_depths_deal_out_by_read_once(spark):
    events = spark.createDataFrame([(1, 5)], "id long, insertion_point long")
    merging = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "retrocopy_id long, cluster_id long, cluster_sid long")
    clustering = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 1, 11)], "cluster_id long, cluster_sid long, alignment_id long")
    reads = spark.createDataFrame([(10, 2048, "5S5M", 5, 5), (11, 0, "5S5M", 5, 5)], "id long, flag int, cigar string, pos long, rlen long")
    found = E.depths(events, merging, clustering, reads)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1)]
    assert "RepartitionByExpression [alignment_id" in found._jdf.queryExecution().optimizedPlan().toString()


def test_islands_are_cut_into_bins(spark):
    draw = np.random.default_rng(5)
    for n in (1, 3, 60, 300):
        lows = draw.integers(0, 6 * n, n).tolist()
        rows = [(k, draw.choice(["a", "b"]).item() if k % 9 else None, low if k % 13 else None, low + int(draw.integers(0, 40 if k % 5 else 4))) for k, low in enumerate(lows)]
        frame = spark.createDataFrame(rows, "id long, chr string, low long, high long")
        want, last = {}, {}
        for k, c, low, high in sorted(rows, key=lambda r: (r[1] or "", -1 if r[2] is None else r[2], r[3], r[0])):
            reach, many = last.get(c, (None, 0))
            many += reach is None or low is not None and low > reach
            want[k], last[c] = many, (high if reach is None else max(reach, high), many)
        for width in (3, 16, 1000):
            assert {r["id"]: r["island"] for r in E.islands(frame, ["chr"], "low", "high", ["id"], width).collect()} == want


def test_binary_files_are_many_even_tasks(spark, tables):
    found = proxy_queries.queries()["bam_parse"](spark, tables)
    assert found.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert found.count() == 900


def test_tasks_grow_with_the_table(spark, tables, monkeypatch):
    reads = spark.read.parquet(f"{tables}/lineitem.parquet")
    monkeypatch.setattr(session, "TASK_BYTES", 500)
    assert session.spread(reads, reads, "l_orderkey").rdd.getNumPartitions() > 4
    plan = proxy_queries.queries()["spearman_rho"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    # Two by read and one by cluster, which the distinct pairs and the ranks share.
    assert plan.count("RepartitionByExpression") == 3
