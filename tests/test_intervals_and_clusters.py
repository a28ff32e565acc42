"""Interval joins, density clusters, events, genotypes and variant text."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import statistics as S
from spanloom.operators import clusters as C
from spanloom.operators import events as E
from spanloom.operators import intervals as I
from spanloom.operators import vcf as V


def frame(spark, rows, prefix):
    return spark.createDataFrame([(k, "chr1", low, high) for k, (low, high) in enumerate(rows)], f"{prefix}_id int, {prefix}_c string, {prefix}_l long, {prefix}_h long")


@pytest.mark.parametrize(
    ("tree", "query", "f1", "f2", "either", "hits"),
    [
        ([(1, 10), (9, 12), (5, 10), (1, 5), (1, 1)], (6, 20), None, None, False, 3),
        ([(1, 10), (5, 15), (10, 20), (15, 25)], (1, 20), 0.5, 1.0, False, 3),
        ([(1, 10), (5, 15), (10, 20), (15, 25)], (1, 20), 0.5, 0.5, True, 4),
    ],
)
@pytest.mark.parametrize("width", [4, 1 << 14])
def test_overlap_fractions(spark, tree, query, f1, f2, either, hits, width):
    # f1 is asked of the query, f2 of the tree's interval.
    got = I.overlap_join(frame(spark, [query], "a"), frame(spark, tree, "b"), ("a_c", "a_l", "a_h"), ("b_c", "b_l", "b_h"), None if f1 is None else (f1 if either else 0.01), f2, either, width=width)
    assert got.count() == hits


def test_overlap_join_equals_brute_force(spark):
    draw = random.Random(3)
    a = [(x, x + draw.randint(0, 90)) for x in (draw.randint(1, 900) for _ in range(120))]
    b = [(x, x + draw.randint(0, 300)) for x in (draw.randint(1, 900) for _ in range(80))]
    got = I.overlap_join(frame(spark, a, "a"), frame(spark, b, "b"), ("a_c", "a_l", "a_h"), ("b_c", "b_l", "b_h"), width=32)
    want = {(i, j, max(l, x), min(h, y) - max(l, x) + 1) for i, (l, h) in enumerate(a) for j, (x, y) in enumerate(b) if l <= y and h >= x}
    rows = [(r["a_id"], r["b_id"], r["overlap_pos"], r["overlap_len"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    free = I.overlap_anti_join(frame(spark, a, "a"), frame(spark, b[:5], "b"), ("a_c", "a_l", "a_h"), ("b_c", "b_l", "b_h"), ["a_id"], padding=10, width=32)
    assert {r["a_id"] for r in free.collect()} == {i for i, (l, h) in enumerate(a) if not any(max(l - 10, 0) <= y and h + 10 >= x for x, y in b[:5])}


def test_exon_and_blacklist_counts(spark):
    reads = [(1, 50), (49, 100), (110, 190), (200, 400), (2000, 2100)]
    exons = [(1, 100), (200, 300), (400, 500), (600, 700), (800, 900)]

    def counts(other):
        got = I.overlap_join(frame(spark, reads, "a"), frame(spark, other, "b"), ("a_c", "a_l", "a_h"), ("b_c", "b_l", "b_h")).groupBy("a_id").count().collect()
        found = {r["a_id"]: r["count"] for r in got}
        return [found.get(k, 0) for k in range(5)]

    assert counts(exons) == [1, 1, 0, 2, 0] and counts([(1, 1000)]) == [1, 1, 1, 1, 0]


POINTS = [(1000, 1100), (1050, 1150), (1300, 1400), (2000, 2100), (2500, 2600), (2560, 2660)]


@pytest.mark.parametrize(
    ("eps", "min_pts", "want"),
    [(300, 5, []), (300, 3, [(1, 0, 3, 3), (1, 1, 3, 3), (1, 2, 3, 3)]), (500, 3, [(1, 0, 3, 3), (1, 1, 3, 3), (1, 2, 3, 3), (2, 3, 2, 2), (2, 4, 3, 3), (2, 5, 2, 2)])],
)
def test_dbscan_labels(eps, min_pts, want):
    low, high = (np.array(x) for x in zip(*POINTS, strict=True))
    assert C.dbscan(low, high, eps, min_pts) == want


def test_dbscan_in_groups_and_core_points_agree(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice("xy"), "g", p, p + draw.randint(0, 150)) for k, p in enumerate(draw.randint(1, 9000) for _ in range(400))]
    points = spark.createDataFrame(rows, "id long, chr string, gene_name string, low long, high long")
    local = C.cluster_points(points, ["chr", "gene_name"], 60, 5)
    cores = {r["alignment_id"]: r["neighbors"] for r in local.filter("label = 3").collect()}
    assert cores and cores == {r["id"]: r["neighbors"] for r in C.core_points(points, ["chr", "gene_name"], 60, 5).collect()}
    # Pieces cut at gaps give the clusters of the whole group.
    want = set()
    for chrom in "xy":
        own = sorted((r[3], r[4], r[0]) for r in rows if r[1] == chrom)
        low, high, ids = (np.array(x) for x in zip(*own, strict=True))
        want |= {(chrom, c, int(ids[p]), label, n) for c, p, label, n in C.dbscan(low, high, 60, 5)}
    assert {(r["chr"], r["local"], r["alignment_id"], r["label"], r["neighbors"]) for r in local.collect()} == want
    ids = C.number_clusters(local, ["chr", "gene_name"]).select("cluster_id").distinct().collect()
    assert sorted(r[0] for r in ids) == list(range(1, len(ids) + 1))


@pytest.fixture
def calls(spark):
    """Twelve fragments in two sources: mates of two genes cluster at two places each."""
    rows, hits = [], []
    starts = [p[0] for p in POINTS]
    for g, (gene_chr, chrom) in enumerate([("chr11", "chr1"), ("chr12", "chr2")]):
        for k, start in enumerate(starts):
            name, source = f"q{g}{k}", 1 + k % 2
            a, b = 100 * g + 2 * k + 1, 100 * g + 2 * k + 2
            rows.append((a, name, 97, gene_chr, 100 + 10 * k, 20, "101M", 101, 101, chrom, start, 2 | 8, source))
            rows.append((b, name, 145 | (0x800 if k == 1 else 0), chrom, start, 20, "81M20S" if k == 1 else "101M", 101, 101, gene_chr, 100 + 10 * k, 2, source))
            hits.append((g + 1, a, 100 + 10 * k, 101))
    alignments = spark.createDataFrame(rows, "id long, qname string, flag int, chr string, pos long, mapq int, cigar string, qlen int, rlen int, chr_next string, pos_next long, type int, source_id int")
    exons = spark.createDataFrame([(1, "gene1", "chr11", 1, 5000, "+", "e", "x1"), (2, "gene2", "chr12", 1, 5000, "-", "e", "x2")], "id long, gene_name string, chr string, start long, end long, strand string, ensg string, ense string")
    overlapping = spark.createDataFrame(hits, "exon_id long, alignment_id long, pos long, len long")
    return alignments, exons, overlapping


def test_clusters_of_mates(calls):
    alignments, exons, overlapping = calls
    points = C.mate_points(alignments, overlapping, exons)
    assert points.count() == 12
    clustering = C.number_clusters(C.cluster_points(points, ["chr", "gene_name"], 500, 3), ["chr", "gene_name"])
    assert clustering.count() == 12 and clustering.select("cluster_id").distinct().count() == 4
    again = C.recluster(clustering, alignments, 1, 500, 3)
    assert again.count() == 24 and again.filter("cluster_sid > 1").count() == 12
    windows = C.cluster_windows(again, alignments)
    hits = C.blacklist_hits(windows, exons.limit(0).select("id", "chr", "start", "end"))
    masks = {(r["sid"], r["filter"]) for r in C.filter_clusters(windows, C.gene_extents(exons), hits, ["chrM"], 1000, 2).collect()}
    assert masks == {(1, 15), (2, 31)}


def level_rows():
    """(chr, start, end, gene) of clusters on five chromosomes; genes g0 to g9 lie 1000 apart, h overlaps g0."""
    return [
        ("chr10", 100, 200, "g0"),
        ("chr11", 100, 200, "g0"), ("chr11", 150, 250, "h"),
        ("chr12", 100, 200, "g0"), ("chr12", 150, 250, "g2"),
        ("chr13", 100, 200, "g0"), ("chr13", 150, 250, "g9"),
        ("chr14", 100, 200, "g0"), ("chr14", 150, 250, "h"), ("chr14", 160, 250, "g8"), ("chr14", 170, 250, "g9"),
        ("chr15", 100, 200, "g0"), ("chr15", 300, 400, "g0"),
    ]


def test_levels_of_merged_clusters(spark):
    exons = [(k, f"g{k}", "chrX", 1000 * k + 1, 1000 * k + 500, "+", f"e{k}") for k in range(10)] + [(50, "h", "chrX", 300, 700, "+", "eh")]
    exons = spark.createDataFrame(exons, "id long, gene_name string, chr string, start long, end long, strand string, ense string")
    clusters = spark.createDataFrame([(k, 1, *r, 31) for k, r in enumerate(level_rows())] + [(99, 1, "chr10", 100, 900, "g0", 15)], "id long, sid int, chr string, start long, end long, gene_name string, filter int")
    merged = E.merge_clusters(clusters, exons, 3).join(clusters.withColumnRenamed("id", "cluster_id"), "cluster_id").collect()
    got = {}
    for r in merged:
        got.setdefault((r["chr"], r["retrocopy_id"]), set()).update({r["gene_name"], r["level"]})
    assert sorted(map(str, ((c, sorted(map(str, v))) for (c, _), v in got.items()))) == sorted(
        map(str, [("chr10", ["1", "g0"]), ("chr11", ["2", "g0", "h"]), ("chr12", ["4", "g0", "g2"]), ("chr13", ["8", "g0"]), ("chr13", ["8", "g9"]), ("chr14", ["10", "g0", "h"]), ("chr14", ["12", "g8", "g9"]), ("chr15", ["1", "g0"]), ("chr15", ["1", "g0"])])
    )


def test_spearman_against_ranks(spark):
    draw = random.Random(1)
    x, y = [draw.randint(0, 8) for _ in range(40)], [draw.randint(0, 8) for _ in range(40)]
    rows = [("g", a, b) for a, b in zip(x, y, strict=True)] + [("flat", 1, k) for k in range(5)] + [("one", 1, 1)]
    got = {r["g"]: r["rho"] for r in S.spearman(spark.createDataFrame(rows, "g string, x long, y long"), ["g"]).collect()}
    assert got["g"] == pytest.approx(S.rho_and_p(np.array(x, float), np.array(y, float), 1)[0]) and got["flat"] is None and got["one"] is None


def test_permutation_test_tells_order_from_noise(spark):
    rows = [(1, k, k * k) for k in range(30)] + [(2, k, (k * 17) % 31) for k in range(30)] + [(3, 1, k) for k in range(4)]
    got = {r["g"]: r for r in S.spearman_test(spark.createDataFrame(rows, "g long, x long, y long"), "g").collect()}
    assert got[1]["rho"] == pytest.approx(1) and got[1]["p_value"] < 0.01 < 0.2 < got[2]["p_value"] and got[3]["rho"] is None and got[3]["p_value"] == 1


def test_genotypes_and_calls(spark):
    sources = spark.createDataFrame([(1,), (2,)], "id int")
    events = spark.createDataFrame([(7,)], "id long")
    reads = lambda rows: spark.createDataFrame(rows, "retrocopy_id long, source_id int, mapq int")
    rows = {r["source_id"]: r for r in E.genotypes(sources, events, reads([(7, 1, 20)] * 3), reads([(7, 1, 30), (7, 1, 0)])).collect()}
    assert (rows[2]["reference_depth"], rows[2]["alternate_depth"], rows[2]["ho_ref_likelihood"], rows[2]["he_likelihood"]) == (0, 0, 0, 0)
    r = rows[1]
    assert r["ho_alt_likelihood"] == -math.inf and r["he_likelihood"] == pytest.approx(-5 * math.log10(2))
    assert r["ho_ref_likelihood"] == pytest.approx(-5 * math.log10(2) + math.log10(2 * 1e-3) + math.log10(2) + 3 * math.log10(2 * 0.99))
    triples = spark.createDataFrame([(-1.0, -5.0, -9.0, "0/0"), (-5.0, -1.0, -9.0, "0/1"), (-9.0, -5.0, -1.0, "1/1"), (0.0, 0.0, 0.0, "./."), (-3.0, -3.0, -3.0, "0/1"), (-1.0, -5.0, -1.0, "0/0")], "a double, b double, c double, want string")
    assert all(r["got"] == r["want"] for r in triples.withColumn("got", S.call(F.col("a"), F.col("b"), F.col("c"))).collect())


@pytest.mark.parametrize("value", [0.0, -33.0, -0.1, -5.0, 1e-5, 123456.0, 1234567.0, -0.30103, 100000.0, 0.0001, 999999.5, 1e300, -math.inf])
def test_numbers_look_as_in_c(spark, value):
    assert spark.createDataFrame([(value,)], "x double").select(S.general_format(F.col("x")).alias("t")).first()["t"] == "%g" % value


def test_points_hosts_and_depths(spark, calls):
    alignments, exons, overlapping = calls
    clustering = C.number_clusters(C.cluster_points(C.mate_points(alignments, overlapping, exons), ["chr", "gene_name"], 500, 3), ["chr", "gene_name"])
    windows = C.cluster_windows(clustering, alignments)
    points = {r["id"]: (r["point"], r["point_type"]) for r in E.insertion_points(windows, E.clip_modes(clustering, alignments)).collect()}
    assert points[1] == (1050 + 101, 2) and points[2][1] == 1
    events = spark.createDataFrame([(1, "chr11", 4000, 1), (2, "chr11", 5100, 1), (3, "chr12", 20000, 1)], "id long, chr string, insertion_point long, x int")
    hosts = {r["rid"]: (r["intragenic"], r["exonic"], r["near"]) for r in E.hosts(events, exons, 500).collect()}
    assert hosts == {1: ("gene1", "gene1", None), 2: (None, None, "gene1"), 3: (None, None, None)}


def test_info_text_rules(spark):
    columns = "chr string, window_start long, window_end long, parental_gene_name string, level int, insertion_point long, insertion_point_type int, orientation_rho double, orientation_p_value double, strand string, intragenic string, exonic string, near string, depth long, split_reads long"
    rows = [
        ("c", 90, 120, "A", 1, 100, 1, 0.5, 0.01, "-", None, None, "N", 3, 0),
        ("c", 90, 120, "A/B", 8, 100, 2, -0.5, 0.01, "?", "H/I", "H", "N", 3, 2),
        ("c", 90, 120, "A", 1, 100, 2, -0.5, 0.01, "+", "H", "H", None, 3, 2),
        ("c", 90, 120, "A", 1, 100, 2, -0.5, 0.5, "+", "H", None, None, 3, 2),
    ]
    got = [r["t"] for r in spark.createDataFrame(rows, columns).coalesce(1).select(V.info().alias("t")).collect()]
    assert got == [
        "SVTYPE=INS;IMPRECISE;CIPOS=-10,20;ORHO=0.500000;POLARITY=-;PG=A;PGTYPE=1;NEAR=N;DP=3",
        "SVTYPE=INS;PG=A/B;PGTYPE=8;EXONIC=H;INTRONIC=H/I;DP=3;SR=2",
        "SVTYPE=INS;ORHO=-0.500000;POLARITY=-;PG=A;PGTYPE=1;EXONIC=H;DP=3;SR=2",
        "SVTYPE=INS;PG=A;PGTYPE=1;INTRONIC=H;DP=3;SR=2",
    ]


def test_header_lists_sorted_contigs_and_samples():
    head = V.header(["s1", "s2"], "/r.fa", [("chr2", 5), ("chr1", 9)], when=datetime(2024, 1, 2))
    assert head[0] == "##fileformat=VCFv4.2" and head[3:6] == ["##reference=file:///r.fa", "##contig=<ID=chr1,length=9>", "##contig=<ID=chr2,length=5>"]
    assert head[-1].endswith("FORMAT\ts1\ts2") and sum(x.startswith("##INFO") for x in head) == 12
