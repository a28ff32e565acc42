"""Density clusters of reads whose mates lie in a gene's exons."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import reads as R
from spanloom.operators.fragments import strided_ids
from spanloom.operators.intervals import overlap_join
from spanloom.schema import ClusterFilter, Label, ReadType
from spanloom.session import checkpointed, stored


def mate_points(alignments: DataFrame, overlapping: DataFrame, exons: DataFrame) -> DataFrame:
    """(id, chr, low, high, gene_name): reads with a mate, of the same name and source, in an exon of the gene.

    A read in an exon itself counts only for genes other than its own.
    """
    genes = overlapping.select("alignment_id", "exon_id").join(exons.select(F.col("id").alias("exon_id"), "gene_name"), "exon_id").select("alignment_id", "gene_name")
    live = alignments.filter(F.col("type") != 0).select("id", "qname", "source_id", "chr", "pos", R.end_position().alias("high"), R.flagged("type", ReadType.EXONIC).alias("exonic"))
    named = live.join(genes, F.col("id") == F.col("alignment_id"), "left").drop("alignment_id")
    mates = named.filter("exonic").select("qname", "source_id", F.col("id").alias("mate_id"), F.col("gene_name").alias("mate_gene")).distinct()
    pairs = named.join(mates, ["qname", "source_id"]).filter((F.col("id") != F.col("mate_id")) & (~F.col("exonic") | ~F.col("gene_name").eqNullSafe(F.col("mate_gene"))))
    return pairs.select("id", "chr", F.col("pos").alias("low"), "high", F.col("mate_gene").alias("gene_name")).distinct()


def dbscan(low: np.ndarray, high: np.ndarray, eps: int, min_pts: int) -> list[tuple[int, int, int, int]]:
    """(cluster, point, label, neighbours) rows, clusters from 1.

    A point's neighbours are the intervals that touch its centre widened by
    eps on both sides, not below 1; with unequal lengths that is not symmetric,
    and a border point may be listed in several clusters. Points are taken in
    the given order, which must be by low.
    """
    centre = (low + high) // 2
    left, right = np.maximum(centre - eps, 1), centre + eps
    longest = int((high - low).max()) if len(low) else 0
    count = np.searchsorted(low, right, "right") - np.searchsorted(np.sort(high), left, "left")
    label = np.zeros(len(low), int)
    known = np.zeros(len(low), int)
    rows = []

    def near(p: int) -> np.ndarray:
        at = np.arange(np.searchsorted(low, left[p] - longest, "left"), np.searchsorted(low, right[p], "right"))
        return at[high[at] >= left[p]]

    cluster = 0
    for p in range(len(low)):
        if label[p] != Label.UNDEFINED:
            continue
        known[p] = count[p]
        if count[p] < min_pts:
            label[p] = Label.NOISE
            continue
        cluster += 1
        label[p] = Label.CORE
        seeds = dict.fromkeys(near(p).tolist())
        queue = list(seeds)
        for q in queue:
            if label[q] == Label.NOISE:
                label[q] = Label.REACHABLE
            if label[q] != Label.UNDEFINED:
                continue
            label[q], known[q] = Label.REACHABLE, count[q]
            if count[q] >= min_pts:
                label[q] = Label.CORE
                fresh = [x for x in near(q).tolist() if x not in seeds]
                seeds.update(dict.fromkeys(fresh))
                queue += fresh
        rows += [(cluster, q, int(label[q]), int(known[q])) for q in sorted(seeds)]
    return rows


def cluster_points(points: DataFrame, by: list[str], eps: int = 300, min_pts: int = 10) -> DataFrame:
    """(by, local, alignment_id, label, neighbors) of every group's clusters.

    A group is cut where a point starts more than eps after all before it end:
    no point has neighbours beyond such a gap, so the pieces are clustered
    apart, with the same result. Pieces without enough points in any window are
    dropped before Python sees them; what is left are the reads of one stretch
    of a chromosome that support one gene.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "_piece long, _n int, alignment_id long, label int, neighbors int"])
    keys = [*by, "_piece"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["low", "high", "id"], kind="stable")
        rows = dbscan(group["low"].to_numpy(np.int64), group["high"].to_numpy(np.int64), eps, min_pts)
        ids = group["id"].to_numpy()
        out = pd.DataFrame([(c, ids[p], x, n) for c, p, x, n in rows], columns=["_n", "alignment_id", "label", "neighbors"])
        for k, b in enumerate(keys):
            out.insert(k, b, group[b].iloc[0])
        return out

    ordered = Window.partitionBy(*by).orderBy("low", "high", "id")
    reach = F.max("high").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("low") > reach + eps), 1).otherwise(0)
    cut = points.select(*by, "low", "high", "id").withColumn("_new", fresh).withColumn("_piece", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # A core point's neighbours start within 2 * eps and the longest length of each other.
    piece = Window.partitionBy(*keys)
    ahead = F.lead("low", min_pts - 1).over(piece.orderBy("low", "high", "id"))
    dense = F.max(ahead - F.col("low") <= 2 * eps + F.col("_longest")).over(piece)
    large = cut.withColumn("_longest", F.max(F.col("high") - F.col("low")).over(piece)).withColumn("_dense", dense).filter("_dense").select(*keys, "low", "high", "id")
    found = checkpointed(large.groupBy(*keys).applyInPandas(run, schema))
    # Clusters, not their points, are numbered.
    one = found.select(*keys, "_n").distinct().withColumn("local", F.row_number().over(Window.partitionBy(*by).orderBy("_piece", "_n")))
    return found.join(one, [*keys, "_n"]).select(*by, "local", "alignment_id", "label", "neighbors")


def core_points(points: DataFrame, by: list[str], eps: int, min_pts: int) -> DataFrame:
    """(by, id, neighbors) of the points with enough neighbours, in built-in functions only: no group is gathered."""
    centre = F.floor((F.col("low") + F.col("high")) / 2)
    # Both sides of the join read the points, which can be long work.
    written = stored(points.select(*by, "id", "low", "high"))
    points = written()
    asked = points.select(*(F.col(b).alias(f"_{b}") for b in by), "id", F.concat_ws("\x1f", *by).alias("_group"), F.greatest(centre - eps, F.lit(1)).alias("_from"), (centre + eps).alias("_to"))
    others = written().select(F.concat_ws("\x1f", *by).alias("_group2"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    pairs = overlap_join(asked, others, ("_group", "_from", "_to"), ("_group2", "_low", "_high"), width=max(2 * eps, 1))
    found = pairs.groupBy(*(f"_{b}" for b in by), "id").agg(F.count("*").alias("neighbors")).filter(F.col("neighbors") >= min_pts)
    return found.select(*(F.col(f"_{b}").alias(b) for b in by), "id", "neighbors")


def number_clusters(local: DataFrame, by: list[str]) -> DataFrame:
    """(cluster_id, cluster_sid, alignment_id, label, neighbors, by): ids in order of group and local number.

    Only the clusters, not their reads, are numbered together, over all tasks.
    """
    ids = strided_ids(local.select(*by, "local").distinct(), 1, 1, [*by, "local"]).withColumnRenamed("id", "cluster_id")
    return local.join(ids, [*by, "local"]).select("cluster_id", F.lit(1).alias("cluster_sid"), "alignment_id", "label", "neighbors", *by)


def supported(clustering: DataFrame, alignments: DataFrame, support: int) -> DataFrame:
    """The clustering's rows from sources with at least ``support`` rows in the cluster."""
    sources = alignments.select(F.col("id").alias("alignment_id"), "source_id")
    seen = Window.partitionBy("cluster_id", "cluster_sid", "source_id")
    return clustering.join(sources, "alignment_id").withColumn("_n", F.count("*").over(seen)).filter(F.col("_n") >= support).drop("_n")


def recluster(clustering: DataFrame, alignments: DataFrame, support: int, eps: int = 300, min_pts: int = 10) -> DataFrame:
    """The clustering plus the clusters found anew among supported sources, with new sub-numbers."""
    gene = clustering.select("cluster_id", "gene_name").distinct()
    spots = alignments.select(F.col("id"), F.col("pos").alias("low"), R.end_position().alias("high"))
    points = supported(clustering, alignments, support).join(spots, F.col("alignment_id") == F.col("id")).select("cluster_id", "cluster_sid", "id", "low", "high")
    again = cluster_points(points, ["cluster_id", "cluster_sid"], eps, min_pts)
    again = again.select("cluster_id", (F.col("cluster_sid") + F.col("local")).alias("cluster_sid"), "alignment_id", "label", "neighbors").join(gene, "cluster_id")
    columns = ["cluster_id", "cluster_sid", "alignment_id", "label", "neighbors", "gene_name"]
    return clustering.select(*columns).unionByName(again.select(*columns))


def gene_extents(exons: DataFrame) -> DataFrame:
    """(gene_name, gene_chr, gene_start, gene_end, strand); chr and strand are those of the first exon."""
    first = F.struct("start", "id")
    return exons.groupBy("gene_name").agg(
        F.min_by("chr", first).alias("gene_chr"), F.min("start").alias("gene_start"), F.max("end").alias("gene_end"), F.min_by("strand", first).alias("strand")
    )


def cluster_windows(clustering: DataFrame, alignments: DataFrame) -> DataFrame:
    """(id, sid, chr, start, end, gene_name) of every cluster."""
    spots = alignments.select(F.col("id").alias("alignment_id"), "chr", "pos", (F.col("pos") + F.col("rlen") - 1).alias("_end"))
    return (
        clustering.select("cluster_id", "cluster_sid", "alignment_id", "gene_name")
        .join(spots, "alignment_id")
        .groupBy(F.col("cluster_id").alias("id"), F.col("cluster_sid").alias("sid"))
        .agg(F.min("chr").alias("chr"), F.min("pos").alias("start"), F.max("_end").alias("end"), F.min("gene_name").alias("gene_name"))
    )


def blacklist_hits(windows: DataFrame, blacklist: DataFrame, padding: int = 0) -> DataFrame:
    """(blacklist_id, cluster_id, cluster_sid, pos, len)."""
    own = windows.select(F.col("id").alias("cluster_id"), F.col("sid").alias("cluster_sid"), F.col("chr").alias("_c1"), F.col("start").alias("_l1"), F.col("end").alias("_h1"))
    bad = blacklist.select(F.col("id").alias("blacklist_id"), F.col("chr").alias("_c2"), F.col("start").alias("_l2"), F.col("end").alias("_h2"))
    found = overlap_join(own, bad, ("_c1", "_l1", "_h1"), ("_c2", "_l2", "_h2"), padding=padding)
    return found.select("blacklist_id", "cluster_id", "cluster_sid", F.col("overlap_pos").alias("pos"), F.col("overlap_len").alias("len"))


def _bit(condition: Column, bit: int) -> Column:
    return F.when(condition, int(bit)).otherwise(0)


def filter_clusters(windows: DataFrame, genes: DataFrame, hits: DataFrame, chr_blacklist: Iterable[str] = ("chrM",), distance: int = 1000000, support: int = 1) -> DataFrame:
    """Adds filter, one bit for each test that a cluster passes.

    With support over 1 only clusters found anew (sub-number over 1) have the SUPPORT bit.
    """
    barred = list(chr_blacklist)
    hit = hits.select(F.col("cluster_id").alias("_id"), F.col("cluster_sid").alias("_sid")).distinct()
    joined = windows.join(genes.drop("strand"), "gene_name").join(hit, (F.col("id") == F.col("_id")) & (F.col("sid") == F.col("_sid")), "left")
    near = (F.col("start") <= F.col("gene_end") + distance) & (F.col("end") >= F.col("gene_start") - distance)
    allowed = ~F.col("chr").isin(barred) & ~F.col("gene_chr").isin(barred) if barred else F.lit(True)
    bits = (
        F.lit(int(ClusterFilter.NONE))
        + _bit(allowed, ClusterFilter.CHR)
        + _bit((F.col("chr") != F.col("gene_chr")) | ~near, ClusterFilter.DIST)
        + _bit(F.col("_id").isNull(), ClusterFilter.REGION)
        + (F.lit(int(ClusterFilter.SUPPORT)) if support <= 1 else _bit(F.col("sid") > 1, ClusterFilter.SUPPORT))
    )
    return joined.select("id", "sid", "chr", "start", "end", "gene_name", bits.cast("int").alias("filter"))
