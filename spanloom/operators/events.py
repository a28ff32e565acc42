"""Insertion events: clusters merged by position and parental gene, with point, orientation, genotype and annotation."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import reads as R
from spanloom.functions import statistics as S
from spanloom.functions.containers import joined_names
from spanloom.operators.clusters import gene_extents
from spanloom.operators.fragments import strided_ids
from spanloom.operators.intervals import BIN, point_join
from spanloom.schema import PASSING, Flag, Level, PointType, ReadType
from spanloom.session import stored


def gene_ranks(genes: DataFrame) -> DataFrame:
    """Adds the gene's ordinal on its chromosome."""
    return genes.withColumn("rank", F.dense_rank().over(Window.partitionBy("gene_chr").orderBy("gene_start", "gene_end")))


def islands(windows: DataFrame, by: list[str], low: str, high: str, order: list[str], width: int = BIN) -> DataFrame:
    """Adds island: a number, from 1 in each group, of runs of overlapping windows.

    A group is cut by low into bins, so a task holds some bins rather than a
    chromosome. Each bin numbers its own runs; of these, the first ones, which
    start within what earlier bins reach, go on from there. Only one row a bin
    is ordered over the whole group.
    """
    ordered = Window.partitionBy(*by, "_bin").orderBy(low, high, *order)
    reach = F.max(high).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    own = windows.withColumn("_bin", F.floor(F.col(low) / width)).withColumn("_new", reach.isNull() | F.coalesce(F.col(low) > reach, F.lit(False)))
    numbered = stored(own.withColumn("_own", F.sum(F.col("_new").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)

    def looked_up(rows: DataFrame, bins: DataFrame, *columns: str) -> DataFrame:
        keys = [*by, "_bin"]
        named = bins.select(*(F.col(k).alias(f"_at_{k}") for k in keys), *columns)
        return rows.join(named, functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys))).drop(*(f"_at_{k}" for k in keys))

    bins = numbered().groupBy(*by, "_bin").agg(F.max(high).alias("_top"), F.max("_own").alias("_many")).withColumn("_reach", F.max("_top").over(before))
    reached = stored(bins.drop("_top"))
    covered = F.count_if(~(F.col("_reach").isNull() | F.coalesce(F.col(low) > F.col("_reach"), F.lit(False))))
    starts = looked_up(numbered().filter("_new"), reached(), "_reach", "_many").groupBy(*by, "_bin").agg(covered.alias("_covered"), F.max("_many").alias("_many"))
    placed = stored(starts.withColumn("_before", F.coalesce(F.sum(F.col("_many") - F.col("_covered")).over(before), F.lit(0))).drop("_many"))
    found = looked_up(numbered(), placed(), "_covered", "_before")
    return found.withColumn("island", F.col("_before") + F.greatest(F.col("_own") - F.col("_covered"), F.lit(0))).drop("_bin", "_new", "_own", "_covered", "_before")


def parental_runs(ranked: DataFrame, near_rank: int = 3) -> DataFrame:
    """Adds run and level to clusters in islands (chr, island).

    Within an island and parental chromosome, clusters stay together while
    their genes overlap or lie within ``near_rank`` ordinals; an island of
    several runs is a hotspot.
    """
    keys = ["chr", "island"]
    ordered = Window.partitionBy(*keys, "gene_chr").orderBy("gene_start", "gene_end", "gene_name", "id", "sid")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reach, last_rank, last_gene = F.max("gene_end").over(before), F.lag("rank").over(ordered), F.lag("gene_name").over(ordered)
    overlaps = reach.isNotNull() & (F.col("gene_start") <= reach)
    near = last_rank.isNotNull() & (F.abs(F.col("rank") - last_rank) <= near_rank)
    marked = ranked.withColumn("_new", F.when(overlaps | near, 0).otherwise(1)).withColumn(
        "_bits", F.when(overlaps, F.when(F.col("gene_name") != last_gene, int(Level.OVERLAPPED_PARENTALS)).otherwise(0)).when(near, int(Level.NEAR_PARENTALS)).otherwise(0)
    )
    numbered = marked.withColumn("run", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one_run = Window.partitionBy(*keys, "gene_chr", "run")
    bits = numbered.withColumn("_level", F.bit_or("_bits").over(one_run)).withColumn("_runs", F.sum("_new").over(Window.partitionBy(*keys)))
    level = F.col("_level").bitwiseOR(F.when(F.col("_runs") > 1, int(Level.HOTSPOT)).otherwise(0))
    return bits.withColumn("level", F.when(level == 0, int(Level.PASS)).otherwise(level).cast("int")).drop("_new", "_bits", "_level", "_runs")


def merge_clusters(clusters: DataFrame, exons: DataFrame, near_rank: int = 3) -> DataFrame:
    """(retrocopy_id, cluster_id, cluster_sid, level) of the clusters that pass every filter."""
    ranked = clusters.filter(F.col("filter") == PASSING).join(gene_ranks(gene_extents(exons)), "gene_name")
    runs = parental_runs(islands(ranked, ["chr"], "start", "end", ["id", "sid"]), near_rank)
    keys = ["chr", "island", "gene_chr", "run"]
    events = strided_ids(runs.select(*keys).distinct(), 1, 1, keys).withColumnRenamed("id", "retrocopy_id")
    return runs.join(events, keys).select("retrocopy_id", F.col("id").alias("cluster_id"), F.col("sid").alias("cluster_sid"), "level")


def clip_modes(clustering: DataFrame, alignments: DataFrame) -> DataFrame:
    """(id, sid, clip) the commonest clip position of a cluster's supplementary reads.

    Reads without a clip count as one position, null, which may win; ties go to
    the smallest position.
    """
    clips = alignments.filter(R.flagged("flag", Flag.SUPPLEMENTARY)).select(F.col("id").alias("alignment_id"), R.clip_position().alias("clip"))
    counts = clustering.join(clips, "alignment_id").groupBy(F.col("cluster_id").alias("id"), F.col("cluster_sid").alias("sid"), "clip").count()
    place = F.row_number().over(Window.partitionBy("id", "sid").orderBy(F.desc("count"), F.asc_nulls_last("clip")))
    return counts.withColumn("_n", place).filter("_n = 1").select("id", "sid", "clip")


def insertion_points(clusters: DataFrame, modes: DataFrame) -> DataFrame:
    """(id, sid, point, point_type)."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    found = clusters.join(modes, ["id", "sid"], "left")
    kind = F.when(F.col("clip").isNull(), int(PointType.WINDOW_MEAN)).otherwise(int(PointType.SUPPLEMENTARY_MODE))
    return found.select("id", "sid", F.coalesce("clip", middle).alias("point"), kind.alias("point_type"))


def orientation_pairs(merging: DataFrame, clustering: DataFrame, alignments: DataFrame) -> DataFrame:
    """(retrocopy_id, x, y): distinct positions of a clustered read and of its mate in an exon."""
    spots = alignments.select(F.col("id").alias("alignment_id"), "qname", "source_id", F.col("pos").alias("x"))
    reads = merging.join(clustering.select("cluster_id", "cluster_sid", "alignment_id"), ["cluster_id", "cluster_sid"]).join(spots, "alignment_id")
    mates = alignments.filter(R.flagged("type", ReadType.EXONIC)).select(F.col("id").alias("mate_id"), "qname", "source_id", F.col("pos").alias("y"))
    # Any other read of the fragment in the cluster can bring the mate along for all of them.
    pairs = reads.join(mates, ["qname", "source_id"])
    brought = F.max(F.col("alignment_id") != F.col("mate_id")).over(Window.partitionBy("qname", "source_id", "cluster_id", "cluster_sid", "mate_id"))
    return pairs.withColumn("_brought", brought).filter("_brought").select("retrocopy_id", "x", "y").distinct()


def events(merging: DataFrame, clusters: DataFrame, points: DataFrame, orientation: DataFrame) -> DataFrame:
    """The retrocopy table: the window is that of all clusters, the point that of the first."""
    joined = merging.join(clusters.withColumnsRenamed({"id": "cluster_id", "sid": "cluster_sid"}), ["cluster_id", "cluster_sid"]).join(points.withColumnsRenamed({"id": "cluster_id", "sid": "cluster_sid"}), ["cluster_id", "cluster_sid"])
    first = F.struct("start", "cluster_id", "cluster_sid")
    merged = joined.groupBy("retrocopy_id").agg(
        F.min("chr").alias("chr"),
        F.min("start").alias("window_start"),
        F.max("end").alias("window_end"),
        joined_names(F.col("gene_name")).alias("parental_gene_name"),
        F.max("level").cast("int").alias("level"),
        F.min_by("point", first).alias("insertion_point"),
        F.min_by("point_type", first).alias("insertion_point_type"),
    )
    out = merged.join(orientation, "retrocopy_id", "left")
    return out.select(F.col("retrocopy_id").alias("id"), "chr", "window_start", "window_end", "parental_gene_name", "level", "insertion_point", "insertion_point_type", F.col("rho").alias("orientation_rho"), F.col("p_value").alias("orientation_p_value"))


def crossing_reads(reads: DataFrame, retrocopies: DataFrame, min_mapq: int = 8) -> DataFrame:
    """(retrocopy_id, source_id, mapq) of raw reads that cross an insertion point."""
    points = retrocopies.select(F.col("id").alias("retrocopy_id"), F.col("chr").alias("_c"), F.col("insertion_point"))
    spans = reads.select("source_id", "flag", "mapq", "pos", "rlen", F.col("chr").alias("_c2"), R.end_position().alias("_high"))
    return point_join(points, spans, ("_c", "insertion_point"), ("_c2", "pos", "_high")).filter(R.crosses("insertion_point", min_mapq)).select("retrocopy_id", "source_id", "mapq")


def abnormal_scores(merging: DataFrame, clustering: DataFrame, alignments: DataFrame, distinct: bool = False) -> DataFrame:
    """(retrocopy_id, source_id, mapq) of the clustered reads; one listed in two clusters of an event counts twice unless ``distinct``."""
    listed = merging.select("retrocopy_id", "cluster_id", "cluster_sid").join(clustering.select("cluster_id", "cluster_sid", "alignment_id"), ["cluster_id", "cluster_sid"]).select("retrocopy_id", "alignment_id")
    listed = listed.distinct() if distinct else listed
    return listed.join(alignments.select(F.col("id").alias("alignment_id"), "source_id", "mapq"), "alignment_id").select("retrocopy_id", "source_id", "mapq")


def genotypes(sources: DataFrame, retrocopies: DataFrame, crossing: DataFrame, abnormal: DataFrame, ploidy: int = 2) -> DataFrame:
    """The genotype table: a row for each source and event, also without reads.

    The likelihoods are sums, so each side is reduced before the join.
    """
    wrong, right = S.wrong_term("mapq", ploidy), S.right_term("mapq", ploidy)
    keys = ["retrocopy_id", "source_id"]
    ref = crossing.groupBy(*keys).agg(F.count("*").alias("reference_depth"), F.sum(right).alias("_ref_right"), F.sum(wrong).alias("_ref_wrong"))
    alt = abnormal.groupBy(*keys).agg(F.count("*").alias("alternate_depth"), F.sum(right).alias("_alt_right"), F.sum(wrong).alias("_alt_wrong"))
    grid = sources.select(F.col("id").alias("source_id")).crossJoin(retrocopies.select(F.col("id").alias("retrocopy_id")))
    rows = grid.join(ref, keys, "left").join(alt, keys, "left").fillna(0)
    het = S.heterozygous(F.col("reference_depth") + F.col("alternate_depth"), ploidy)
    return rows.select(
        "source_id",
        "retrocopy_id",
        F.col("reference_depth").cast("int").alias("reference_depth"),
        F.col("alternate_depth").cast("int").alias("alternate_depth"),
        (het + F.col("_alt_wrong") + F.col("_ref_right")).alias("ho_ref_likelihood"),
        (het + F.lit(0.0)).alias("he_likelihood"),
        (het + F.col("_ref_wrong") + F.col("_alt_right")).alias("ho_alt_likelihood"),
    )


def _names(hits: DataFrame, name: str) -> DataFrame:
    return hits.groupBy("rid").agg(joined_names(F.col("_gene")).alias(name))


def hosts(retrocopies: DataFrame, exons: DataFrame, near_distance: int = 10000, symmetric: bool = False) -> DataFrame:
    """(rid, intragenic, exonic, near): genes and exons around each insertion point, names joined by slashes.

    Near are genes that end within ``near_distance`` before the point, and with
    ``symmetric`` also those that start within it after.
    """
    points = retrocopies.select(F.col("id").alias("rid"), F.col("chr").alias("_c1"), F.col("insertion_point").alias("_at"))
    genes = gene_extents(exons).select(F.col("gene_name").alias("_gene"), F.col("gene_chr").alias("_c2"), F.col("gene_start").alias("_low"), F.col("gene_end").alias("_high"))
    parts = exons.select(F.col("gene_name").alias("_gene"), F.col("chr").alias("_c2"), F.col("start").alias("_low"), F.col("end").alias("_high"))
    after = genes.select("_gene", "_c2", (F.col("_high") + 1).alias("_low"), (F.col("_high") + near_distance).alias("_high"))
    before = genes.select("_gene", "_c2", F.greatest(F.col("_low") - near_distance, F.lit(0)).alias("_high0"), (F.col("_low") - 1).alias("_high")).withColumnRenamed("_high0", "_low")

    def at(ranges: DataFrame) -> DataFrame:
        return point_join(points, ranges, ("_c1", "_at"), ("_c2", "_low", "_high")).select("rid", "_gene")

    around = at(after).unionByName(at(before)) if symmetric else at(after)
    out = points.select("rid").join(_names(at(genes), "intragenic"), "rid", "left").join(_names(at(parts), "exonic"), "rid", "left")
    return out.join(_names(around, "near"), "rid", "left")


def depths(retrocopies: DataFrame, merging: DataFrame, clustering: DataFrame, alignments: DataFrame) -> DataFrame:
    """(rid, depth, split_reads): distinct clustered reads, and those of them that are clipped at the insertion point."""
    listed = merging.select("retrocopy_id", "cluster_id", "cluster_sid").join(clustering.select("cluster_id", "cluster_sid", "alignment_id"), ["cluster_id", "cluster_sid"]).select("retrocopy_id", "alignment_id")
    # Dealt by read, for both the distinct rows and the join.
    listed = listed.repartition("alignment_id").distinct()
    reads = alignments.select(F.col("id").alias("alignment_id"), "flag", R.clip_position().alias("_clip"))
    joined = listed.join(reads, "alignment_id").join(retrocopies.select(F.col("id").alias("retrocopy_id"), "insertion_point"), "retrocopy_id")
    split: Column = R.flagged("flag", Flag.SUPPLEMENTARY) & (F.col("_clip") == F.col("insertion_point"))
    return joined.groupBy(F.col("retrocopy_id").alias("rid")).agg(F.count("*").alias("depth"), F.count_if(F.coalesce(split, F.lit(False))).alias("split_reads"))
