"""The three stages: samples to a store, stores to events, events to variant text.

Each stage writes the tables it makes, so a later one starts from files.
"""

from __future__ import annotations

import dataclasses
import logging
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import reads as R
from spanloom.functions import statistics as S
from spanloom.operators import clusters as C
from spanloom.operators import events as E
from spanloom.operators import fragments as P
from spanloom.operators import vcf as V
from spanloom.schema import PASSING, ReadType
from spanloom.sources import text_formats as T
from spanloom.sources.bam import read_bam
from spanloom.sources.workspace import Workspace, plain_path, qualified

log = logging.getLogger("spanloom")


def _at_least(name: str, value: float, least: float) -> None:
    if value < least:
        raise ValueError(f"{name} must be {least} or more, not {value}")


def _fraction(name: str, value: float, least: float = 0.0) -> None:
    if not least < value <= 1:
        raise ValueError(f"{name} must be over {least} and at most 1, not {value}")


@dataclass(kw_only=True)
class Stage:
    """Options that all stages share. Spark sets the number of threads and the memory, so those two are only checked and echoed."""

    output: str | None = None
    output_dir: str = "."
    prefix: str = "out"
    log_file: str | None = None
    quiet: bool = False
    debug: bool = False
    threads: int = 1
    cache_size: int = 200_000

    SUFFIX = ".store"

    @property
    def target(self) -> str:
        """``output``, or the prefix with the stage's suffix in the output folder."""
        return self.output or f"{self.output_dir.rstrip('/') or '/'}/{self.prefix}{self.SUFFIX}"

    def _common(self) -> None:
        _at_least("threads", self.threads, 1)
        _at_least("cache_size", self.cache_size, 200_000)
        if not self.prefix and not self.output:
            raise ValueError("the prefix is empty")

    def start_log(self) -> None:
        """Messages go to standard error, unless quiet, and to the log file; then the options are echoed."""
        for handler in [h for h in log.handlers if getattr(h, "stage", False)]:
            log.removeHandler(handler)
            handler.close()
        log.setLevel(logging.DEBUG if self.debug else logging.INFO)
        log.propagate = False
        sinks = ([] if self.quiet else [logging.StreamHandler()]) + ([logging.FileHandler(self.log_file)] if self.log_file else [])
        for handler in sinks or [logging.NullHandler()]:
            handler.stage = True
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(handler)
        shown = (f"--{f.name.replace('_', '-')}={getattr(self, f.name)}" for f in dataclasses.fields(self) if getattr(self, f.name) not in (None, False, (), [], {}))
        log.info("%s %s", type(self).__name__, " ".join(shown))


def _unique(paths: Sequence[str]) -> list[str]:
    return sorted(set(paths))


@dataclass
class ProcessSample(Stage):
    """Reads alignment files, keeps abnormal fragments, and stores them with their exon overlaps."""

    annotation_file: str
    input_files: Sequence[str] = ()
    input_file: str | None = None
    phred_quality: int = 8
    sorted: bool = False
    max_distance: int = 10000
    max_base_freq: float = 0.75
    deduplicate: bool = False
    exon_frac: float | None = None
    alignment_frac: float | None = None
    either: bool = False
    reciprocal: bool = False

    def validate(self) -> None:
        self._common()
        if not self.annotation_file:
            raise ValueError("an annotation file is needed")
        if not self.input_files and not self.input_file:
            raise ValueError("no alignment file is given")
        _at_least("phred_quality", self.phred_quality, 0)
        _at_least("max_distance", self.max_distance, 0)
        _fraction("max_base_freq", self.max_base_freq, 0.25)
        for name in ("exon_frac", "alignment_frac"):
            if (value := getattr(self, name)) is not None:
                _fraction(name, value)
        if self.reciprocal and self.alignment_frac is not None:
            raise ValueError("reciprocal and alignment_frac exclude each other")
        if self.reciprocal and self.exon_frac is None:
            raise ValueError("reciprocal needs exon_frac")

    def run(self, spark: SparkSession) -> Workspace:
        self.validate()
        self.start_log()
        paths = _unique([*self.input_files, *(T.file_list(spark, self.input_file) if self.input_file else [])])
        if not paths:
            raise ValueError("no alignment file is given")
        store = Workspace.create(spark, self.target)
        store.write("batch", spark.createDataFrame([(1, datetime.now().strftime("%Y-%m-%d %H:%M:%S"))], "id int, timestamp string"))
        store.write("source", spark.createDataFrame([(k + 1, 1, p) for k, p in enumerate(paths)], "id int, batch_id int, path string"))
        found = T.exons_of(T.read_gff(spark, self.annotation_file))
        exons = store.write("exon", P.strided_ids(found, 1, 1, ["chr", "start", "ense"]))
        raw = read_sources(spark, [(k + 1, p) for k, p in enumerate(paths)])
        kept = P.fragment_filter(raw, self.max_distance, self.phred_quality, self.max_base_freq).drop("seq", "path")
        place = ["source_id", "chr", "pos", "qname", "flag", "cigar"]
        # Written once before ids and overlaps use it twice.
        plain = f"{store.path}/_fragments"
        P.strided_ids(kept, 1, 1, place).write.mode("overwrite").parquet(plain)
        reads = spark.read.parquet(plain)
        fraction = self.exon_frac if self.reciprocal else self.alignment_frac
        hits = store.write("overlapping", P.exon_overlaps(reads, exons, self.exon_frac, fraction, self.either))
        typed = P.mark_exonic(reads, hits)
        store.write("alignment", P.drop_duplicates(typed) if self.deduplicate else typed)
        for row in counters(store).orderBy("path").collect():
            log.info("%s: %d abnormal alignments, %d of them in exons (%.2f%%)", row["path"], row["abnormal"], row["exonic"], 100 * row["exonic"] / max(row["abnormal"], 1))
        return store


def counters(store: Workspace) -> DataFrame:
    """(path, abnormal, exonic, duplicates) of every source: stored alignments, those in exons, and those whose type was taken away."""
    kind = F.col("type")
    seen = store.read("alignment").groupBy("source_id").agg(F.count("*").alias("abnormal"), F.count_if(R.flagged(kind, ReadType.EXONIC)).alias("exonic"), F.count_if(kind == int(ReadType.NONE)).alias("duplicates"))
    joined = store.read("source").join(seen, F.col("id") == F.col("source_id"), "left")
    return joined.select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("abnormal", "exonic", "duplicates")))


def read_sources(spark: SparkSession, sources: Sequence[tuple[int, str]]) -> DataFrame:
    """The alignments of (id, path) sources: one scan for all files of a format, with source_id for the path."""
    if crams := [p for _, p in sources if p.endswith(".cram")]:
        raise ValueError(f"CRAM is not read, turn it into BAM or SAM: {crams[0]}")
    found = None
    for binary in (False, True):
        own = [(k, qualified(spark, p)) for k, p in sources if p.endswith(".bam") is binary]
        if not own:
            continue
        rows = (read_bam if binary else T.read_sam)(spark, sorted({p for _, p in own}))
        ids = spark.createDataFrame(own, "_id int, _path string")
        unknown = F.raise_error(F.concat(F.lit("no source has the path "), F.col("path"))).cast("int")
        one = rows.join(F.broadcast(ids), plain_path(F.col("path")) == F.col("_path"), "left").withColumn("source_id", F.coalesce("_id", unknown)).drop("_id", "_path")
        found = one if found is None else found.unionByName(one)
    return found


@dataclass
class MergeCall(Stage):
    """Joins stores, clusters their reads, and calls events and genotypes."""

    stores: Sequence[str] = ()
    input_file: str | None = None
    in_place: bool = False
    epsilon: int = 300
    min_pts: int = 10
    parental_distance: int = 1000000
    genotype_support: int = 1
    blacklist_chr: Sequence[str] = ("chrM",)
    blacklist_region: str | None = None
    blacklist_padding: int = 0
    gff_feature: str = "gene"
    gff_hard_attributes: dict[str, str] = field(default_factory=dict)
    gff_soft_attributes: Sequence[tuple[str, str]] = ()
    near_gene_rank: int = 3
    phred_quality: int = 8

    def validate(self) -> None:
        self._common()
        if not self.stores and not self.input_file:
            raise ValueError("no store is given")
        _at_least("epsilon", self.epsilon, 0)
        _at_least("min_pts", self.min_pts, 3)
        _at_least("parental_distance", self.parental_distance, 0)
        _at_least("genotype_support", self.genotype_support, 0)
        _at_least("blacklist_padding", self.blacklist_padding, 0)
        _at_least("near_gene_rank", self.near_gene_rank, 0)
        _at_least("phred_quality", self.phred_quality, 0)

    def run(self, spark: SparkSession) -> Workspace:
        self.validate()
        self.start_log()
        store = self._joined(spark)
        alignments, overlapping, exons = (store.read(n) for n in ("alignment", "overlapping", "exon"))
        if self.blacklist_region:
            soft = list(self.gff_soft_attributes) or ([] if self.gff_hard_attributes else [("gene_type", "processed_pseudogene"), ("tag", "retrogene")])
            regions = T.blacklist_regions(spark, self.blacklist_region, self.gff_feature, self.gff_hard_attributes, soft)
            store.write("blacklist", P.strided_ids(regions, 1, 1, ["chr", "start", "end", "name"]))
        else:
            store.write("blacklist", spark.createDataFrame([], store.read("blacklist").schema))
        blacklist = store.read("blacklist")
        points = C.mate_points(alignments, overlapping, exons)
        local = C.cluster_points(points, ["chr", "gene_name"], self.epsilon, self.min_pts)
        genes_of = C.number_clusters(local, ["chr", "gene_name"])
        named = f"{store.path}/_clusters"
        (C.recluster(genes_of, alignments, self.genotype_support, self.epsilon, self.min_pts) if self.genotype_support > 1 else genes_of).write.mode("overwrite").parquet(named)
        found = spark.read.parquet(named)
        clustering = store.write("clustering", found)
        windows = C.cluster_windows(found, alignments)
        hits = store.write("overlapping_blacklist", C.blacklist_hits(windows, blacklist, self.blacklist_padding))
        barred = [_standard(spark, c) for c in self.blacklist_chr]
        kept = store.write("cluster", C.filter_clusters(windows, C.gene_extents(exons), hits, barred, self.parental_distance, self.genotype_support))
        passing = kept.filter(F.col("filter") == PASSING).count()
        log.info("%d clusters pass every filter", passing)
        if not passing:
            log.warning("no cluster is left, so no event is called")
            for name in ("cluster_merging", "retrocopy", "genotype"):
                store.write(name, spark.createDataFrame([], store.read(name).schema))
            return store
        merged = f"{store.path}/_merging"
        E.merge_clusters(kept, exons, self.near_gene_rank).write.mode("overwrite").parquet(merged)
        merging = spark.read.parquet(merged)
        store.write("cluster_merging", merging)
        points = E.insertion_points(kept, E.clip_modes(clustering, alignments))
        tested = S.spearman_test(E.orientation_pairs(merging, clustering, alignments), "retrocopy_id")
        retrocopies = store.write("retrocopy", E.events(merging, kept, points, tested))
        raw = read_sources(spark, [(r["id"], r["path"]) for r in store.read("source").collect()]).select("source_id", "flag", "mapq", "chr", "pos", "rlen")
        crossing = E.crossing_reads(raw, retrocopies, self.phred_quality)
        store.write("genotype", E.genotypes(store.read("source"), retrocopies, crossing, E.abnormal_scores(merging, clustering, alignments)))
        log.info("called %d events", retrocopies.count())
        return store

    def _joined(self, spark: SparkSession) -> Workspace:
        names = ("batch", "source", "exon", "alignment", "overlapping")
        paths = _unique([*self.stores, *(T.file_list(spark, self.input_file) if self.input_file else [])])
        if not paths:
            raise ValueError("no store is given")
        opened = [Workspace.open(spark, p) for p in paths]
        if self.in_place and len(opened) == 1:
            return opened[0]
        united = P.union_stores({n: Workspace.read_together(opened, n) for n in names})
        store = Workspace.create(spark, f"{opened[0].path}.joined" if self.in_place else self.target)
        for name in names:
            store.write(name, united[name])
        return store


def _standard(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(R.standard_chromosome(F.lit(name)).alias("c")).first()["c"]


@dataclass
class MakeVcf(Stage):
    """Writes a store's events as variant text."""

    store: str
    near_gene_dist: int = 10000
    orientation_error: float = 0.05
    reference_file: str | None = None
    symmetric: bool = False

    SUFFIX = ".vcf"

    def validate(self) -> None:
        self._common()
        _at_least("near_gene_dist", self.near_gene_dist, 0)
        if not 0 <= self.orientation_error <= 1 or math.isnan(self.orientation_error):
            raise ValueError("orientation_error must be between 0 and 1")

    def run(self, spark: SparkSession) -> str:
        self.validate()
        self.start_log()
        store = Workspace.open(spark, self.store)
        t = store.tables("retrocopy", "exon", "cluster_merging", "clustering", "alignment", "genotype", "source")
        contigs = T.read_fasta(spark, self.reference_file).withColumn("contig", R.standard_chromosome("contig")) if self.reference_file else None
        sources = t["source"].orderBy("id").collect()
        names = [re.sub(r"(?<=.)\.[^.]*$", "", r["path"].rsplit("/", 1)[-1]) for r in sources]
        listed = [(r["contig"], r["length"]) for r in contigs.select("contig", "length").collect()] if contigs is not None else []
        events = V.described(t["retrocopy"], t["exon"], t["cluster_merging"], t["clustering"], t["alignment"], self.near_gene_dist, self.symmetric)
        rows = V.body(events, t["genotype"], [r["id"] for r in sources], contigs, self.orientation_error)
        V.write(self.target, V.header(names, self.reference_file, listed), rows)
        log.info("wrote %s", self.target)
        return self.target
