"""The three stages end to end on made-up samples, their options, the store, the stream and the command line."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from spanloom.__main__ import stage_of
from spanloom.operators import fragments as P
from spanloom.operators import vcf as V
from spanloom.plans.pipeline import MakeVcf, MergeCall, ProcessSample, read_sources
from spanloom.schema import TABLES, VERSION
from spanloom.sources import bam
from spanloom.sources.workspace import Workspace
from spanloom.streaming.ingest import stream_fragments

INSERTED_AT = 50000


def sample(seed: int) -> str:
    """Fragments that join an insertion on chr2 with the exons of a gene on chr1, plain pairs, and reads across the point."""
    draw = random.Random(seed)
    lines = ["@HD\tVN:1.6\tSO:unsorted"]
    seq, add = "ACGT" * 25, lambda *f: lines.append("\t".join(map(str, f)))
    for k in range(14):
        gene, host = 1000 + 10 * k, INSERTED_AT - 300 + 12 * k
        add(f"s{seed}m{k}", 97, "1", gene, 40, "100M", "2", host, 0, seq, "*")
        add(f"s{seed}m{k}", 145, "2", host, 40, "100M", "1", gene, 0, seq, "*")
    for k in range(4):
        add(f"s{seed}x{k}", 97, "1", 1500 + k, 40, "100M", "2", INSERTED_AT + 60, 0, seq, "*")
        add(f"s{seed}x{k}", 145, "2", INSERTED_AT + 60, 40, "100M", "1", 1500 + k, 0, seq, "*")
        add(f"s{seed}x{k}", 2193, "2", INSERTED_AT - 80, 40, "80M20S", "1", 1500 + k, 0, seq, "*")
    for k in range(seed + 2):
        start = INSERTED_AT - 60 + k
        add(f"s{seed}c{k}", 99, "2", start, 30, "100M", "=", start + 200, 300, seq, "*")
        add(f"s{seed}c{k}", 147, "2", start + 200, 30, "100M", "=", start, -300, seq, "*")
    for k in range(50):
        start = draw.randint(1, 90000)
        add(f"s{seed}p{k}", 99, "1", start, 30, "100M", "=", start + 200, 300, seq, "*")
        add(f"s{seed}p{k}", 147, "1", start + 200, 30, "100M", "=", start, -300, seq, "*")
    return "\n".join(lines) + "\n"


GTF = """chr1\tx\texon\t900\t1300\t.\t+\t.\tgene_name "PARENT"; gene_id "E1"; transcript_type "protein_coding"; exon_id "X1";
chr1\tx\texon\t1400\t1900\t.\t+\t.\tgene_name "PARENT"; gene_id "E1"; transcript_type "protein_coding"; exon_id "X2";
chr2\tx\texon\t49000\t49200\t.\t-\t.\tgene_name "HOST"; gene_id "E2"; transcript_type "protein_coding"; exon_id "X3";
chr2\tx\texon\t50800\t51000\t.\t-\t.\tgene_name "HOST"; gene_id "E2"; transcript_type "protein_coding"; exon_id "X4";
"""


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("run")
    (top / "genes.gtf").write_text(GTF)
    made = []
    for k in (1, 2):
        (top / f"sample{k}.sam").write_text(sample(k))
        step = ProcessSample(str(top / "genes.gtf"), [f"{top}/sample{k}.sam"], output=str(top / f"s{k}.store"))
        made.append(step.run(spark).path)
    return top, made


def test_samples_hold_abnormal_fragments_only(spark, stores):
    _, paths = stores
    store = Workspace.open(spark, paths[0])
    rows = store.read("alignment").collect()
    assert {r["qname"][2] for r in rows} == {"m", "x"} and len(rows) == 14 * 2 + 4 * 3
    assert sorted(r["id"] for r in rows) == list(range(1, len(rows) + 1))
    assert {r["type"] for r in rows if r["chr"] == "chr1"} == {10} and store.read("exon").count() == 4


def test_event_is_called_and_written(spark, stores):
    top, paths = stores
    store = MergeCall(paths, output=str(top / "all.store"), min_pts=5).run(spark)
    events = store.read("retrocopy").collect()
    assert [(r["chr"], r["parental_gene_name"], r["level"], r["insertion_point_type"], r["insertion_point"]) for r in events] == [("chr2", "PARENT", 1, 2, INSERTED_AT)]
    depths = {r["source_id"]: (r["reference_depth"], r["alternate_depth"]) for r in store.read("genotype").collect()}
    assert depths[1][0] == 3 and depths[2][0] == 4 and depths[1][1] > 14
    (top / "ref.fa").write_text(">chr1\n" + "A" * 100 + "\n>chr2\n" + "acgt" * 20000 + "\n")
    MakeVcf(store.path, output=str(top / "out.vcf"), reference_file=str(top / "ref.fa")).run(spark)
    lines = (top / "out.vcf").read_text().splitlines()
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert lines[0] == "##fileformat=VCFv4.2" and len(body) == 1
    assert body[0][:5] == ["chr2", str(INSERTED_AT - 1), ".", "G", "<INS:ME:RTC>"] and ";PG=PARENT;PGTYPE=1;INTRONIC=HOST;" in body[0][7]
    assert [x for x in lines if x.startswith("#CHROM")][0].endswith("sample1\tsample2") and len(body[0]) == 11
    assert V.summary(spark.read.text(str(top / "out.vcf"))).first()["events"] == 1


def test_support_blacklist_and_empty_calls(spark, stores, tmp_path):
    top, paths = stores
    supported = MergeCall(paths, output=str(tmp_path / "a"), min_pts=5, genotype_support=3).run(spark)
    assert supported.read("retrocopy").count() == 1 and supported.read("cluster").filter("sid > 1 AND filter = 31").count() == 1
    (tmp_path / "bad.bed").write_text("chr2 49900 50100 region\n")
    barred = MergeCall(paths, output=str(tmp_path / "b"), min_pts=5, blacklist_region=str(tmp_path / "bad.bed")).run(spark)
    assert barred.read("retrocopy").count() == 0 and barred.read("genotype").count() == 0 and barred.read("overlapping_blacklist").count() >= 1
    none = MergeCall(paths, output=str(tmp_path / "c"), min_pts=5, blacklist_chr=["2"]).run(spark)
    assert none.read("retrocopy").count() == 0


def test_all_reads_of_a_large_sample_are_stored(spark, tmp_path):
    """Wide rows in many partitions, under the session's own adaptive plans."""
    (tmp_path / "genes.gtf").write_text(GTF)
    seq, qual = "ACGT" * 25, "I" * 100
    with open(tmp_path / "s.sam", "w") as out:
        for k in range(60_000):
            out.write(f"r{k}\t97\t1\t{1000 + k}\t40\t100M\t2\t{5000 + k}\t0\t{seq}\t{qual}\nr{k}\t145\t2\t{5000 + k}\t40\t100M\t1\t{1000 + k}\t0\t{seq}\t{qual}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        store = ProcessSample(str(tmp_path / "genes.gtf"), [str(tmp_path / "s.sam")], output=str(tmp_path / "s.store"), quiet=True).run(spark)
        ids = store.read("alignment").agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(ids) == (120_000, 120_000, 1, 120_000)


def test_sources_keep_their_files_apart(spark, tmp_path):
    rows = [("r1", 99, "chr1", 10, 20, "4M", "chr1", 60, "ACGT")]
    (tmp_path / "a b+%41.bam").write_bytes(bam.encoded(rows, ["chr1"]))
    (tmp_path / "plain.sam").write_text("r2\t99\tchr1\t5\t20\t4M\t=\t60\t0\tACGT\tIIII\n")
    got = read_sources(spark, [(7, str(tmp_path / "plain.sam")), (9, str(tmp_path / "a b+%41.bam")), (11, str(tmp_path / "plain.sam"))]).collect()
    assert sorted((r["source_id"], r["qname"]) for r in got) == [(7, "r2"), (9, "r1"), (11, "r2")]
    with pytest.raises(ValueError, match="CRAM"):
        read_sources(spark, [(1, "x.cram")])


def test_files_of_the_stages(spark, stores, tmp_path):
    """A compressed variant file, the log with the options' echo, lists of stores, and stages that stop early."""
    _, paths = stores
    (tmp_path / "stores.txt").write_text("\n".join(paths))
    step = MergeCall(input_file=str(tmp_path / "stores.txt"), output_dir=str(tmp_path), prefix="both", min_pts=5, log_file=str(tmp_path / "log"), quiet=True)
    store = step.run(spark)
    assert store.path == f"{tmp_path}/both.store" and store.read("retrocopy").count() == 1
    assert MakeVcf(store.path, output=f"{tmp_path}/x.vcf.gz", quiet=True).run(spark) == f"{tmp_path}/x.vcf.gz"
    with gzip.open(tmp_path / "x.vcf.gz", "rt") as text:
        assert sum(not x.startswith("#") for x in text) == 1
    none = MergeCall(paths, output=str(tmp_path / "none"), min_pts=500, quiet=True, log_file=str(tmp_path / "log2")).run(spark)
    assert none.read("genotype").count() == 0
    assert "--min-pts=5 " in (tmp_path / "log").read_text() + " " and "no cluster is left" in (tmp_path / "log2").read_text()


def test_union_keeps_exons_once_and_moves_ids(spark, stores):
    _, paths = stores
    names = ("batch", "source", "exon", "alignment", "overlapping")
    opened = [Workspace.open(spark, p) for p in paths]
    both = P.union_stores({n: Workspace.read_together(opened, n) for n in names})
    assert both["exon"].count() == 4 and both["source"].count() == 2 and both["alignment"].select("id").distinct().count() == both["alignment"].count()
    hits = both["overlapping"].join(both["exon"].withColumnRenamed("id", "exon_id").select("exon_id", "ense"), "exon_id")
    assert {r["ense"] for r in hits.collect()} == {"X1", "X2"}


def test_store_versions_and_schemas(spark, tmp_path):
    store = Workspace.create(spark, str(tmp_path / "s"))
    assert all(store.read(n).schema.fieldNames() == s.fieldNames() and store.read(n).count() == 0 for n, s in TABLES.items())
    spark.createDataFrame([(VERSION[0], VERSION[1] + 1)], "major_version int, minor_version int").write.mode("overwrite").parquet(f"{store.path}/schema")
    with pytest.raises(ValueError, match="version"):
        Workspace.open(spark, store.path)
    with pytest.raises(FileNotFoundError):
        Workspace.open(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(
    "stage",
    [
        ProcessSample("", ["a"]),
        ProcessSample("g"),
        ProcessSample("g", ["a"], max_base_freq=0.25),
        ProcessSample("g", ["a"], exon_frac=0.0),
        ProcessSample("g", ["a"], reciprocal=True, exon_frac=0.5, alignment_frac=0.5),
        ProcessSample("g", ["a"], reciprocal=True),
        MergeCall([]),
        MergeCall(["a"], min_pts=2),
        MergeCall(["a"], epsilon=-1),
        MakeVcf("a", orientation_error=2),
    ],
)
def test_bad_options_are_refused(stage):
    with pytest.raises(ValueError, match=r".+"):
        stage.validate()


def test_command_line_options():
    stage = stage_of(["mc", "a", "b", "--min-pts", "7", "--blacklist-chr", "chrM", "--blacklist-chr", "Y", "--gff-soft-attribute", "tag=x", "--in-place"])
    assert (stage.stores, stage.min_pts, stage.blacklist_chr, stage.gff_soft_attributes, stage.in_place) == (["a", "b"], 7, ["chrM", "Y"], [("tag", "x")], True)
    assert stage_of(["vcf", "s", "--near-gene-dist", "5"]).near_gene_dist == 5
    assert stage_of(["ps", "x.sam", "--annotation-file", "g", "--deduplicate"]).deduplicate


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sam").write_text(sample(1))
    for new in (None, sample(2)):
        if new:
            (tmp_path / "in/b.sam").write_text(new)
        stream_fragments(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 2 * (14 * 2 + 4 * 3) and rows.select("batch").distinct().count() == 2
