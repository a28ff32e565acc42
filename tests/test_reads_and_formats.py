"""Readers, read expressions and the fragment filter."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import containers as K
from spanloom.functions import reads as R
from spanloom.operators import fragments as P
from spanloom.sources import bam
from spanloom.sources import text_formats as T

SAM = """@HD\tVN:1.0\tSO:queryname
@SQ\tSN:chr1\tLN:100000
gone\t109\tchr1\t10\t20\t10M\t=\t10\t0\tACGTACGTAC\t*
gone\t157\tchr1\t10\t20\t10M\t=\t10\t0\tACGTACGTAC\t*
plain\t99\tchr1\t10\t20\t10M\t=\t100\t90\tACGTACGTAC\t*
plain\t147\tchr1\t100\t20\t10M\t=\t10\t-90\tACGTACGTAC\t*
cross\t97\tchr1\t50\t20\t10M\tchr2\t20000\t0\tACGTACGTAC\t*
cross\t145\tchr2\t20000\t20\t10M\tchr1\t50\t0\tACGTACGTAC\t*
far\t97\tchr1\t20\t20\t10M\t=\t20000\t0\tACGTACGTAC\t*
far\t145\tchr1\t20000\t20\t10M\t=\t20\t0\tACGTACGTAC\t*
split\t99\tchr1\t30\t20\t10M\t=\t60\t0\tACGTACGTAC\t*
split\t147\tchr1\t60\t20\t5M5S\t=\t30\t0\tACGTACGTAC\t*
split\t2195\tchr2\t19995\t20\t5H5M\tchr1\t30\t0\tACGTA\t*
"""
GTF = """#!header
chr1\tx\tgene\t45\t65\t.\t+\t.\tgene_name "g1"; gene_id "E1";
chr1\tx\texon\t45\t65\t.\t+\t.\tgene_name "g1"; gene_id "E1"; transcript_id "T1"; transcript_type "protein_coding"; exon_id "X1";
chr1\tx\texon\t45\t65\t.\t+\t.\tgene_name "g1"; gene_id "E1"; transcript_type "protein_coding"; exon_id "X1";
2\tx\texon\t19990\t20050\t.\t-\t.\tgene_name "g2"; gene_id "E2"; transcript_type "protein_coding"; exon_id "X2";
2\tx\texon\t1\t9\t.\t-\t.\tgene_name "g3"; gene_id "E3"; transcript_type "lincRNA"; exon_id "X3";
"""


def text(spark, value):
    return spark.createDataFrame([(x,) for x in value.splitlines()], "value string")


@pytest.mark.parametrize("shuffled", [False, True])
def test_fragments_of_three_kinds_are_kept_and_marked(spark, shuffled):
    body = SAM.splitlines()
    body = body if not shuffled else [x for x in body if x[0] != "@"][::-1]
    reads = T.parse_sam(text(spark, "\n".join(body))).withColumn("source_id", F.lit(1)).withColumn("id", F.xxhash64("qname", "flag"))
    kept = P.fragment_filter(reads, 10000, 0, 1.0)
    exons = T.exons_of(T.parse_gff(text(spark, GTF))).withColumn("id", F.xxhash64("ense"))
    assert exons.count() == 2
    typed = P.mark_exonic(kept, P.exon_overlaps(kept, exons))
    got = sorted((r["qname"], r["chr"], r["pos"], r["type"]) for r in typed.collect())
    assert got == [("cross", "chr1", 50, 10), ("cross", "chr2", 20000, 10), ("far", "chr1", 20, 1), ("far", "chr1", 20000, 1), ("split", "chr1", 30, 0), ("split", "chr1", 60, 8), ("split", "chr2", 19995, 14)]


def test_base_frequency_limits(spark):
    rows = spark.createDataFrame([("AAAC", True), ("AACC", False), ("", False), ("*", False), ("NNNN", True), ("acgt", False), (None, False)], "seq string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", R.over_frequent_base("seq", 0.7)).collect())


@pytest.mark.parametrize(("raw", "name"), [("10", "chr10"), ("chrMT", "chrM"), ("CHr11", "chr11"), ("Chrx", "chrX"), ("chr21", "chr21"), ("ponga", "ponga"), ("", "")])
def test_chromosome_names(spark, raw, name):
    assert spark.range(1).select(R.standard_chromosome(F.lit(raw)).alias("c")).first()["c"] == name


@pytest.mark.parametrize(("cigar", "query", "reference"), [("10M", 10, 10), ("5M5S", 10, 5), ("5H5M", 5, 5), ("3M2D4N1I2=1X", 7, 12), ("*", 0, 0)])
def test_cigar_lengths(spark, cigar, query, reference):
    row = spark.createDataFrame([(cigar,)], "cigar string").select(R.query_length().alias("q"), R.reference_length().alias("r")).first()
    assert (row["q"], row["r"]) == (query, reference)


@pytest.mark.parametrize(("cigar", "clip"), [("70M30S", 170), ("70M30H", 170), ("30S70M", 100), ("30h70m", 100), ("100M", None)])
def test_clip_positions(spark, cigar, clip):
    row = spark.createDataFrame([(cigar, 100, 70)], "cigar string, pos long, rlen int").select(R.clip_position().alias("c")).first()
    assert row["c"] == clip


def test_gff_attributes_and_filter(spark):
    lines = 'c\ts\tgene\t1\t2\t.\t+\t.\ttag=one;tag "two";k "a b" ;gene_type=processed_pseudogene\n# comment inside\nc\ts\tgene\t5\t6\t0.5\t-\t2\ttag "retrogene";k=v'
    rows = T.parse_gff(text(spark, lines))
    first = rows.orderBy("start").select("*", T.attribute("tag").alias("tag"), T.attribute("k").alias("k"), T.attribute("no").alias("no")).first()
    assert (first["tag"], first["k"], first["no"], first["score"], first["frame"]) == ("one", "a b", None, -1.0, -1) and len(first["attributes"]) == 4
    assert rows.filter(T.gff_filter("gene", {"k": "."}, [("gene_type", "pseudo"), ("tag", "retrogene")])).count() == 2
    assert rows.filter(T.gff_filter("gene", {"tag": "two"})).count() == 0 and rows.filter(T.gff_filter("exon")).count() == 0


@pytest.mark.parametrize("line", ["c\ts\tgene\t1\t2\t.\t+", "c\ts\tgene\t1", "c\t\tgene\t1\t2\t.\t+\t.\tk=v"])
def test_incomplete_gff_is_an_error(spark, line):
    with pytest.raises(Exception, match="missing field"):
        T.parse_gff(text(spark, line)).collect()


def test_gff_attributes_may_be_absent_but_not_empty(spark):
    assert T.parse_gff(text(spark, "c\ts\tgene\t1\t2\t.\t+\t.")).first()["attributes"] == []
    for attributes in ("tag", "tag=x; k ", "k="):
        with pytest.raises(Exception, match="without a value"):
            T.parse_gff(text(spark, f"c\ts\tgene\t1\t2\t.\t+\t.\t{attributes}")).collect()


def test_the_first_exon_of_the_file_holds(spark, tmp_path):
    row = 'chr{c}\tx\texon\t{s}\t{e}\t.\t+\t.\tgene_name "G{c}"; gene_id "I"; transcript_type "protein_coding"; exon_id "X";\n'
    (tmp_path / "g.gtf").write_text("".join(row.format(c=c, s=s, e=s + 9) for c, s in ((9, 500), (1, 100), (1, 50))))
    got = T.exons_of(T.read_gff(spark, str(tmp_path / "g.gtf"))).collect()
    assert [(r["chr"], r["start"], r["gene_name"]) for r in got] == [("chr9", 500, "G9")]


@pytest.mark.parametrize(("name", "is_gff"), [("a.gff", True), ("a.gff3", True), ("a.gtf.gz", True), ("a.gtf.gz.gz", True), ("a.bed", False), ("gff", False), ("a.gtf.txt", False)])
def test_annotation_file_names(name, is_gff):
    assert T.looks_like_gff(name) is is_gff


def test_bed_of_three_to_twelve_fields(spark):
    lines = "track name=x\nbrowser position\n\nchr1 1 1000\nchr2\t5\t9\tname\t0\t+\nchr3\t1\t9\tn\t2000\t-\t2\t3\t1,2,3,4\t2\t3,4,5\t0,5"
    got = T.parse_bed(text(spark, lines)).orderBy("chrom").collect()
    assert [(r["chrom"], r["start"], r["end"], r["name"]) for r in got] == [("chr1", 1, 1000, None), ("chr2", 5, 9, "name"), ("chr3", 1, 9, "n")]
    assert got[2]["block_sizes"] == [3, 4, 5] and got[2]["rgb"] == [1, 2, 3, 4]
    with pytest.raises(Exception, match="bad BED line"):
        T.parse_bed(text(spark, "chr1 1")).collect()


def test_fasta_with_comments_and_long_lines(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(";top\n>c1|more\nACGT\n;inner\nacgt\n>c2 words\n" + "G" * 5000 + "\n>c3\nAC\nGT")
    got = {r["contig"]: (r["sequence"], r["length"]) for r in T.read_fasta(spark, str(path)).collect()}
    assert got == {"c1": ("ACGTacgt", 8), "c2": ("G" * 5000, 5000), "c3": ("ACGT", 4)}


def test_gzip_lists_and_sort_order(spark, tmp_path):
    with gzip.open(tmp_path / "list.gz", "wt") as out:
        out.write("  a.sam \n\n b.sam\n")
    assert sorted(T.file_list(spark, str(tmp_path / "list.gz"))) == ["a.sam", "b.sam"]
    assert T.sorted_order("@HD\tVN:1.6\tSO:queryname", "queryname") and not T.sorted_order("@SQ\tSN:x", "queryname")


def some_reads(n):
    draw, names = random.Random(n), ["chr1", "chr2", "contig3"]
    return [(f"r{k}", 99, draw.choice([*names, "*"]), k + 1, 30, "100M5S", draw.choice(names), k + 200, "".join(draw.choice("ACGTN") for _ in range(105))) for k in range(n)], names


BAM_FIELDS = ("qname", "flag", "chr", "pos", "mapq", "cigar", "chr_next", "pos_next", "seq")


@pytest.mark.parametrize("split", ["128m", "20000", "1500"])
def test_binary_alignments_do_not_depend_on_splits(spark, tmp_path, split):
    rows, names = some_reads(3000)
    (tmp_path / "x.bam").write_bytes(bam.encoded(rows, names, block=2000))
    (tmp_path / "none.bam").write_bytes(bam.encoded([], names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = bam.read_bam(spark, [str(tmp_path / "x.bam"), str(tmp_path / "none.bam")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(tuple(r[c] for c in BAM_FIELDS) for r in got) == sorted(rows)
    assert {(r["rlen"], r["qlen"]) for r in got} == {(100, 105)}


def test_damaged_binary_alignments_are_an_error(spark, tmp_path):
    rows, names = some_reads(50)
    whole = bam.encoded(rows, names)
    (tmp_path / "cut.bam").write_bytes(whole[:-40])
    with pytest.raises(Exception, match=r"cut short|within"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()
    with pytest.raises(ValueError, match="block"):
        list(bam.inflate(whole[:-30]))
    with pytest.raises(ValueError, match="not a binary"):
        bam.header(b"SAM text")


def test_windows_find_long_reads(spark, tmp_path):
    rows = [("r1", 99, "chr1", 10, 20, "3M1S", "chr1", 51, "ACGT"), ("r1", 147, "chr1", 100, 20, "3M1S", "chr1", 10, "ACGT"), ("long", 99, "chr1", 5, 20, "2M900000N2M", "chr1", 51, "ACGT"), ("other", 99, "chr2", 100, 20, "4M", "chr1", 51, "ACGT")]
    (tmp_path / "x.bam").write_bytes(bam.encoded(rows, ["chr1", "chr2"]))
    bam.write_columnar(bam.read_bam(spark, str(tmp_path / "x.bam")), str(tmp_path / "columns"))
    got = bam.read_window(spark, str(tmp_path / "columns"), "chr1", 101, 200)
    assert sorted(r["qname"] for r in got.collect()) == ["long", "r1"] and "end_pos" not in got.columns


def test_duplicates_keep_the_first_name(spark):
    rows = []
    for k, (name, source, pos) in enumerate([("id1", 1, 10), ("id2", 1, 10), ("id3", 2, 10), ("id4", 1, 50), ("id5", 1, 50), ("id5", 1, 50), ("id1", 1, 60), ("id0", 1, 60)]):
        rows.append((k, name, source, "chr1", pos, "chr2", 99, 2))
    frame = spark.createDataFrame(rows, "id long, qname string, source_id int, chr string, pos long, chr_next string, pos_next long, type int")
    assert sorted(r["qname"] for r in P.duplicate_fragments(frame).collect()) == ["id2", "id5"]
    assert {r["qname"] for r in P.drop_duplicates(frame).filter("type = 0").collect()} == {"id2", "id5"}


def test_strided_ids_are_gapless_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = P.strided_ids(rows, 3, 5, ["v"]).orderBy("v").collect()
    assert [r["id"] for r in got] == [3 + 5 * k for k in range(1000)]


def test_strided_ids_of_wide_rows_lose_none(spark):
    """The counts' branch is narrower than the rows', so an adaptive plan may cut the two differently."""
    wide = [F.repeat(F.sha2(F.col("id").cast("string"), 512), 3).alias(c) for c in ("a", "b")]
    rows = spark.range(0, 60_000, 1, 16).select(F.col("id").alias("key"), *wide)
    for settings in ({}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.shuffle.partitions": "64"}):
        before = {k: spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            got = P.strided_ids(rows, 1, 1, ["a", "key"]).agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("key")).first()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert tuple(got) == (60_000, 60_000, 1, 60_000, 60_000)


def test_array_and_map_functions(spark):
    row = spark.range(1).select(F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("x"), F.create_map(F.lit("k"), F.lit(1), F.lit("j"), F.lit(2)).alias("m"))
    got = row.select(
        K.find(F.col("x"), F.lit("b")), K.find(F.col("x"), F.lit("z")), K.remove(F.col("x"), F.lit("a")), K.remove(F.col("x"), F.lit("z")), K.remove_index(F.col("x"), F.lit(9)),
        K.append(F.col("x"), F.lit("c")), K.map_keys(F.col("m")), K.map_values(F.col("m")), K.map_keys(K.map_remove(F.col("m"), F.lit("k"))), K.map_values(K.map_insert(F.col("m"), F.lit("k"), F.lit(7))),
    ).first()
    assert list(got) == [1, None, ["b", "a"], ["a", "b", "a"], ["a", "b", "a"], ["a", "b", "a", "c"], ["j", "k"], [2, 1], ["j"], [2, 7]]
