"""Variant text: header, body and the summary of finished files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import statistics as S
from spanloom.operators.clusters import gene_extents
from spanloom.operators.events import depths, hosts
from spanloom.schema import Level, PointType

# The declarations of the format's fields.
DECLARATIONS = (
    ("INFO", "CIPOS", "2", "Integer", "Confidence interval around POS for imprecise variants"),
    ("INFO", "DP", "1", "Integer", "Read Depth of segment containing breakpoint"),
    ("INFO", "EXONIC", "1", "String", "Exon IDs separated by '/' for intragenic retrocopy"),
    ("INFO", "IMPRECISE", "0", "Flag", "Imprecise structural variation"),
    ("INFO", "INTRONIC", "1", "String", "Intron IDs separated by '/' for intragenic retrocopy"),
    ("INFO", "NEAR", "1", "String", "Near Gene IDs separated by '/' for intergenic retrocopy"),
    ("INFO", "ORHO", "1", "Float", "Spearman's rho to detect the polarity"),
    ("INFO", "PG", "1", "String", "Parental Gene IDs separated by '/'"),
    ("INFO", "PGTYPE", "1", "String", "Provides information about parental gene: 1 = Single parental gene; 2 = Overlapped parental genes; 4 = Near parental genes; 8 = Hotspot - Multiple parental genes with retrocopy at the same segment"),
    ("INFO", "POLARITY", "1", "Character", "Mobile element polarity (+/-)"),
    ("INFO", "SR", "1", "Integer", "Total number of SRs at the estimated breakpoint for this site"),
    ("INFO", "SVTYPE", "1", "String", "Type of structural variant"),
    ("ALT", "INS:ME:RTC", None, None, "Insertion of a Retrocopy"),
    ("FORMAT", "DP2", "2", "Integer", "Read depth at this position for this sample separated by comma: The former is reference depth and the last is alternate depth"),
    ("FORMAT", "GT", "1", "String", "Genotype"),
    ("FORMAT", "GL", "G", "Float", "Genotype likelihood"),
)
COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def header(samples: Sequence[str], reference: str | None = None, contigs: Sequence[tuple[str, int]] = (), program: str = "spanloom", when: datetime | None = None) -> list[str]:
    """The header's lines; contigs are sorted by name."""
    stamp = (when or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    out = ["##fileformat=VCFv4.2", f"##fileDate={stamp}", f"##source={program}"]
    if reference is not None:
        out.append(f"##reference=file://{reference}")
        out += [f"##contig=<ID={name},length={length}>" for name, length in sorted(contigs)]
    for kind, name, number, value, text in DECLARATIONS:
        middle = "" if number is None else f",Number={number},Type={value}"
        out.append(f'##{kind}=<ID={name}{middle},Description="{text}">')
    return [*out, "#" + "\t".join([*COLUMNS, *samples])]


def info(orientation_error: float = 0.05) -> Column:
    """The INFO text of a row of ``described``."""
    imprecise = F.when(F.col("insertion_point_type") == int(PointType.WINDOW_MEAN), F.format_string(";IMPRECISE;CIPOS=%d,%d", F.col("window_start") - F.col("insertion_point"), F.col("window_end") - F.col("insertion_point")))
    rho = F.coalesce("orientation_rho", F.lit(0.0))
    plus = (rho >= 0) == (F.col("strand") == "+")
    polar = F.when((F.col("level") == int(Level.PASS)) & (F.col("orientation_p_value") <= orientation_error), F.concat(F.format_string(";ORHO=%.6f;POLARITY=", rho), F.when(plus, "+").otherwise("-")))
    parents = F.format_string(";PG=%s;PGTYPE=%d", F.col("parental_gene_name"), F.col("level"))
    exonic = F.when(F.col("exonic").isNotNull(), F.concat(F.lit(";EXONIC="), F.col("exonic")))
    intronic = F.when(~F.col("exonic").eqNullSafe(F.col("intragenic")), F.concat(F.lit(";INTRONIC="), F.col("intragenic")))
    place = F.when(F.col("intragenic").isNotNull(), F.concat(F.coalesce(exonic, F.lit("")), F.coalesce(intronic, F.lit("")))).when(F.col("near").isNotNull(), F.concat(F.lit(";NEAR="), F.col("near")))
    depth = F.format_string(";DP=%d", F.col("depth"))
    split = F.when(F.col("insertion_point_type") == int(PointType.SUPPLEMENTARY_MODE), F.format_string(";SR=%d", F.col("split_reads")))
    return F.concat(F.lit("SVTYPE=INS"), *(F.coalesce(x, F.lit("")) for x in (imprecise, polar, parents, place, depth, split)))


def described(retrocopies: DataFrame, exons: DataFrame, merging: DataFrame, clustering: DataFrame, alignments: DataFrame, near_distance: int = 10000, symmetric: bool = False) -> DataFrame:
    """Events with their strand, hosts and depths; an event without a clustered read has no row."""
    strands = gene_extents(exons).select(F.col("gene_name").alias("parental_gene_name"), F.col("strand").alias("_strand"))
    around = hosts(retrocopies, exons, near_distance, symmetric).withColumnRenamed("rid", "id")
    seen = depths(retrocopies, merging, clustering, alignments).withColumnRenamed("rid", "id")
    return retrocopies.join(strands, "parental_gene_name", "left").join(seen, "id").join(around, "id", "left").withColumn("strand", F.coalesce("_strand", F.lit("?"))).drop("_strand")


def sample_text() -> Column:
    """One sample's column of a genotype row."""
    ref, het, alt = (F.col(f"{x}_likelihood") for x in ("ho_ref", "he", "ho_alt"))
    likelihoods = F.concat_ws(",", *(S.general_format(x) for x in (ref, het, alt)))
    return F.concat(S.call(ref, het, alt), F.lit(":"), F.col("reference_depth").cast("string"), F.lit(","), F.col("alternate_depth").cast("string"), F.lit(":"), likelihoods)


def reference_bases(events: DataFrame, contigs: DataFrame | None) -> DataFrame:
    """Adds vcf_pos, the base before the insertion, and ref, which is N where the reference has none."""
    placed = events.withColumn("vcf_pos", F.when(F.col("insertion_point") == 1, F.col("insertion_point")).otherwise(F.col("insertion_point") - 1))
    if contigs is None:
        return placed.withColumn("ref", F.lit("N"))
    names = contigs.select(F.col("contig").alias("_contig"), "sequence")
    joined = placed.join(names, F.col("chr") == F.col("_contig"), "left")
    base = F.upper(F.substring(F.col("sequence"), F.col("vcf_pos").cast("int"), F.lit(1)))
    return joined.withColumn("ref", F.when(base != "", base).otherwise("N")).drop("_contig", "sequence")


def body(events: DataFrame, genotype: DataFrame, sources: Sequence[int], contigs: DataFrame | None = None, orientation_error: float = 0.05) -> DataFrame:
    """(chr, insertion_point, line) of each described event, samples in the order of their ids."""
    texts = genotype.select("retrocopy_id", "source_id", sample_text().alias("text"))
    wide = texts.groupBy("retrocopy_id").pivot("source_id", sorted(sources)).agg(F.first("text"))
    placed = reference_bases(events, contigs).join(wide, F.col("id") == F.col("retrocopy_id"))
    cells = [F.col("chr"), F.col("vcf_pos").cast("string"), F.lit("."), F.col("ref"), F.lit("<INS:ME:RTC>"), F.lit("."), F.lit("PASS"), info(orientation_error), F.lit("GT:DP2:GL")]
    return placed.select("chr", "insertion_point", F.concat_ws("\t", *cells, *(F.col(str(s)) for s in sorted(sources))).alias("line"))


def write(path: str, head: list[str], rows: DataFrame) -> None:
    """One file of header and sorted body, compressed if its name ends in ``.gz``; events are few against reads.

    The text is written to a folder beside it, whose one part then takes the
    file's name.
    """
    spark = rows.sparkSession
    top = spark.createDataFrame([("", k - len(head), x) for k, x in enumerate(head)], "chr string, insertion_point long, line string")
    ordered = top.unionByName(rows.select("chr", F.col("insertion_point").cast("long").alias("insertion_point"), "line")).orderBy("chr", "insertion_point", "line")
    parts = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    ordered.coalesce(1).select("line").write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(parts.toString())
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(parts) if f.getPath().getName().startswith("part-")]
    files.delete(target, True)
    if not files.rename(found[0], target):
        raise OSError(f"{found[0]} cannot be renamed to {path}")
    files.delete(parts, True)


def summary(text: DataFrame) -> DataFrame:
    """(events, shared, genotypes, homozygous_ratio) of the passing lines on chromosomes with names of standard length."""
    cut = F.split("value", "\t")
    rows = text.filter(~F.col("value").startswith("#")).select(cut[0].alias("chr"), cut[6].alias("filter"), F.transform(F.slice(cut, 10, F.greatest(F.size(cut) - 9, F.lit(0))), lambda x: F.substring(x, 1, 3)).alias("calls"))
    kept = rows.filter((F.col("filter") == "PASS") & (F.length("chr") <= 5))
    carried = F.size(F.filter("calls", lambda x: x.isin("0/1", "1/1")))
    double = F.size(F.filter("calls", lambda x: x == "1/1"))
    sums = kept.select(carried.alias("carried"), double.alias("double")).agg(
        F.count("*").alias("events"), F.count_if(F.col("carried") > 1).alias("shared"), F.coalesce(F.sum("carried"), F.lit(0)).alias("genotypes"), F.sum("double").alias("_double")
    )
    return sums.withColumn("homozygous_ratio", F.try_divide(F.col("_double"), F.col("genotypes"))).drop("_double")
