"""Readers of annotation and alignment text: GTF/GFF3, BED, SAM, FASTA, lists of files.

All read lines with Spark's text source, which also opens gzip, and parse them
with built-in expressions, so parsing is distributed and filters reach it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import reads as R


class FormatError(ValueError):
    """A line that breaks its format."""


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value, line) of every line; gzip files are opened by their name.

    ``line`` orders the lines of a file: the start of the split that holds it,
    and a number that rises within a split.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"))
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r$", "").alias("value"), place.alias("line"))


def file_list(spark: SparkSession, path: str) -> list[str]:
    """The trimmed, non-empty lines of a file that lists files; such lists are short."""
    kept = lines(spark, path).select(F.trim("value").alias("value")).filter("value <> ''")
    return [r["value"] for r in kept.collect()]


def looks_like_gff(name: str) -> bool:
    return re.search(r"\.(gff3?|gtf)(\.gz)*$", name) is not None


def _checked(frame: DataFrame, ok: Column, what: str) -> DataFrame:
    """The rows, or an error with the first line that breaks the rule once the plan runs."""
    return frame.filter(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce("value", F.lit(""))))))


# -- GTF and GFF3 --


def parse_gff(text: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """seqname, source, feature, start, end, score, strand, frame, attributes (an ordered array of key and value).

    Keys and values part at the first blank or ``=``; values lose blanks, then
    quotes. Repeated keys stay. Eight fields are required, attributes are not;
    an attribute without a value is an error.
    """
    body = text.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cut = F.split("value", "\t")
    fields = [F.try_element_at(cut, F.lit(k)) for k in range(1, 10)]
    complete = fields[0].isNotNull()
    for f in fields[:8]:
        complete = complete & f.isNotNull() & (f != "")
    body = _checked(body, F.coalesce(complete, F.lit(False)), "missing field")
    pieces = F.filter(F.transform(F.split(F.coalesce(fields[8], F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    body = _checked(body, F.forall(pieces, lambda x: x.rlike(r"^[^ =]+[ =]+[^ =]")), "attribute without a value")
    number = lambda c: F.when(c == ".", -1).otherwise(c.try_cast("int"))
    pair = lambda x: F.struct(
        F.regexp_extract(x, r"^([^ =]+)", 1).alias("key"), F.btrim(F.btrim(F.regexp_extract(x, r"^[^ =]+[ =](.*)$", 1)), F.lit('"')).alias("value")
    )
    attributes = F.transform(pieces, pair)
    return body.select(
        *keep,
        fields[0].alias("seqname"),
        fields[1].alias("source"),
        fields[2].alias("feature"),
        fields[3].try_cast("long").alias("start"),
        fields[4].try_cast("long").alias("end"),
        F.when(fields[5] == ".", -1.0).otherwise(fields[5].try_cast("double")).alias("score"),
        fields[6].alias("strand"),
        number(fields[7]).alias("frame"),
        attributes.alias("attributes"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``parse_gff`` with ``line``, their order in the file."""
    return parse_gff(lines(spark, path), ("line",))


def attribute(key: str) -> Column:
    """The value of the first attribute with the key, or null."""
    return F.try_element_at(F.filter("attributes", lambda x: x["key"] == key), F.lit(1))["value"]


def gff_filter(feature: str | None = None, hard: dict[str, str] | None = None, soft: dict[str, str] | list[tuple[str, str]] | None = None) -> Column:
    """The feature, all hard and, if there are any, at least one soft attribute; patterns match anywhere in the value."""
    ok = F.lit(True) if feature is None else F.col("feature") == feature
    for key, pattern in (hard or {}).items():
        ok = ok & F.coalesce(attribute(key).rlike(pattern), F.lit(False))
    pairs = list(soft.items()) if isinstance(soft, dict) else list(soft or [])
    if pairs:
        some = F.lit(False)
        for key, pattern in pairs:
            some = some | F.coalesce(attribute(key).rlike(pattern), F.lit(False))
        ok = ok & some
    return ok


def exons_of(gff: DataFrame) -> DataFrame:
    """The exon table, without ids: exons of protein-coding transcripts, each identifier once.

    Of several rows with one identifier the first of the file holds; where
    rows have no ``line``, the first in order of their place.
    """
    kept = gff.filter(gff_filter("exon", {"transcript_type": "protein_coding"}))
    ordered = [c for c in ("line",) if c in gff.columns]
    rows = kept.select(*ordered, attribute("gene_name").alias("gene_name"), R.standard_chromosome("seqname").alias("chr"), "start", "end", "strand", attribute("gene_id").alias("ensg"), attribute("exon_id").alias("ense"))
    first = F.struct(*ordered, "chr", "start", "end", "gene_name")
    columns = ("gene_name", "chr", "start", "end", "strand", "ensg")
    return rows.filter("ense IS NOT NULL AND gene_name IS NOT NULL").groupBy("ense").agg(*(F.min_by(c, first).alias(c) for c in columns))


# -- BED --


def parse_bed(text: DataFrame) -> DataFrame:
    """chrom, start, end and up to nine more fields; start and end are taken as they stand."""
    head = F.col("value").rlike(r"^(browser|track)\b")
    body = text.filter(~head & (F.trim("value") != "") & ~F.col("value").startswith("#"))
    cut = F.split(F.trim("value"), r"[\t ]+")
    f = [F.try_element_at(cut, F.lit(k)) for k in range(1, 13)]
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    body = _checked(body, F.coalesce(f[2].isNotNull() & f[1].try_cast("long").isNotNull() & f[2].try_cast("long").isNotNull(), F.lit(False)), "bad BED line")
    return body.select(
        f[0].alias("chrom"),
        f[1].try_cast("long").alias("start"),
        f[2].try_cast("long").alias("end"),
        f[3].alias("name"),
        f[4].try_cast("int").alias("score"),
        f[5].alias("strand"),
        f[6].try_cast("long").alias("thick_start"),
        f[7].try_cast("long").alias("thick_end"),
        numbers(f[8]).alias("rgb"),
        f[9].try_cast("int").alias("block_count"),
        numbers(f[10]).alias("block_sizes"),
        numbers(f[11]).alias("block_starts"),
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(lines(spark, path))


def blacklist_regions(spark: SparkSession, path: str, feature: str = "gene", hard: dict[str, str] | None = None, soft: list[tuple[str, str]] | None = None) -> DataFrame:
    """(name, chr, start, end) from an annotation or a BED file, by the file's name."""
    if looks_like_gff(path):
        rows = read_gff(spark, path).filter(gff_filter(feature, hard, soft))
        return rows.select(F.coalesce(attribute("gene_name"), F.lit("blacklist")).alias("name"), R.standard_chromosome("seqname").alias("chr"), "start", "end")
    return read_bed(spark, path).select(F.coalesce("name", F.lit("blacklist")).alias("name"), R.standard_chromosome("chrom").alias("chr"), "start", "end")


# -- SAM --


def sorted_order(first_line: str, value: str) -> bool:
    """Whether a header's first line names this sort order."""
    found = re.match(r"@HD\s+VN:[\d.]+\s+SO:(\w+)", first_line)
    return found is not None and found[1] == value


def parse_sam(text: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alignment rows with standard chromosome names; positions are 1-based as in the text."""
    body = text.filter(~F.col("value").startswith("@") & (F.trim("value") != ""))
    f = F.split("value", "\t", 12)
    at = lambda k: F.try_element_at(f, F.lit(k))
    body = _checked(body, F.coalesce(at(11).isNotNull() & at(2).try_cast("int").isNotNull(), F.lit(False)), "bad alignment line")
    mate = F.when(at(7) == "=", at(3)).otherwise(at(7))
    cigar = at(6)
    return body.select(
        *keep,
        at(1).alias("qname"),
        at(2).try_cast("int").alias("flag"),
        R.standard_chromosome(at(3)).alias("chr"),
        at(4).try_cast("long").alias("pos"),
        at(5).try_cast("int").alias("mapq"),
        cigar.alias("cigar"),
        R.query_length(cigar).cast("int").alias("qlen"),
        R.reference_length(cigar).cast("int").alias("rlen"),
        R.standard_chromosome(mate).alias("chr_next"),
        at(8).try_cast("long").alias("pos_next"),
        at(10).alias("seq"),
    )


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments with the path of their file."""
    return parse_sam(lines(spark, path), ("path",))


# -- FASTA --


def parse_fasta(records: DataFrame) -> DataFrame:
    """(contig, sequence, length) from rows that hold one record each, as split at lines that start with ``>``.

    A contig is one value, so one of over 2 GB is out of reach.
    """
    plain = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"(?m)^;.*$\n?", "")
    rows = records.select(F.regexp_replace(plain, "^>", "").alias("value")).filter(F.trim(F.regexp_replace("value", "\n", "")) != "")
    rows = rows.select("value", F.regexp_extract("value", r"^([^ |\n\t]+)", 1).alias("contig"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"))
    rows = _checked(rows, (F.col("contig") != "") & (F.col("sequence") != ""), "contig without name or sequence")
    return rows.select("contig", "sequence", F.length("sequence").cast("long").alias("length"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))
