"""From reads to typed alignments: fragment filter, exon overlaps, duplicates, and the union of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import reads as R
from spanloom.operators.intervals import overlap_join
from spanloom.schema import ReadType
from spanloom.session import checkpointed


def fragment_filter(reads: DataFrame, max_distance: int = 10000, min_mapq: int = 8, max_base_freq: float | None = None) -> DataFrame:
    """All reads of the fragments whose reads are all accepted and at least one of them is abnormal; adds type.

    A fragment is the reads of one name in one source, wherever they stand.
    One shuffle, on (source_id, qname).
    """
    seq = "seq" if "seq" in reads.columns else None
    fragment = Window.partitionBy("source_id", "qname")
    marked = (
        reads.withColumn("_ok", R.accepted(min_mapq, max_base_freq, seq))
        .withColumn("type", R.type_bits(max_distance).cast("int"))
        .withColumn("_all", F.min("_ok").over(fragment))
        .withColumn("_any", F.max("type").over(fragment))
    )
    return marked.filter(F.col("_all") & (F.col("_any") != 0)).drop("_ok", "_all", "_any")


def exon_overlaps(alignments: DataFrame, exons: DataFrame, exon_fraction: float | None = None, alignment_fraction: float | None = None, either: bool = False) -> DataFrame:
    """(exon_id, alignment_id, pos, len) of each read and exon that overlap enough."""
    reads = alignments.select(F.col("id").alias("alignment_id"), F.col("chr").alias("_c1"), F.col("pos").alias("_l1"), R.end_position().alias("_h1"))
    genes = exons.select(F.col("id").alias("exon_id"), F.col("chr").alias("_c2"), F.col("start").alias("_l2"), F.col("end").alias("_h2"))
    found = overlap_join(reads, genes, ("_c1", "_l1", "_h1"), ("_c2", "_l2", "_h2"), alignment_fraction, exon_fraction, either)
    return found.select("exon_id", "alignment_id", F.col("overlap_pos").alias("pos"), F.col("overlap_len").alias("len"))


def mark_exonic(alignments: DataFrame, overlapping: DataFrame) -> DataFrame:
    """Adds the EXONIC bit to the reads that overlap an exon."""
    hit = overlapping.select(F.col("alignment_id").alias("_hit")).distinct()
    joined = alignments.join(hit, F.col("id") == F.col("_hit"), "left")
    return joined.withColumn("type", F.col("type").bitwiseOR(F.when(F.col("_hit").isNotNull(), int(ReadType.EXONIC)).otherwise(0)).cast("int")).drop("_hit")


def duplicate_fragments(alignments: DataFrame) -> DataFrame:
    """(qname, source_id) of the fragments that repeat another one.

    Reads of different names with the same own and mate position make a run,
    whose first name is the original. A fragment in several runs is judged by
    the first of them.
    """
    place = ["source_id", "chr", "pos", "chr_next", "pos_next"]
    named = alignments.select("qname", *place).distinct()
    run = Window.partitionBy(*place)
    runs = named.withColumn("_first", F.min("qname").over(run)).withColumn("_last", F.max("qname").over(run)).filter("_first <> _last")
    judged = runs.groupBy("source_id", "qname").agg(F.min_by(F.col("qname") == F.col("_first"), F.struct("chr", "pos", "chr_next", "pos_next")).alias("original"))
    return judged.filter("NOT original").select("qname", "source_id")


def drop_duplicates(alignments: DataFrame) -> DataFrame:
    """Sets the type of duplicate fragments' reads to NONE."""
    twins = duplicate_fragments(alignments).select(F.col("qname").alias("_q"), F.col("source_id").alias("_s"))
    joined = alignments.join(twins, (F.col("qname") == F.col("_q")) & (F.col("source_id") == F.col("_s")), "left")
    return joined.withColumn("type", F.when(F.col("_q").isNotNull(), int(ReadType.NONE)).otherwise(F.col("type"))).drop("_q", "_s")


def strided_ids(rows: DataFrame, ordinal: int, step: int, order: list[str]) -> DataFrame:
    """Ids ordinal, ordinal + step and so on, in the given order, without one task that sorts all rows.

    Rows are range-partitioned, sorted and written once together with their
    partition's number and their place in it, so that what the partitions'
    counts are of is what is numbered, however a plan reads it. Rows that agree
    in all of ``order`` are numbered in any order.
    """
    at = F.monotonically_increasing_id()
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND((1 << 33) - 1)))
    # One row a partition, so the ordered window and the broadcast are small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").count().select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    joined = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p"), "left")
    return joined.withColumn("id", (F.col("_offset") + F.col("_at")) * step + ordinal).drop("_part", "_p", "_at", "_offset")


def union_stores(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One store of several, whose tables are given together, with the number of each row's store as ``_store``.

    Ids are shifted past those of the stores before, all from one aggregation;
    exons are one by their identifier ``ense``, the first store's.
    """
    kinds = ("batch", "source", "alignment")
    ids = tables["batch"].select("_store", F.lit("batch").alias("_table"), F.col("id").cast("long"))
    for name in kinds[1:]:
        ids = ids.unionByName(tables[name].select("_store", F.lit(name).alias("_table"), F.col("id").cast("long")))
    largest = ids.groupBy("_store").pivot("_table", list(kinds)).agg(F.max("id"))
    # One row a store, so the ordered window and the broadcasts are small.
    before = Window.orderBy("_store").rowsBetween(Window.unboundedPreceding, -1)
    shift = checkpointed(largest.select("_store", *(F.coalesce(F.sum(F.coalesce(n, F.lit(0))).over(before), F.lit(0)).alias(f"_{n}") for n in kinds)))

    def moved(name: str, columns: dict[str, str]) -> DataFrame:
        rows = tables[name].join(F.broadcast(shift), "_store")
        return rows.withColumns({c: F.col(c) + F.col(f"_{by}") for c, by in columns.items()}).drop("_store", "_batch", "_source", "_alignment")

    out = {
        "batch": moved("batch", {"id": "batch"}),
        "source": moved("source", {"id": "source", "batch_id": "batch"}),
        "alignment": moved("alignment", {"id": "alignment", "source_id": "source"}),
    }
    columns = [c for c in tables["exon"].columns if c not in ("_store", "ense")]
    first = tables["exon"].groupBy("ense").agg(F.min_by(F.struct("_store", *columns), F.struct("_store", "id")).alias("_first"))
    found = first.select("ense", F.col("_first._store").alias("_store"), *(F.col(f"_first.{c}").alias("_id" if c == "id" else c) for c in columns))
    out["exon"] = strided_ids(found, 1, 1, ["_store", "_id"]).drop("_store", "_id")
    names = tables["exon"].select("_store", F.col("id").alias("exon_id"), "ense")
    hits = tables["overlapping"].join(names, ["_store", "exon_id"]).join(F.broadcast(shift), "_store")
    numbered = out["exon"].select("ense", F.col("id").alias("exon_id"))
    out["overlapping"] = hits.drop("exon_id").join(numbered, "ense").select("exon_id", (F.col("alignment_id") + F.col("_alignment")).alias("alignment_id"), "pos", "len")
    return out
