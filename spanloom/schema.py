"""Tables and enumerations of the insertion-discovery store."""

from __future__ import annotations

from enum import IntEnum, IntFlag

from pyspark.sql import types as T

#: Stores are opened only if written with the same version.
VERSION = (0, 12)


class ReadType(IntFlag):
    NONE = 0
    DISTANCE = 1
    CHROMOSOME = 2
    SUPPLEMENTARY = 4
    EXONIC = 8


class ClusterFilter(IntFlag):
    NONE = 1
    CHR = 2
    DIST = 4
    REGION = 8
    SUPPORT = 16


PASSING = 31


class Label(IntEnum):
    UNDEFINED = 0
    NOISE = 1
    REACHABLE = 2
    CORE = 3


class Level(IntFlag):
    PASS = 1
    OVERLAPPED_PARENTALS = 2
    NEAR_PARENTALS = 4
    HOTSPOT = 8
    AMBIGUOUS = 16


class PointType(IntEnum):
    WINDOW_MEAN = 1
    SUPPLEMENTARY_MODE = 2


class Flag(IntFlag):
    """Bits of an alignment's flag."""

    PAIRED = 0x1
    PROPER = 0x2
    UNMAPPED = 0x4
    MATE_UNMAPPED = 0x8
    DUPLICATE = 0x400
    SUPPLEMENTARY = 0x800


def _table(spec: str) -> T.StructType:
    kinds = {"i": T.IntegerType(), "l": T.LongType(), "s": T.StringType(), "d": T.DoubleType()}
    fields = (f.split(":") for f in spec.split())
    return T.StructType([T.StructField(n, kinds[k[0]], k.endswith("?")) for n, k in fields])


TABLES: dict[str, T.StructType] = {
    "batch": _table("id:i timestamp:s"),
    "source": _table("id:i batch_id:i path:s"),
    "exon": _table("id:l gene_name:s chr:s start:l end:l strand:s ensg:s ense:s"),
    "alignment": _table("id:l qname:s flag:i chr:s pos:l mapq:i cigar:s qlen:i? rlen:i? chr_next:s pos_next:l type:i? source_id:i"),
    "overlapping": _table("exon_id:l alignment_id:l pos:l len:l"),
    "cluster": _table("id:l sid:i chr:s start:l end:l gene_name:s filter:i"),
    "clustering": _table("cluster_id:l cluster_sid:i alignment_id:l label:i neighbors:i"),
    "blacklist": _table("id:l name:s chr:s start:l end:l"),
    "overlapping_blacklist": _table("blacklist_id:l cluster_id:l cluster_sid:i pos:l len:l"),
    "retrocopy": _table("id:l chr:s window_start:l window_end:l parental_gene_name:s level:i insertion_point:l? insertion_point_type:i? orientation_rho:d? orientation_p_value:d?"),
    "cluster_merging": _table("retrocopy_id:l cluster_id:l cluster_sid:i"),
    "genotype": _table("source_id:i retrocopy_id:l reference_depth:i alternate_depth:i ho_ref_likelihood:d he_likelihood:d ho_alt_likelihood:d"),
}
