"""Expressions over one alignment record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.schema import Flag, ReadType


def flagged(flag: Column | str, bits: int) -> Column:
    """Whether any of the bits is set."""
    column = F.col(flag) if isinstance(flag, str) else flag
    return column.bitwiseAND(F.lit(int(bits))) != 0


def operations(cigar: Column | str, kinds: str) -> Column:
    """The summed lengths of a cigar's operations of the given kinds."""
    column = F.col(cigar) if isinstance(cigar, str) else cigar
    found = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, n: total + F.coalesce(n.try_cast("long"), F.lit(0)))


def reference_length(cigar: Column | str = "cigar") -> Column:
    return operations(cigar, "MDN=X")


def query_length(cigar: Column | str = "cigar") -> Column:
    return operations(cigar, "MIS=X")


def end_position(pos: str = "pos", rlen: str = "rlen") -> Column:
    """The last position, or the first one where nothing of the reference is covered."""
    return F.when(F.col(rlen) <= 0, F.col(pos)).otherwise(F.col(pos) + F.col(rlen) - 1)


def over_frequent_base(seq: Column | str, most: float) -> Column:
    """Whether one base, or all other letters together, make up more than ``most`` of the sequence; compared as single floats."""
    text = F.upper(F.col(seq) if isinstance(seq, str) else seq)
    n = F.length(text)
    counts = [n - F.length(F.replace(text, F.lit(b), F.lit(""))) for b in "ACGT"]
    other = n - counts[0] - counts[1] - counts[2] - counts[3]
    share = F.try_divide(F.greatest(*counts, other).cast("float").cast("double"), n.cast("double")).cast("float")
    return F.coalesce((text != "*") & (n > 0) & (share > F.lit(most).cast("float")), F.lit(False))


def accepted(min_mapq: int, max_base_freq: float | None = None, seq: str | None = None) -> Column:
    """Paired, mapped with its mate, no duplicate, of enough quality, and without an over-frequent base."""
    bad = Flag.UNMAPPED | Flag.MATE_UNMAPPED | Flag.DUPLICATE
    ok = flagged("flag", Flag.PAIRED) & ~flagged("flag", bad) & (F.col("mapq") >= min_mapq)
    return ok & ~over_frequent_base(seq, max_base_freq) if seq and max_base_freq is not None else ok


def type_bits(max_distance: int) -> Column:
    far = F.when(F.col("chr") != F.col("chr_next"), int(ReadType.CHROMOSOME)).when(F.abs(F.col("pos") - F.col("pos_next")) > max_distance, int(ReadType.DISTANCE)).otherwise(0)
    return far.bitwiseOR(F.when(flagged("flag", Flag.SUPPLEMENTARY), int(ReadType.SUPPLEMENTARY)).otherwise(0))


# Chromosome names and their standard form.
CHROMOSOMES = {**{str(n): f"chr{n}" for n in range(1, 23)}, "x": "chrX", "y": "chrY", "m": "chrM", "mt": "chrM"}


def standard_chromosome(name: Column | str) -> Column:
    """The standard name, looked up by the first 31 characters in any case, with or without ``chr``; others stay as they are."""
    column = F.col(name) if isinstance(name, str) else name
    known = {prefix + k: v for k, v in CHROMOSOMES.items() for prefix in ("", "chr")}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.substring(column, 1, 31))), column)


def clip_side(cigar: str = "cigar") -> Column:
    """``right`` if clipped after its aligned part, ``left`` if before, and null; right wins."""
    c = F.col(cigar)
    right = c.ilike("%M%S") | c.ilike("%M%H")
    return F.when(right, "right").when(c.ilike("%S%M") | c.ilike("%H%M"), "left")


def clip_position(cigar: str = "cigar", pos: str = "pos", rlen: str = "rlen") -> Column:
    side = clip_side(cigar)
    return F.when(side == "right", F.col(pos) + F.col(rlen)).when(side == "left", F.col(pos))


def crosses(point: str, min_mapq: int, start: str = "pos", rlen: str = "rlen") -> Column:
    """Whether a properly paired primary read covers the point and a twentieth of its length on both sides."""
    need = Flag.PAIRED | Flag.PROPER
    bad = Flag.UNMAPPED | Flag.MATE_UNMAPPED | Flag.DUPLICATE | Flag.SUPPLEMENTARY
    proper = (F.col("flag").bitwiseAND(F.lit(int(need))) == int(need)) & ~flagged("flag", bad) & (F.col("mapq") >= min_mapq)
    end = end_position(start, rlen)
    margin = F.floor((end - F.col(start) + 1) / 20)
    return proper & (F.col(point) - margin >= F.col(start)) & (F.col(point) + margin <= end)
