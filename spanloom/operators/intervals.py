"""Joins of closed intervals [low, high] on the same chromosome.

Both sides are cut into bins, so the join is an equality on (chr, bin) with the
overlap as a residual: no nested loop, and as many keys as bins rather than as
chromosomes, so a hot chromosome spreads over the cluster. A pair that shares
several bins is reported by the bin that holds the larger of its lows, so no
deduplication is needed. Spark broadcasts the right side if its size is under
the broadcast threshold and otherwise shuffles both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 1 << 14


def spans(low: Column, high: Column, width: int) -> Column:
    return F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width))


def overlap_fraction(low1: Column, high1: Column, low2: Column, high2: Column, fraction1: float | None, fraction2: float | None, either: bool = False) -> Column:
    """Whether the overlap covers the given fractions of the intervals.

    Widths are high - low and thresholds are single-precision products cut to
    whole numbers; without a fraction one base is enough. ``either`` asks for
    one of the two conditions rather than both.
    """
    shared = F.least(high1, high2) - F.greatest(low1, low2)

    def enough(low: Column, high: Column, fraction: float | None) -> Column:
        needed = ((high - low).cast("float") * F.lit(fraction or 1e-10).cast("float")).cast("float")
        return shared >= needed.cast("long")

    one, two = enough(low1, high1, fraction1), enough(low2, high2, fraction2)
    return (shared >= 0) & (one | two if either else one & two)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_cols: tuple[str, str, str],
    right_cols: tuple[str, str, str],
    left_fraction: float | None = None,
    right_fraction: float | None = None,
    either: bool = False,
    padding: int = 0,
    width: int = BIN,
) -> DataFrame:
    """All pairs of overlapping rows, with overlap_pos and overlap_len.

    The columns of the two sides must differ, (chr, low, high) are named by the
    tuples, and the left interval is widened by ``padding``, not below 0.
    """
    c1, l1, h1 = left_cols
    c2, l2, h2 = right_cols
    low1 = F.greatest(F.col(l1) - padding, F.lit(0)) if padding else F.col(l1)
    high1 = F.col(h1) + padding if padding else F.col(h1)
    cut_left = left.withColumn("_low1", low1).withColumn("_high1", high1).withColumn("_bin", F.explode(spans(F.col("_low1"), F.col("_high1"), width)))
    cut_right = right.withColumn("_bin2", F.explode(spans(F.col(l2), F.col(h2), width)))
    a, b, c, d = F.col("_low1"), F.col("_high1"), F.col(l2), F.col(h2)
    own_bin = F.col("_bin") == F.floor(F.greatest(a, c) / width)
    joined = cut_left.join(cut_right, (F.col(c1) == F.col(c2)) & (F.col("_bin") == F.col("_bin2")) & (a <= d) & (b >= c) & own_bin & overlap_fraction(a, b, c, d, left_fraction, right_fraction, either))
    return joined.withColumn("overlap_pos", F.greatest(a, c)).withColumn("overlap_len", F.least(b, d) - F.greatest(a, c) + 1).drop("_bin", "_bin2", "_low1", "_high1")


def overlap_anti_join(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str], key: list[str], padding: int = 0, width: int = BIN) -> DataFrame:
    """The left rows without any overlap; ``key`` names them."""
    c2, l2, h2 = right_cols
    narrow = left.select(*dict.fromkeys([*key, *left_cols]))
    other = right.select(F.col(c2).alias("_chr2"), F.col(l2).alias("_low2"), F.col(h2).alias("_high2"))
    hit = overlap_join(narrow, other, left_cols, ("_chr2", "_low2", "_high2"), padding=padding, width=width).select(*key).distinct()
    return left.join(hit, key, "left_anti")


def point_join(points: DataFrame, ranges: DataFrame, point_cols: tuple[str, str], range_cols: tuple[str, str, str], width: int = BIN) -> DataFrame:
    """All pairs of a point and a range [low, high] that holds it."""
    chr1, at = point_cols
    chr2, low, high = range_cols
    cut = ranges.filter(F.col(low) <= F.col(high)).withColumn("_bin2", F.explode(spans(F.col(low), F.col(high), width)))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(cut, (F.col(chr1) == F.col(chr2)) & (F.col("_bin") == F.col("_bin2")) & F.col(at).between(F.col(low), F.col(high))).drop("_bin", "_bin2")
