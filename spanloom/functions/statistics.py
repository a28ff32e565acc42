"""Rank correlation and genotype likelihoods."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import many_tasks

#: Differences up to this count as equal.
EPSILON = 2.220446049250313e-16
PERMUTATIONS = 1001
SEED = 17


def equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < EPSILON


def tied_rank(by: list[str], value: str) -> Column:
    """Ranks from 1 in each group, ties sharing their mean rank."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2


def spearman(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, n, rho): Spearman's rho of each group, null where one side is constant."""
    ranked = pairs.withColumn("_rx", tied_rank(by, x)).withColumn("_ry", tied_rank(by, y))
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("_rx").alias("sx"),
        F.sum("_ry").alias("sy"),
        F.sum(F.col("_rx") * F.col("_rx")).alias("sxx"),
        F.sum(F.col("_ry") * F.col("_ry")).alias("syy"),
        F.sum(F.col("_rx") * F.col("_ry")).alias("sxy"),
    )
    n = F.col("n")
    # Half-integer ranks make these sums exact, so the value does not depend on their order.
    top = n * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return sums.select(*by, "n", F.when(bottom > 0, F.try_divide(top, F.sqrt(bottom))).alias("rho"))


def _rho(a: np.ndarray, b: np.ndarray) -> float:
    """Spearman's rho from ranks, by the sums of ``spearman``; not a number where one side is constant."""
    n = len(a)
    # Ranks sum to this, ties or not.
    total = n * (n + 1) / 2
    bottom = (n * (a @ a) - total * total) * (n * (b @ b) - total * total)
    return float((n * (a @ b) - total * total) / math.sqrt(bottom)) if bottom > 0 else math.nan


def rho_and_p(x: np.ndarray, y: np.ndarray, seed: int | list[int]) -> tuple[float, float]:
    """Spearman's rho, and the share of shuffles of both samples' pool whose |rho| is not under the observed one; undefined ones count.

    Values are places among the pool's sorted distinct ones. A shuffle leaves
    the pool's counts as they are, so the ranks of one side give the other's.
    """
    values, pool = np.unique(np.concatenate([x, y]), return_inverse=True)
    n, many = len(x), len(values)
    times = np.bincount(pool, minlength=many)
    both = np.cumsum(times) - times / 2 + 1

    def rho() -> float:
        first = np.bincount(pool[:n], minlength=many)
        ranks = np.cumsum(first) - first * 0.5
        ranks += 0.5
        return _rho(ranks.take(pool[:n]), (both - ranks).take(pool[n:]))

    observed = rho()
    draw = np.random.default_rng(seed)
    hits = 0
    for _ in range(PERMUTATIONS):
        draw.shuffle(pool)
        hits += not abs(rho()) < abs(observed)
    return observed, hits / PERMUTATIONS


def permutation_p(x: np.ndarray, y: np.ndarray, seed: int | list[int]) -> float:
    return rho_and_p(x, y, seed)[1]


def spearman_test(pairs: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, rho, p_value): with a seed per group, whatever the order of groups.

    A group's pairs are at most the reads of one event, held as two arrays.
    Small groups of pairs are long work, so tasks are many.
    """
    kind = pairs.schema[by].dataType
    schema = T.StructType([T.StructField(by, kind), T.StructField("rho", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def test(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([x, y])
        a, b = group[x].to_numpy(float), group[y].to_numpy(float)
        key = group[by].iloc[0]
        rho, p = rho_and_p(a, b, [SEED, int(key) if isinstance(key, (int, np.integer)) else sum(str(key).encode())])
        return pd.DataFrame({by: [key], "rho": [None if math.isnan(rho) else rho], "p_value": [p]})

    return pairs.select(by, x, y).repartition(many_tasks(pairs.sparkSession), by).groupBy(by).applyInPandas(test, schema)


def _log10(value: Column) -> Column:
    return F.when(value <= 0, F.lit(float("-inf"))).otherwise(F.log10(F.when(value > 0, value)))


def error_of(mapq: str) -> Column:
    return F.pow(F.lit(10.0), -F.col(mapq) / F.lit(10.0))


def wrong_term(mapq: str, ploidy: int = 2) -> Column:
    """log10 of ploidy times the error probability."""
    return _log10(F.lit(float(ploidy)) * error_of(mapq))


def right_term(mapq: str, ploidy: int = 2) -> Column:
    """log10 of ploidy times the probability of no error; minus infinity at quality 0."""
    return _log10(F.lit(float(ploidy)) * (1 - error_of(mapq)))


def heterozygous(n: Column, ploidy: int = 2) -> Column:
    """log10 of (1 / ploidy) to the n; written so that it does not underflow."""
    return -n * F.lit(math.log10(ploidy))


def call(ref: Column, het: Column, alt: Column) -> Column:
    """The genotype with the largest likelihood."""
    hom_ref = (((ref > het) | equal(ref, het)) & (ref > alt)) | (((ref > alt) | equal(ref, alt)) & (ref > het))
    het_won = (~equal(ref, F.lit(0.0)) & equal(ref, het) & equal(ref, alt)) | ((het > ref) & ((het > alt) | equal(het, alt)))
    return F.when(hom_ref, "0/0").when(het_won, "0/1").when((alt > ref) & (alt > het), "1/1").otherwise("./.")


def general_format(x: Column) -> Column:
    """Text of a double with six significant digits and no trailing zeros, in the short form of C's ``%g``."""
    scientific = F.format_string("%.5e", x)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1)
    power = F.when(exponent != "", exponent).otherwise("0").cast("int")
    trim = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    mantissa = trim(F.regexp_extract(scientific, r"^(.*)e", 1))
    places = F.greatest(F.least(5 - power, F.lit(9)), F.lit(0)).cast("string")
    fixed = trim(F.call_function("format_string", F.concat(F.lit("%."), places, F.lit("f")), x))
    shown = F.when((power < -4) | (power > 5), F.concat(mantissa, F.lit("e"), exponent)).otherwise(fixed)
    return F.when(x == 0, "0").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(F.isnan(x), "nan").otherwise(shown)
