"""Closed-form statistics over counts, as columns.  Undefined values are null."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: Two ground-truth accuracies closer than this are equal.
EPS = 1e-9


def rate(k: Column, n: Column) -> Column:
    return F.try_divide(k.cast("double"), n.cast("double"))


def wilson(k: Column, n: Column, upper: bool, z: float = Z95) -> Column:
    """One bound of the Wilson interval of k successes in n, within [0, 1]; null for n = 0."""
    p, m = rate(k, n), n.cast("double")
    centre = p + F.lit(z * z) / (2 * m)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / m + F.lit(z * z) / (4 * m * m))
    bound = (centre + spread if upper else centre - spread) / (1 + F.lit(z * z) / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)))


def spread(values: Column) -> Column:
    """Sample standard deviation; 0 for one value, null for none."""
    return F.when(F.count(values) == 1, F.lit(0.0)).otherwise(F.stddev_samp(values))


def accepts(rule: str, wins: Column, losses: Column, n: Column, margin: float = 0.0, tau: float = 0.05, tail: Column | None = None, alpha: float = 0.10) -> Column:
    """Whether a promotion rule accepts.

    ``net_win``: wins less losses, as a share of n, above ``margin``; ``win_rate``:
    more wins than losses and a share of wins of at least ``tau``; ``mcnemar``: more
    wins than losses and a tail below ``alpha``.  Nothing is accepted for n = 0.
    """
    if rule == "net_win":
        verdict = rate(wins - losses, n) > margin
    elif rule == "win_rate":
        verdict = (wins > losses) & (rate(wins, n) >= tau)
    elif rule == "mcnemar":
        if tail is None:
            raise ValueError("the McNemar rule needs its tail column")
        verdict = (wins > losses) & (tail < alpha)
    else:
        raise ValueError(f"unknown promotion rule {rule!r}")
    return F.when(n > 0, F.coalesce(verdict, F.lit(False))).otherwise(F.lit(False))


def mcnemar_tail(wins: Column, losses: Column) -> Column:
    """P(Binomial(wins + losses, 1/2) >= wins), summed in the JVM from log-factorials; 1 where nothing differs."""
    n = wins + losses
    steps = F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint"))
    # the terms C(n, k) / 2^n, k = 0..n, by their ratios; kept as logarithms so that large n don't underflow
    fold = F.aggregate(
        steps,
        F.struct((n * F.lit(-0.6931471805599453)).alias("t"), F.when(wins <= 0, F.exp(n * F.lit(-0.6931471805599453))).otherwise(F.lit(0.0)).alias("s")),
        lambda a, k: F.struct((a["t"] + F.log((n - k + 1).cast("double") / k)).alias("t"), (a["s"] + F.when(k >= wins, F.exp(a["t"] + F.log((n - k + 1).cast("double") / k))).otherwise(F.lit(0.0))).alias("s")),
        lambda a: F.least(F.lit(1.0), a["s"]),
    )
    return F.when(n > 0, fold).otherwise(F.lit(1.0))


def mcnemar_exact(wins: int, losses: int) -> float:
    """The same by exact integers, for tests."""
    n = wins + losses
    return float(Fraction(sum(comb(n, k) for k in range(wins, n + 1)), 2**n)) if n else 1.0


def mcnemar_table(spark: SparkSession, most: int) -> DataFrame:
    """(n, k, tail) for all k <= n <= most."""
    grid = spark.range(1, most + 1).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id"))).alias("k"))
    return grid.withColumn("tail", mcnemar_tail(F.col("k"), F.col("n") - F.col("k")))


def mean_spread_text(values: Column, scale: float = 100.0, digits: int = 1) -> Column:
    """"mean ± spread" of an aggregate as text; a dash without values."""
    return F.when(F.count(values) > 0, F.format_string(f"%.{digits}f ± %.{digits}f", F.avg(values) * scale, spread(values) * scale)).otherwise(F.lit("—"))
