"""Joins whose key may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, fraction: float = 0.01) -> DataFrame:
    """Keys that hold at least ``fraction`` of the rows, so at most ``1/fraction`` of them.

    One aggregate with map-side combine; null keys never join and are left out.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg((F.count(F.lit(1)) * F.lit(fraction)).alias("_least"))
    return counts.join(F.broadcast(total), F.col("_n") >= F.col("_least")).select(key)  # total is one row


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", salts: int = 32, fraction: float = 0.01, hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, with the hot keys of ``left`` split over ``salts`` tasks.

    ``spread`` is a column of ``left`` that varies within a key.  Only the rows of
    ``right`` under a hot key are repeated, ``salts`` times.  The list of hot keys
    has at most ``1/fraction`` rows, which bounds its broadcast.  Unless
    ``hot`` gives that list, ``left`` is read twice: cut its lineage first if it is
    costly.
    """
    hot = F.broadcast((hot_keys(left, key, fraction) if hot is None else hot).withColumn("_hot", F.lit(True)))
    a = left.withColumn("_spread", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(hot, key, "left")
    a = a.withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(F.lit(0))).drop("_hot", "_spread")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def join_small(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", most: int = 100_000) -> DataFrame:
    """``left`` joined to ``right``, which is broadcast if it has at most ``most`` rows and else joined with salted hot keys.

    ``right`` is counted first: cut its lineage if it is costly.
    """
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, spread, how)
