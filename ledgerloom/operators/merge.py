"""Write policies of keyed tables as plans: ignore, replace, conditional upsert; and what they reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null in the key are left out.

    An aggregate with map-side combine instead of a window: a hot key is reduced
    before it is shuffled.
    """
    rest = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    known = rows.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    best = known.groupBy(*keys).agg(F.min(rank).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``stored`` and, of the new keys, the first incoming row."""
    new = first_per_key(incoming, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def insert_replace(stored: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row of each key with the highest ``sequence``; missing columns are null."""
    every = stored.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in keys and c != sequence]
    best = every.groupBy(*keys).agg(F.max(F.struct(sequence, *rest)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in every.columns])


def upsert_if_changed(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Full outer merge: an incoming row replaces a stored one only if their versions differ."""
    rest = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.struct(*rest).alias("_old"))
    b = incoming.select(*keys, F.struct(*rest).alias("_new"))
    keep = F.col("_new").isNull() | (F.col("_old").isNotNull() & F.col(f"_old.{version}").eqNullSafe(F.col(f"_new.{version}")))
    merged = a.join(b, keys, "full_outer").withColumn("_r", F.when(keep, F.col("_old")).otherwise(F.col("_new")))
    return merged.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys under which ``value`` differs, with the number of its values."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def sequence_gaps(rows: DataFrame, column: str, step: int, bucket: int = 1_000_000) -> DataFrame:
    """(after, before, n_missing): gaps of more than ``step`` - 1 in an increasing sequence.

    Neighbours are found inside buckets of the value range and between the ends of
    neighbouring buckets, so that no window spans the table.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("v")).distinct()
    inside = Window.partitionBy("b").orderBy("v")
    put = values.withColumn("b", F.floor(F.col("v") / bucket)).withColumn("p", F.lag("v").over(inside))
    ends = put.groupBy("b").agg(F.min("v").alias("v"), F.max("v").alias("top"))
    across = ends.withColumn("p", F.lag("top").over(Window.orderBy("b"))).select("v", "p")  # one row per bucket
    pairs = put.where("p IS NOT NULL").select("v", "p").unionByName(across.where("p IS NOT NULL"))
    return pairs.where(F.col("v") - F.col("p") > step).select(F.col("p").alias("after"), F.col("v").alias("before"), (F.col("v") - F.col("p") - 1).alias("n_missing"))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 over a row's columns as text, nulls told from empty texts."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)
