"""Same or near-same records across splits: exact prefix-filter bipartite join.

Each compared field of a record becomes a set of word shingles.  Evaluation
records index the prefixes of their rarest shingles, training records probe with
theirs under the length and position filters, in one pass for both directions
(either may be the smaller set), and the candidates are verified on the whole sets.
Records with equal sets are joined once.

Nulls and texts with fewer words than a shingle never match.  Repeated rows
count once; rows of one key with different texts are all compared.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.llm.setjoin import similar_pairs
from ledgerloom.llm.words import shingles, words
from ledgerloom.operators.skew import salted_join

TRAINING = "train"


def field_sets(items: DataFrame, fields: list[str], k: int) -> DataFrame:
    """(split, idx, field, held, tokens, id), one row for each compared field of a record; ``id`` names its set within the field."""
    texts = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields)])).alias("e")
    rows = items.where(F.col("split").isNotNull() & F.col("idx").isNotNull()).select("split", "idx", texts)
    sets = rows.select("split", "idx", F.col("e.field").alias("field"), (F.col("split") != TRAINING).alias("held"), F.sort_array(shingles(words(F.col("e.text")), k)).alias("tokens"))
    named = sets.where(F.size("tokens") > 0).withColumn("id", F.xxhash64("field", "tokens"))
    return named.groupBy("split", "idx", "field", "held", "id").agg(F.first("tokens").alias("tokens"))


def overlaps(items: DataFrame, fields: list[str], k: int = 5, t: Fraction = Fraction(4, 5)) -> DataFrame:
    """(split_a, idx_a, split_b, idx_b, field): evaluation records and the training records near them in ``field``.

    Default: five-word shingles, 0.8.
    """
    sets = cut(field_sets(items, fields, k))
    # equal within a class; which side of the join it is on: 1 evaluation, 2 training, 3 both
    classes = cut(sets.groupBy("id", F.col("field").alias("space")).agg(F.first("tokens").alias("tokens"), F.bit_or(F.when(F.col("held"), 1).otherwise(2)).alias("sides")))
    found = similar_pairs(classes, t, 1)
    both = found.select(F.col("s").alias("a"), F.col("l").alias("b")).unionByName(found.select(F.col("l").alias("a"), F.col("s").alias("b")))
    near = cut(both.unionByName(classes.where("sides = 3").select(F.col("id").alias("a"), F.col("id").alias("b"))))
    held = sets.where("held").select(F.col("id").alias("a"), F.col("split").alias("split_a"), F.col("idx").alias("idx_a"), "field")
    train = sets.where("NOT held").select(F.col("id").alias("b"), F.col("split").alias("split_b"), F.col("idx").alias("idx_b"))
    # a set that many records share is split over tasks on either side
    pairs = salted_join(held, near, "a", F.xxhash64("split_a", "idx_a"), "inner")
    pairs = salted_join(train, pairs, "b", F.xxhash64("split_b", "idx_b"), "inner")
    return pairs.select("split_a", "idx_a", "split_b", "idx_b", "field")
