"""Near-duplicate records with small edits: multiple-global-order filtering.

Records are sets of word shingles.  Records with equal sets form one class and
only one of them is joined.  A pair is a candidate only if the prefixes of both
meet under every one of several global token orders, in the window of sizes and at
places that still allow the similarity (``setjoin``).  The first order is joined on
ids; what is left is held against the other orders and verified on the whole sets.

Nulls and texts with fewer words than a shingle have no shingles and are similar
to nothing.  Repeated rows count once.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.llm.setjoin import similar_pairs
from ledgerloom.llm.words import shingles, words
from ledgerloom.operators.skew import hot_keys, salted_join


def shingle_sets(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, id, tokens): ``id`` is the same for rows with the same set.

    One row per key; of rows with one key and different texts the least set
    counts.  Shingles are made where the table is read, before anything is
    shuffled.
    """
    sets = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.sort_array(shingles(words(F.col(text)), k)).alias("tokens"))
    once = sets.where(F.size("tokens") > 0).groupBy("key").agg(F.min("tokens").alias("tokens"))
    return once.withColumn("id", F.xxhash64("tokens"))


def similar_classes(classes: DataFrame, t: Fraction, orders: int) -> DataFrame:
    """(a, b, n_a, n_b, common), a < b, for all pairs of classes (id, tokens) with similarity of at least ``t``; cut their lineage first."""
    found = similar_pairs(joinable(classes), t, orders)
    turn = F.col("s") > F.col("l")
    end = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return found.select(end("s", "l").alias("a"), end("l", "s").alias("b"), end("n_s", "n_l").alias("n_a"), end("n_l", "n_s").alias("n_b"), "common")


def joinable(classes: DataFrame) -> DataFrame:
    return classes.select("id", "tokens", F.lit(3).alias("sides"), F.lit(0).alias("space"))


def classes_of(df: DataFrame, key: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (key, id) of each record with shingles, and (id, tokens) of each different set; both written to the shared folder."""
    sets = cut(shingle_sets(df, key, text, k))
    return sets.select("key", "id"), cut(sets.groupBy("id").agg(F.first("tokens").alias("tokens")))  # equal within a class


def near_duplicates(df: DataFrame, key: str, text: str, k: int = 5, t: Fraction = Fraction(4, 5), orders: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (key, id) for each record with shingles, links the similar pairs of different classes.

    Records of one class have similarity 1.  Default: five-word shingles, 0.8.
    """
    members, classes = classes_of(df, key, text, k)
    return members, similar_classes(classes, t, orders)


def pairs_of_keys(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every similar pair of records, those of one class included.

    A large class is split over tasks on one side of each join.
    """
    hot = cut(hot_keys(members, "id"))
    one, other = members.select(F.col("key").alias("k1"), F.col("id").alias("a")), members.select(F.col("key").alias("k2"), F.col("id").alias("b"))
    named = lambda c: hot.select(F.col("id").alias(c))
    across = salted_join(one, links.select("a", "b"), "a", F.col("k1"), "inner", hot=named("a"))
    across = salted_join(other, across, "b", F.col("k2"), "inner", hot=named("b"))
    within = salted_join(one, other.withColumnRenamed("b", "a"), "a", F.col("k1"), "inner", hot=named("a")).where(F.col("k1") < F.col("k2"))
    return across.unionByName(within, allowMissingColumns=True).select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"))


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): connected components, named by their least id.

    Large-star and small-star steps: each shortens all paths, so the number of
    rounds grows with the logarithm of the longest one.  The edges stay
    distributed; each round is written to the shared folder.  No vertex gathers
    its neighbours in one row: the least neighbour is a plain aggregate.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where(F.col("u") != F.col("v")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = salted_join(both, least, "u", F.col("v"), "inner")  # a root holds its whole component
        out = joined.where(F.col("v") > F.col("u")) if large else joined
        hooked = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            hooked = hooked.unionByName(least.select("u", F.col("m").alias("v")))
        return hooked.where(F.col("u") != F.col("v")).distinct()

    before = None
    for _ in range(rounds):
        edges = cut(star(cut(star(edges, True)), False))
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return nodes.select("id").distinct().join(root, "id", "left").withColumn("component", F.coalesce("component", "id"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class_id, n_links, group_id): one row per record that has shingles.

    ``n_links`` counts the similar classes other than its own; ``group_id`` is the
    connected component over classes.
    """
    ends = reduce(DataFrame.unionByName, [links.select(F.col(c).alias("id")) for c in ("a", "b")]).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    comp = components(members, links)
    hot = hot_keys(members, "id")
    out = salted_join(members, comp.join(ends, "id", "left"), "id", F.col("key"), "inner", hot=hot)
    return out.select("key", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("component").alias("group_id"))


def with_the_rest(grouped: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """``grouped`` and a row of its own class and group, without links, for each record that has no shingles."""
    rest = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().join(grouped.select("key"), "key", "left_anti")
    alone = F.xxhash64(F.lit("alone"), "key")
    return grouped.unionByName(rest.select("key", alone.alias("class_id"), F.lit(0).cast("long").alias("n_links"), alone.alias("group_id")))
