"""Queries over the project's tables, each with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.llm import defects, leakage, mixing, mojibake, neardup, overlap, setjoin, truncation
from ledgerloom.llm.oracles import oracle_sql
from ledgerloom.operators.skew import hot_keys, salted_join
from ledgerloom.sources.tables import table

__all__ = ["oracle_sql", "queries"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(table(spark, d, "prompts"), "prompt_hash", "text", 3, Fraction(1, 2))
    return neardup.pairs_of_keys(members, links).select(F.col("key_a").alias("hash_a"), F.col("key_b").alias("hash_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per prompt: the first prompt of its class of equal sets, the number of similar classes, and the first prompt of its group of linked ones."""
    members, links = neardup.near_duplicates(table(spark, d, "prompts"), "prompt_hash", "text", 3, Fraction(1, 2))
    every = cut(neardup.with_the_rest(neardup.groups(members, cut(links)), table(spark, d, "prompts", "prompt_hash"), "prompt_hash"))
    out = every
    for name in ("class", "group"):
        first = every.groupBy(f"{name}_id").agg(F.min("key").alias(f"{name}_first"))
        out = salted_join(out, first, f"{name}_id", F.col("key"), "inner", hot=hot_keys(every, f"{name}_id"))
    return out.select(F.col("key").alias("prompt_hash"), "class_first", "n_links", "group_first")


def p1_orders(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of classes are left as candidates after each token order."""
    _, classes = neardup.classes_of(table(spark, d, "prompts"), "prompt_hash", "text", 3)
    return setjoin.pruning(setjoin.meetings(neardup.joinable(classes), Fraction(1, 2), 3), 3)


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return defects.verdicts(table(spark, d, "generations"), table(spark, d, "items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).where("defect IS NOT NULL").select("gen_key", "defect")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).where("defect = 'truncated'").select("gen_key")


def p3_cut_rates(spark: SparkSession, d: str) -> DataFrame:
    """Cut generations and the cut rate per model_id."""
    return truncation.cut_rates(_verdicts(spark, d))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "items", "split", "idx", "question", "answer_text"), ["question", "answer_text"], 2, Fraction(3, 5))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("split_a", "idx_a", "split_b", "idx_b").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: items, items that are in train too, and pairs."""
    items = table(spark, d, "items", "split", "idx", "source").where("split <> 'train'").groupBy("split", "idx").agg(F.min("source").alias("source"))
    pairs = p4_found(spark, d).groupBy(F.col("split_a").alias("split"), F.col("idx_a").alias("idx")).agg(F.count(F.lit(1)).alias("pairs"))
    rows = items.join(pairs, ["split", "idx"], "left")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_items"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "items", "split", "idx", "question", "answer_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p5_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Which evaluation items leaked, and into how many documents of each source."""
    return leakage.leak_report(_leaks(spark, d), table(spark, d, "documents", "doc_id", "source"), table(spark, d, "items"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = mixing.token_counts(table(spark, d, "documents", "doc_id", "source", "text"), f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
    wanted = cut(mixing.targets(counts, table(spark, d, "mix_plans"), table(spark, d, "mix_targets")))
    return wanted, mixing.sample(counts, wanted)


def p6_mix_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mixture with their number of copies."""
    return _mixed(spark, d)[1]


def p6_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of each source in each mixture."""
    return mixing.shares(*_mixed(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their encodings and restored texts."""
    return mojibake.garbled(table(spark, d, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_groups, p1_orders, p2_found, p3_found, p3_cut_rates, p4_found, p4_report, p5_found, p5_leaked_items, p6_mix_documents, p6_mix_shares, p7_found, p7_restored)
    return {f.__name__: f for f in every}
