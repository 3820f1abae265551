"""Mixing sources to target weights by systematic sampling.

Each plan wants ``budget_ratio`` times all tokens of the corpus, shared over its
sources by weight.  Within a source every document has the same expected number
of copies, the source's target over its size, but at most ``max_repeats``.  The
expected copies are summed up along the documents of the source, one random
offset in [0, 1) is added, and a document is taken once for every integer that
its stretch of the sum crosses.  So copies of a document differ from the expected
number by less than one and never exceed ``max_repeats``.

The documents of a source stand by size, so that the tokens drawn come close to
their target.  The prefix sums run in two levels, over sizes and buckets of a source
and inside each bucket, so that no task holds a whole source.  Sizes are in tokens of a public
tokenizer.

Documents without a source belong to no target but count for the budget; a null
text has no tokens.  Repeated rows of a document count once.  Targets whose source
the corpus lacks, or with a null or non-positive weight, come out with no tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.operators.skew import join_small

TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKET = 50_000

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once in each process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n_tokens), one row per document; of rows with one doc_id the largest counts.  Written to the shared folder."""
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], schema=out)

    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    counted = rows.mapInArrow(count, "doc_id long, source string, n_tokens long")
    once = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("r"))
    return cut(once.select("doc_id", "r.source", "r.n_tokens"))


def targets(counts: DataFrame, plans: DataFrame, weights: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, target_tokens, n_documents, source_tokens, rate, max_repeats) for each target of each plan.

    ``rate`` is the expected number of copies of every document of the source.
    Weights of one (mix_id, source) add up; of plans with one mix_id the largest counts.
    """
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_documents"))
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    plan = plans.where("mix_id IS NOT NULL").groupBy("mix_id").agg(F.max(F.struct("budget_ratio", "max_repeats")).alias("p")).select("mix_id", F.coalesce("p.budget_ratio", F.lit(0.0)).alias("budget_ratio"), F.greatest(F.coalesce("p.max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    share = weights.where("source IS NOT NULL").distinct().groupBy("mix_id", "source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w"))
    share = share.withColumn("target_share", F.try_divide("w", F.sum("w").over(Window.partitionBy("mix_id"))))
    rows = share.join(plan, "mix_id").crossJoin(F.broadcast(total)).join(sizes, "source", "left")  # total is one row
    wanted = F.coalesce(F.col("target_share"), F.lit(0.0)) * F.col("budget_ratio") * F.col("all_tokens")
    rows = rows.withColumn("target_tokens", wanted).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0))).withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_tokens") / F.col("source_tokens"))).otherwise(F.lit(0.0))
    return rows.select("mix_id", "source", "target_share", "target_tokens", "n_documents", "source_tokens", rate.alias("rate"), "max_repeats")


def _offset(seed: int, *by: Column) -> Column:
    """The one random offset of a group, in [0, 1), fixed by the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40)) / F.lit(float(1 << 40))


def positions(counts: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens, place): documents of each source numbered from 0 by size, those of one size in a random, fixed order.

    By size, so that the tokens drawn follow their target and not only the copies.
    Documents of one source and size are cut into buckets of bounded size.
    """
    rows = counts.where("source IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    n = rows.groupBy("source", "n_tokens").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).cast("int").alias("n_buckets")).where("n_buckets > 1")
    rows = join_small(rows.withColumn("of", F.struct("source", "n_tokens")), cut(n.select(F.struct("source", "n_tokens").alias("of"), "n_buckets")), "of", F.col("doc_id")).drop("of")
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.coalesce("n_buckets", F.lit(1))))
    sizes = rows.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("source").orderBy("n_tokens", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each size
    starts = sizes.select("source", "n_tokens", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["source", "n_tokens", "bucket"]).select("source", "doc_id", "n_tokens", (F.col("start") + F.col("rank")).alias("place"))


def sample(counts: DataFrame, wanted: DataFrame, seed: int = 17) -> DataFrame:
    """(mix_id, source, doc_id, n_copies, n_tokens): the documents of each mixture with at least one copy."""
    rates = wanted.where("rate > 0").select("mix_id", "source", "rate", "max_repeats")
    rows = join_small(positions(counts), rates, "source", F.col("doc_id"), "inner")
    offset = _offset(seed, F.col("mix_id"), F.col("source"))
    crossed = lambda place: F.floor(place * F.col("rate") + offset)
    copies = (crossed(F.col("place") + 1) - crossed(F.col("place"))).cast("int")
    return rows.select("mix_id", "source", "doc_id", F.least(copies, F.col("max_repeats")).alias("n_copies"), "n_tokens").where("n_copies > 0")


def shares(wanted: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row per target: wanted and actual tokens and shares, copies, and whether the source could give its target.

    ``actual_share`` is of what was drawn, ``budget_share`` of what the plan wanted.
    """
    got = sampled.groupBy("mix_id", "source").agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("actual_tokens"), F.sum("n_copies").cast("long").alias("n_copies"), F.count(F.lit(1)).alias("n_used"))
    rows = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "n_copies", "n_used"])
    rows = rows.withColumn("actual_share", F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(Window.partitionBy("mix_id"))))
    rows = rows.withColumn("budget_share", F.try_divide(F.col("actual_tokens").cast("double"), F.sum("target_tokens").over(Window.partitionBy("mix_id"))))
    reachable = F.col("target_tokens") <= F.col("source_tokens") * F.col("max_repeats")
    return rows.select("mix_id", "source", "target_share", "actual_share", "budget_share", "target_tokens", "actual_tokens", "source_tokens", "n_documents", "n_used", "n_copies", "rate", reachable.alias("reachable"))
