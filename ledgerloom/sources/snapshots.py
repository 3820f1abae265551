"""Verified snapshots: JSON lines with a manifest of row counts and SHA-256 sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.answers import canonical_gold, last_hash_line


class SnapshotError(ValueError):
    """A file that isn't what its manifest says."""


def manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    """{file name: {"rows": n, "sha256": hex}} of a manifest ``{"files": [{"name", "rows", "sha256"}, ...]}``."""
    rows = spark.read.option("multiLine", True).schema("files array<struct<name:string,rows:long,sha256:string>>").json(path).select(F.explode("files").alias("f")).select("f.*")
    return {r["name"]: {"rows": r["rows"], "sha256": r["sha256"]} for r in rows.toLocalIterator()}  # a manifest lists files, not rows


def file_sha256(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of a file, read as a stream; None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def read_snapshot(spark: SparkSession, folder: str, name: str, schema: StructType, pins: dict[str, dict], first: int | None = None) -> DataFrame | None:
    """The rows of a file after its checksum and row count were verified, or its ``first`` ones by ``idx``; None if it has fewer.  Raises SnapshotError."""
    pin = pins.get(name)
    if pin is None:
        raise SnapshotError(f"{name} is in no manifest")
    path = f"{folder}/{name}"
    if file_sha256(spark, path) != pin["sha256"]:
        raise SnapshotError(f"{name}: checksum differs from its manifest")
    rows = spark.read.schema(schema).json(path)
    if (n := rows.count()) != pin["rows"]:
        raise SnapshotError(f"{name}: {n} rows, its manifest has {pin['rows']}")
    if first is None:
        return rows
    return None if first > n else rows.orderBy("idx").limit(first)


def read_hub(spark: SparkSession, path: str, first: int, question: str = "question", answer: str = "answer") -> DataFrame:
    """(idx, question, answer_text): the first rows of a Parquet file in its order, only these columns read.  Raises SnapshotError if it has fewer."""
    rows = spark.read.parquet(path).select(F.col("_metadata.row_index").alias("idx"), F.col(question).alias("question"), F.col(answer).alias("answer_text")).where(F.col("idx") < first)
    if (n := rows.count()) < first:
        raise SnapshotError(f"{path}: {n} rows, {first} are wanted")
    return rows


def load_items(spark: SparkSession, split: str, first: int, snapshot: tuple[str, str, StructType, dict] | None, hub: str | None) -> DataFrame:
    """The first items of a split from the verified snapshot, or from the hub file if there is no snapshot or it is too small."""
    rows = None
    if snapshot is not None and snapshot[1] in snapshot[3]:
        rows = read_snapshot(spark, snapshot[0], snapshot[1], snapshot[2], snapshot[3], first)
    if rows is None:
        if hub is None:
            raise SnapshotError(f"no source has {first} items of {split}")
        rows = read_hub(spark, hub, first)
    return rows.withColumn("split", F.lit(split))


def item_violations(items: DataFrame, split: str) -> DataFrame:
    """(idx, reason): items of another split, numbers that aren't 0, 1, 2, ... and golds that their worked answer doesn't end with."""
    told = canonical_gold(F.regexp_replace(last_hash_line(F.col("answer_text")), ",", ""))
    n = items.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("idx").alias("_d"))
    reason = (
        F.when(~F.col("split").eqNullSafe(F.lit(split)), F.lit("split"))
        .when(F.col("idx").isNull() | (F.col("idx") < 0) | (F.col("idx") >= F.col("_n")) | (F.col("_d") != F.col("_n")), F.lit("order"))
        .when(told.isNull(), F.lit("no gold"))
        .when(~canonical_gold(F.col("gold")).eqNullSafe(told), F.lit("gold"))
    )
    return items.crossJoin(F.broadcast(n)).withColumn("reason", reason).where("reason IS NOT NULL").select("idx", "reason")  # one row


def shards(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of numbered shards ``...-<seq>.jsonl[.gz]`` with their file name and sequence number."""
    rows = spark.read.schema(schema).json(folder).withColumn("_file", F.col("_metadata.file_name"))
    return rows.withColumn("_seq", F.regexp_extract("_file", r"(\d+)\.jsonl(?:\.gz)?$", 1).try_cast("long"))
