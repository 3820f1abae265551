"""Ingest of the append-only log: a file stream merged batch by batch into a keyed table.

A batch is written to a folder of its own name, so a repeated batch replaces
itself, and reading merges all batches by key.  Together with the stream's
checkpoint every row counts once however often a batch is replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.merge import first_per_key


class InjectedFailure(RuntimeError):
    """A failure asked for, to test that a run resumes."""


def start(spark: SparkSession, source: str, schema: StructType, target: str, state: str, files_per_batch: int = 4, fmt: str = "parquet", fail_after: int | None = None):
    """Starts a run over what is there (``availableNow``); a later run goes on after it.

    With ``fail_after`` the run fails before it commits that many batches and one more.
    """
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    done = 0

    def commit(batch: DataFrame, number: int) -> None:
        nonlocal done
        if fail_after is not None and done >= fail_after:
            raise InjectedFailure(f"after {done} batches")
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number:08d}")
        done += 1

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", state).trigger(availableNow=True).start()


def run_for(query, seconds: float) -> bool:
    """Waits for a run, and stops it after so many seconds once it has committed a batch; whether it came to its end."""
    if query.awaitTermination(max(0.1, seconds)):
        return True
    while query.isActive and not query.recentProgress:
        query.awaitTermination(0.5)
    if query.isActive:
        query.stop()
    return False


def merged(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The ingested rows by key: the first write wins, within a batch the least row."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(target)
    return first_per_key(rows, keys, [F.col("_batch")]).drop("_batch")


def event_windows(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per event-time window; rows later than ``delay`` behind the newest are left out of a stream."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
