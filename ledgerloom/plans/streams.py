"""Queries that run a stream to its end and return what it stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.lineage import shared_dir
from ledgerloom.plans.store import CELL_KEY
from ledgerloom.registry import query
from ledgerloom.sources.tables import table
from ledgerloom.streaming.ingest import event_windows, merged, start


@query(f"SELECT {', '.join(CELL_KEY)}, min(gen_key) AS gen_key, bool_or(physical) AS physical FROM (SELECT DISTINCT * FROM cells) GROUP BY ALL")
def stream_ingest_cells(spark, d):
    """Cells read as a stream and merged by key: the same rows as by a batch read."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "cells")
    start(spark, f"{d}/cells.parquet*", source.schema, f"{base}/rows", f"{base}/state").awaitTermination()
    return merged(spark, f"{base}/rows", CELL_KEY).select(*CELL_KEY, "gen_key", "physical")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows_hourly(spark, d):
    """Hourly event counts; the plan also runs as a stream with a watermark."""
    return event_windows(table(spark, d, "events", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp")))
