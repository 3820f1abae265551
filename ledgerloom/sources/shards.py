"""The append log: numbered, immutable, checksummed shards of rows of any table, and their replay.

A shard is a folder of JSON lines ``{"table", "row"}`` and a small file beside it,
written last, with its row count and checksum.  A shard without that file was never
finished and is passed over.  The checksum adds up hashes of the lines, so it doesn't
depend on how they are split over files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import hash32
from ledgerloom.sources.store import Files, Store, StoreError

_NAME = re.compile(r"(\d{6})_([a-z0-9-]+)\.done")


class ShardGap(StoreError):
    """A shard is missing before one that is there."""


class ShardError(StoreError):
    """A shard that isn't what its checksum says, or a number that is taken."""


def _sums(lines: DataFrame) -> tuple[int, str]:
    got = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hash32(F.col("value")).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return got["n"], f"{int(got['h']):x}"


def shards(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, name) of the finished shards, in order."""
    found = [m for name in Files(spark, folder).names(folder) if (m := _NAME.fullmatch(name))]
    return sorted((int(m[1]), m.group().removesuffix(".done")) for m in found)


def write_shard(spark: SparkSession, folder: str, stage: str, rows: Mapping[str, DataFrame]) -> tuple[int, str, int, str]:
    """(number, name, rows, checksum) of a new shard with the next number."""
    files = Files(spark, folder)
    number = max([n for n, _ in shards(spark, folder)], default=0) + 1
    name = f"{number:06d}_{re.sub(r'[^a-z0-9]+', '-', stage.lower()).strip('-') or 'stage'}"
    lines = None
    for table, df in rows.items():
        part = df.select(F.to_json(F.struct(F.lit(table).alias("table"), F.struct(*df.columns).alias("row"))).alias("value"))
        lines = part if lines is None else lines.unionByName(part)
    if lines is None:
        raise ShardError("a shard needs rows")
    lines.write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{name}")  # an unfinished shard of this number is replaced
    n, checksum = _sums(spark.read.text(f"{folder}/{name}"))
    files.write(f"{folder}/{name}.done", json.dumps({"rows": n, "checksum": checksum}))
    return number, name, n, checksum


def read_shard(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(table, row as JSON) of a shard after its checksum was verified."""
    pin = json.loads(Files(spark, folder).read(f"{folder}/{name}.done"))
    lines = spark.read.text(f"{folder}/{name}")
    if _sums(lines) != (pin["rows"], pin["checksum"]):
        raise ShardError(f"{name}: rows or checksum differ")
    return lines.select(F.get_json_object("value", "$.table").alias("table"), F.get_json_object("value", "$.row").alias("row"))


def replay(store: Store, folder: str, allow_gaps: bool = False) -> int:
    """Commits every shard after the last one replayed, each at once; the number of rows read.

    A missing number raises ``ShardGap`` before anything past it, unless gaps are
    allowed.  Replaying again changes nothing.
    """
    last = max((r["value"] for r in store.meta("last_shard_seq").select(F.col("value").cast("long").alias("value")).collect()), default=0)  # one key
    total = 0
    for number, name in shards(store.spark, folder):
        if number <= last:
            continue
        if number != last + 1 and not allow_gaps:
            raise ShardGap(f"shards {last + 1} to {number - 1} are missing")
        lines = read_shard(store.spark, folder, name)
        tables = [r["table"] for r in lines.select("table").distinct().collect()]  # names of tables
        rows = {t: lines.where(F.col("table") == t).select(F.from_json("row", store.schema(t)).alias("r")).select("r.*") for t in tables}
        n = lines.count()
        pin = json.loads(Files(store.spark, folder).read(f"{folder}/{name}.done"))
        rows["shard_log"] = store.spark.createDataFrame([(number, name, n, pin["checksum"])], "seq long, path string, n_rows long, sha256 string")
        rows["meta"] = store.spark.createDataFrame([("last_shard_seq", str(number))], "key string, value string")
        store.write(rows)
        total, last = total + n, number
    return total
