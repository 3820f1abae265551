"""The keyed store: sixteen tables as versioned Parquet folders behind one manifest.

A commit writes new versions of the tables it touches and then, by a rename, a new
manifest that points to them: readers see all of a commit or nothing, and what a lost
writer leaves behind is never pointed to.  Each table has its key and its write
policy.  One writer at a time; a commit that finds another manifest than the one it
started from raises.

Rows with a null in a key, unknown tables and unknown columns are errors.  All paths
go through the Hadoop file system of the session, so the root may be shared storage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.merge import first_per_key, insert_ignore, insert_replace, upsert_if_changed
from ledgerloom.operators.skew import join_small

SCHEMA_VERSION = 1
_CELL = "run_id string, seed int, split string, decoding_id string, slot int, draw_kind string, draw int, item_idx int"


class StoreError(ValueError):
    """A write or read that the store refuses."""


class ItemConflict(StoreError):
    """An item whose content differs from the stored one."""


class SlotConflict(StoreError):
    """A slot whose prompt or lineage differs from the stored one."""


class CellConflict(StoreError):
    """A cell that is planned with another generation than the stored one."""


class ConfigMismatch(StoreError):
    """A run resumed under another configuration."""


class EngineMismatch(StoreError):
    """A run resumed on another engine."""


@dataclass(frozen=True)
class Table:
    """``policy``: ignore (first write wins), replace (last write wins), append, or the column whose change lets a write overwrite."""

    schema: str
    keys: tuple[str, ...]
    policy: str
    guarded: tuple[str, ...] = ()
    conflict: type[StoreError] = StoreError


# The tables with their columns and keys.
TABLES = {
    "meta": Table("key string, value string", ("key",), "replace"),
    "runs": Table("run_id string, config_json string, config_hash string, plan_hash string, provenance_json string, engine_fp string, synthetic boolean, created_at timestamp", ("run_id",), "replace"),
    "items": Table("split string, idx int, question string, answer_text string, gold string", ("split", "idx"), "ignore", ("question", "answer_text", "gold"), ItemConflict),
    "prompts": Table("prompt_hash string, text string", ("prompt_hash",), "ignore"),
    "slots": Table("run_id string, seed int, slot int, prompt_hash string, created_round int, parent_slot int, origin string", ("run_id", "seed", "slot"), "ignore", ("prompt_hash", "created_round", "parent_slot", "origin"), SlotConflict),
    "proposals": Table("run_id string, seed int, round int, attempt int, meta_prompt_hash string, error_item_idxs array<int>, gen_key string, parsed_prompt_hash string, valid boolean, violations array<string>", ("run_id", "seed", "round", "attempt"), "replace"),
    "trajectory_rounds": Table("run_id string, seed int, round int, incumbent_slot int, candidate_slot int, inc_dev_acc double, cand_dev_acc double, advanced boolean, is_fallback boolean, n_attempts int, completed_at timestamp", ("run_id", "seed", "round"), "replace"),
    "generations": Table("gen_key string, engine_fp string, model_id string, model_revision string, rendered_sha string, system_hash string, user_hash string, decoding_json string, seed long, nonce string, response string, finish_reason string, n_prompt_tokens int, n_completion_tokens int, latency_ms double, batch_id string, created_at timestamp", ("gen_key",), "ignore"),
    "cells": Table(f"{_CELL}, gen_key string, physical boolean", tuple(c.split()[0] for c in _CELL.split(", ")), "ignore", ("gen_key",), CellConflict),
    "scores": Table("gen_key string, extractor string, gold string, ext_hash string, extracted string, method string, span_start int, span_end int, correct boolean", ("gen_key", "extractor", "gold"), "ext_hash"),
    "ledger": Table("id long, run_id string, seed int, stage string, purpose string, round int, n_requested int, n_executed int, n_cache_hits int, prompt_tokens long, completion_tokens long, wall_s double, created_at timestamp", ("id",), "append"),
    "stage_status": Table("run_id string, stage string, seed int, n_planned int, n_done int, status string, updated_at timestamp", ("run_id", "stage", "seed"), "replace"),
    "shard_log": Table("seq long, path string, n_rows long, sha256 string", ("seq",), "replace"),
    "audit_results": Table("run_id string, decoding_id string, slot int, repeat int, pct_text_identical double, pct_correct_flip double, n int", ("run_id", "decoding_id", "slot", "repeat"), "replace"),
    "analysis_results": Table("analysis_id string, name string, payload_json string, created_at timestamp", ("analysis_id", "name"), "replace"),
    "interactive_events": Table("id long, created_at timestamp, backend string, seed int, slot int, env_id string, item_idx int, gen_key string, note string", ("id",), "append"),
}


class Files:
    """The few file operations the store needs, on whatever file system a path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside and renames, so that no reader sees a part."""
        beside = self._path(path + ".tmp")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(self._path(path), False)
        if not self._fs.rename(beside, self._path(path)):
            raise OSError(f"could not rename {path}.tmp")

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []


class Store:
    """A store at ``root``; opened empty where there is none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        head = f"{self.root}/manifest.json"
        self.manifest = json.loads(self.files.read(head)) if self.files.exists(head) else {"schema": SCHEMA_VERSION, "commit": 0, "tables": {}}
        if self.manifest["schema"] != SCHEMA_VERSION:
            raise StoreError(f"the store has schema {self.manifest['schema']}, this code {SCHEMA_VERSION}")

    # reading

    def schema(self, name: str) -> StructType:
        return self.spark.createDataFrame([], _table(name).schema).schema

    def columns(self, name: str) -> list[str]:
        return self.schema(name).names

    def read(self, name: str, where: Mapping[str, object] | None = None, order: bool = False) -> DataFrame:
        """A table, with equality predicates; ``order`` sorts by key."""
        path = self.manifest["tables"].get(name)
        schema = self.schema(name)
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{path}") if path else self.spark.createDataFrame([], schema)
        for column, value in (where or {}).items():
            df = df.where(F.col(column).eqNullSafe(F.lit(value)))
        return df.orderBy(*_table(name).keys) if order else df

    def first(self, name: str, n: int) -> DataFrame:
        """The first ``n`` rows by key."""
        return self.read(name, order=True).limit(n)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows whose values in the columns of ``keys`` (any part of the key, say a prefix) are among them."""
        on = keys.columns
        rows = self.read(name).withColumn("_k", F.struct(*on))
        known = keys.distinct().select(F.struct(*on).alias("_k"), F.lit(True).alias("_hit"))
        return join_small(rows, known, "_k", F.xxhash64(*_table(name).keys), "inner").drop("_k", "_hit")

    def existing(self, name: str, keys: DataFrame) -> DataFrame:
        """The distinct ones of ``keys`` that the table has."""
        return keys.distinct().join(self.read(name).select(*keys.columns).distinct(), keys.columns, "left_semi")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def runs(self) -> list[str]:
        return [r["run_id"] for r in self.read("runs").select("run_id").orderBy("run_id").toLocalIterator()]

    def meta(self, prefix: str = "") -> DataFrame:
        return self.read("meta").where(F.col("key").startswith(prefix))

    def sql(self, text: str, **values: object) -> DataFrame:
        """SQL over the tables, with ``:name`` for values."""
        known = {name: self.read(name) for name in TABLES if f"{{{name}}}" in text}
        return self.spark.sql(text, args=values, **known)

    def check(self) -> dict[str, str]:
        """{table: what is wrong}: unreadable versions and repeated keys; empty if all is well."""
        out = {}
        for name in self.manifest["tables"]:
            keys = _table(name).keys
            repeated = self.read(name).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
            if repeated:
                out[name] = "repeated keys"
        return out

    # writing

    def write(self, rows: Mapping[str, DataFrame], order: str | None = None) -> None:
        """Commits rows of one or more tables together, each by its policy.

        Among incoming rows of one key the first by ``order`` (a column; else the least
        row) wins under *ignore*, the last under *replace*.
        """
        pointed = dict(self.manifest["tables"])
        number = self.manifest["commit"] + 1
        for name, new in rows.items():
            spec = _table(name)
            extra = set(new.columns) - set(self.columns(name)) - ({order} if order else set())
            if extra:
                raise StoreError(f"{name} has no columns {sorted(extra)}")
            missing = [k for k in spec.keys if k not in new.columns]
            if missing or new.where(F.exists(F.array(*[F.col(k).isNull() for k in spec.keys]), lambda x: x)).limit(1).count():
                raise StoreError(f"{name}: a key column is missing or null {missing}")
            pointed[name] = f"{name}/v{number:08d}-{uuid.uuid4().hex[:8]}"  # no two writers share a folder
            self._merged(name, spec, new, order).write.mode("overwrite").parquet(f"{self.root}/{pointed[name]}")
        self._publish({**self.manifest, "commit": number, "tables": pointed})

    def _merged(self, name: str, spec: Table, new: DataFrame, order: str | None) -> DataFrame:
        stored, keys, schema = self.read(name), list(spec.keys), self.schema(name)
        rank = F.col(order) if order else F.xxhash64(*[F.col(c).cast("string") if not str(t).startswith("array") else F.to_json(F.col(c)) for c, t in new.dtypes])
        ranked = new.withColumn("_rank", rank)
        if spec.guarded:
            self._guard(name, spec, stored, new)
        full = lambda df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        if spec.policy == "append":
            return stored.unionByName(full(new))
        if spec.policy == "ignore":
            return insert_ignore(stored, full(first_per_key(ranked, keys, [F.col("_rank")])), keys, [F.lit(0)])
        if spec.policy == "replace":
            late = insert_replace(ranked.limit(0), ranked, keys, "_rank")
            kept = stored.join(late.select(*keys), keys, "left_anti")
            return kept.unionByName(full(late))
        return full(upsert_if_changed(stored, full(insert_replace(ranked.limit(0), ranked, keys, "_rank")), keys, spec.policy))

    def _guard(self, name: str, spec: Table, stored: DataFrame, new: DataFrame) -> None:
        bad = conflicting(stored, new, spec).limit(1).collect()
        if bad:
            raise spec.conflict(f"{name}: stored with other values: {bad[0].asDict()}")

    def _publish(self, manifest: dict) -> None:
        head = f"{self.root}/manifest.json"
        if self.files.exists(head) and json.loads(self.files.read(head))["commit"] != self.manifest["commit"]:
            raise StoreError("another writer has committed meanwhile")
        self.files.write(head, json.dumps(manifest, sort_keys=True))
        self.manifest = manifest

    def ensure_run(self, run_id: str, config_hash: str, config_json: str = "{}", plan_hash: str | None = None, provenance_json: str | None = None, engine_fp: str | None = None, synthetic: bool = False, allow_config_change: bool = False, allow_engine_change: bool = False) -> dict:
        """Creates a run or resumes it; the stored row.

        Another configuration or engine raises unless allowed; changes are kept as
        events in ``meta``.  ``synthetic`` sticks, the plan follows the latest, the
        provenance stays the first.
        """
        found = self.read("runs", {"run_id": run_id}).collect()  # a key: one row at most
        new = {"run_id": run_id, "config_json": config_json, "config_hash": config_hash, "plan_hash": plan_hash, "provenance_json": provenance_json, "engine_fp": engine_fp, "synthetic": synthetic}
        events = []
        if found:
            old = found[0].asDict()
            if old["config_hash"] != config_hash and not allow_config_change:
                raise ConfigMismatch(f"{run_id}: configuration {old['config_hash']}, now {config_hash}")
            if engine_fp and old["engine_fp"] and old["engine_fp"] != engine_fp and not allow_engine_change:
                raise EngineMismatch(f"{run_id}: engine {old['engine_fp']}, now {engine_fp}")
            for what, column in (("config_change", "config_hash"), ("engine_change", "engine_fp"), ("plan_change", "plan_hash")):
                if old[column] and new[column] and old[column] != new[column]:
                    events.append((what, json.dumps({"run_id": run_id, "old": old[column], "new": new[column]}, sort_keys=True)))
            new |= {"plan_hash": plan_hash or old["plan_hash"], "provenance_json": old["provenance_json"] or provenance_json, "engine_fp": engine_fp or old["engine_fp"], "synthetic": old["synthetic"] or synthetic}
        columns = [c for c in self.columns("runs") if c != "created_at"]
        schema = ", ".join(part for part in TABLES["runs"].schema.split(", ") if not part.startswith("created_at"))
        row = self.spark.createDataFrame([tuple(new[c] for c in columns)], schema).withColumn("created_at", F.lit(found[0]["created_at"]).cast("timestamp") if found else F.current_timestamp())
        rows = {"runs": row}
        if events:
            past = self.meta().where(F.col("key").rlike("^(config|engine|plan)_change:")).count()
            rows["meta"] = self.spark.createDataFrame([(f"{what}:{past + i}", value) for i, (what, value) in enumerate(events)], "key string, value string")
        self.write(rows)
        return new

    def backup(self, target: str) -> Store:
        """A copy of what is committed now; its manifest is written last."""
        copy = Store(self.spark, target)
        pointed = {}
        for name in self.manifest["tables"]:
            pointed[name] = f"{name}/v{self.manifest['commit']:08d}-{uuid.uuid4().hex[:8]}"
            self.read(name).write.mode("overwrite").parquet(f"{copy.root}/{pointed[name]}")
        copy._publish({**self.manifest, "tables": pointed})
        return copy


def _table(name: str) -> Table:
    if name not in TABLES:
        raise StoreError(f"no table {name!r}")
    return TABLES[name]


def conflicting(stored: DataFrame, new: DataFrame, spec: Table) -> DataFrame:
    """Keys that both have with other values in a guarded column, and the names of those columns."""
    names = [c for c in spec.guarded if c in new.columns]
    old = stored.select(*spec.keys, *[F.col(c).alias(f"_old_{c}") for c in names])
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(c)) for c in names]))
    return new.join(old, list(spec.keys)).withColumn("differing", differ).where(F.size("differing") > 0).select(*spec.keys, "differing")
