"""Queries over the stored log: scans, joins, merges, guards, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.answers import canonical_gold, extract_strict, last_hash_line
from ledgerloom.functions.hashing import canonical_object, content_key, derive_seed, head32, json_text
from ledgerloom.functions.lenient import extract_lenient
from ledgerloom.operators.merge import conflicts, first_per_key, insert_ignore, insert_replace, row_digest, sequence_gaps, upsert_if_changed
from ledgerloom.operators.skew import hot_keys, salted_join
from ledgerloom.registry import query
from ledgerloom.sources.tables import table

CELL_KEY = ["run_id", "seed", "split", "decoding_id", "slot", "draw_kind", "draw", "item_idx"]
_KEYS = ", ".join(CELL_KEY)


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Items by key; of repeated rows with other texts the least counts."""
    rows = table(spark, d, "items", "split", "idx", *columns)
    return rows.groupBy("split", "idx").agg(F.min(F.struct(*columns)).alias("r")).select("split", "idx", "r.*")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells by key, first write (least row) wins."""
    rows = table(spark, d, "cells")
    return rows.groupBy(*CELL_KEY).agg(F.min(F.struct("gen_key", "physical")).alias("r")).select(*CELL_KEY, "r.*")


def generations(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Generations by key, narrowed before the shuffle."""
    rows = table(spark, d, "generations", "gen_key", *columns)
    return rows.groupBy("gen_key").agg(F.min(F.struct(*columns)).alias("r")).select("gen_key", "r.*")


C = f"(SELECT {_KEYS}, min(gen_key) AS gen_key, bool_or(physical) AS physical FROM (SELECT DISTINCT * FROM cells) GROUP BY ALL)"
I = "(SELECT split, idx, min(question) AS question, min(answer_text) AS answer_text, min(gold) AS gold, min(source) AS source FROM (SELECT DISTINCT * FROM items) GROUP BY ALL)"
G = "(SELECT DISTINCT * EXCLUDE (seed) FROM generations)"


@query(f"SELECT split, idx, gold, length(question) AS n_question FROM {I}")
def items_by_key(spark, d):
    return items(spark, d, "question", "gold").select("split", "idx", "gold", F.length("question").alias("n_question"))


@query(
    r"""SELECT split, idx, gold, told FROM (SELECT split, idx, gold, CASE WHEN contains(answer_text, '####') THEN
    replace(regexp_replace(split_part(list_extract(string_split(answer_text, '####'), -1), chr(10), 1), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), ',', '') END AS told FROM """
    + I
    + r""") WHERE told IS NULL OR TRY_CAST(replace(gold, ',', '') AS DOUBLE) IS DISTINCT FROM TRY_CAST(told AS DOUBLE)"""
)
def items_gold_violations(spark, d):
    """Items whose gold answer isn't what their worked answer ends with."""
    told = F.regexp_replace(last_hash_line(F.col("answer_text")), ",", "")
    rows = items(spark, d, "answer_text", "gold").withColumn("told", told)
    return rows.where(F.col("told").isNull() | ~canonical_gold(F.col("gold")).eqNullSafe(canonical_gold(F.col("told")))).select("split", "idx", "gold", "told")


@query("SELECT s.run_id, s.seed, s.slot, s.origin, s.parent_slot, length(p.text) AS n_chars FROM (SELECT DISTINCT * FROM slots) s LEFT JOIN (SELECT DISTINCT * FROM prompts) p USING (prompt_hash)")
def slots_with_prompts(spark, d):
    prompts = table(spark, d, "prompts").groupBy("prompt_hash").agg(F.min("text").alias("text"))
    slots = table(spark, d, "slots").distinct()
    return slots.join(prompts, "prompt_hash", "left").select("run_id", "seed", "slot", "origin", "parent_slot", F.length("text").alias("n_chars"))


@query(f"SELECT {_KEYS}, c.gen_key, g.model_id, g.finish_reason, length(g.response) AS n_response FROM {C} c JOIN {G} g USING (gen_key)")
def cells_drilldown(spark, d):
    g = generations(spark, d, "model_id", "finish_reason", "response").withColumn("n_response", F.length("response")).drop("response")
    c = table(spark, d, "cells", "gen_key")
    rows = salted_join(cells(spark, d), g, "gen_key", F.xxhash64(*CELL_KEY), "inner", hot=hot_keys(c, "gen_key"))
    return rows.select(*CELL_KEY, "gen_key", "model_id", "finish_reason", "n_response")


@query(f"SELECT DISTINCT c.gen_key, i.gold FROM {C} c JOIN {I} i ON i.split = c.split AND i.idx = c.item_idx")
def cells_gold(spark, d):
    i = items(spark, d, "gold").select(F.concat_ws("/", "split", "idx").alias("item"), "gold")
    c = table(spark, d, "cells", "split", "item_idx", "gen_key").select(F.concat_ws("/", "split", "item_idx").alias("item"), "gen_key").distinct()
    return salted_join(c, i, "item", F.col("gen_key"), "inner").select("gen_key", "gold").distinct()


@query(
    f"""WITH scored AS (SELECT gen_key FROM {G} WHERE lower(finish_reason) = 'stop')
    SELECT DISTINCT c.gen_key, i.gold FROM {C} c JOIN {I} i ON i.split = c.split AND i.idx = c.item_idx
    JOIN {G} g USING (gen_key) WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.gen_key = c.gen_key)"""
)
def unscored_anti_join(spark, d):
    """(gen_key, gold) still to be scored, where the generations that stopped by themselves have been."""
    g = table(spark, d, "generations", "gen_key", "finish_reason").distinct()
    scored = g.where(F.lower("finish_reason") == "stop").select("gen_key")
    return cells_gold(spark, d).join(g.select("gen_key").distinct(), "gen_key", "left_semi").join(scored, "gen_key", "left_anti")


@query(
    f"""SELECT c.run_id, count(*) AS n_requested, count(DISTINCT c.gen_key) AS n_keys, count(DISTINCT CASE WHEN g.gen_key IS NULL THEN c.gen_key END) AS n_misses
    FROM {C} c LEFT JOIN (SELECT DISTINCT gen_key FROM generations WHERE finish_reason IS NOT NULL) g USING (gen_key) GROUP BY 1"""
)
def cache_hits_misses(spark, d):
    """Per run: requests, distinct keys, and keys that the finished generations lack."""
    done = table(spark, d, "generations", "gen_key", "finish_reason").where("finish_reason IS NOT NULL").select("gen_key").distinct().withColumn("hit", F.lit(True))
    rows = cells(spark, d).select("run_id", "gen_key").groupBy("run_id", "gen_key").agg(F.count(F.lit(1)).alias("n")).join(done, "gen_key", "left")
    return rows.groupBy("run_id").agg(F.sum("n").alias("n_requested"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("hit").isNull()).alias("n_misses"))


# The log breaks none of the guards.  So that they are seen to fire, violations are planted: rows derived from some of a table's own.


def planted(rows: DataFrame, where: str, **changed: str) -> DataFrame:
    """``rows`` and, again, those of them for which ``where`` holds, with columns replaced by SQL expressions."""
    names = [f"({changed[c]}) AS {c}" if c in changed else c for c in rows.columns]
    return rows.unionByName(rows.where(where).selectExpr(*names))


def _planted_sql(table_: str, columns: str, where: str, **changed: str) -> str:
    names = ", ".join(f"({changed[c]}) AS {c}" if c in changed else c for c in columns.split(", "))
    return f"(SELECT {columns} FROM {table_} UNION ALL SELECT {names} FROM {table_} WHERE {where})"


_CELLS_PLANTED = _planted_sql("cells", f"{_KEYS}, gen_key", "substr(gen_key, 1, 1) = '0'", gen_key="reverse(gen_key)")


@query(f"SELECT {_KEYS}, count(DISTINCT gen_key) AS n_values FROM {_CELLS_PLANTED} GROUP BY ALL HAVING count(DISTINCT gen_key) > 1")
def cell_conflicts(spark, d):
    """Cells planned with another generation than the stored one; a sixteenth is planted."""
    return conflicts(planted(table(spark, d, "cells", *CELL_KEY, "gen_key"), "substr(gen_key, 1, 1) = '0'", gen_key="reverse(gen_key)"), CELL_KEY, "gen_key")


@query(f"SELECT split, idx, count(DISTINCT question) AS n_values FROM {_planted_sql('items', 'split, idx, question', 'idx % 37 = 0', question="question || ' '")} GROUP BY ALL HAVING count(DISTINCT question) > 1")
def item_conflicts(spark, d):
    """Items whose question differs from the stored one; every 37th is planted."""
    return conflicts(planted(table(spark, d, "items", "split", "idx", "question"), "idx % 37 = 0", question="question || ' '"), ["split", "idx"], "question")


@query(f"SELECT run_id, seed, slot, count(DISTINCT prompt_hash) AS n_values FROM {_planted_sql('slots', 'run_id, seed, slot, prompt_hash', 'seed = 0 AND slot = 1', prompt_hash='reverse(prompt_hash)')} GROUP BY ALL HAVING count(DISTINCT prompt_hash) > 1")
def slot_conflicts(spark, d):
    """Slots that hold another prompt than the stored one; slot 1 of seed 0 is planted."""
    return conflicts(planted(table(spark, d, "slots", "run_id", "seed", "slot", "prompt_hash"), "seed = 0 AND slot = 1", prompt_hash="reverse(prompt_hash)"), ["run_id", "seed", "slot"], "prompt_hash")


@query(
    f"""SELECT c.run_id, count(DISTINCT g.engine_fp) AS n_values FROM cells c JOIN {_planted_sql("generations", "gen_key, engine_fp", "substr(gen_key, 1, 2) = '0a'", engine_fp="'other'")} g USING (gen_key)
    GROUP BY 1 HAVING count(DISTINCT g.engine_fp) > 1"""
)
def run_engine_conflicts(spark, d):
    """Runs whose generations come from more than one engine; some generations of another are planted."""
    g = planted(table(spark, d, "generations", "gen_key", "engine_fp").distinct(), "substr(gen_key, 1, 2) = '0a'", engine_fp="'other'")
    return conflicts(table(spark, d, "cells", "run_id", "gen_key").distinct().join(g, "gen_key"), ["run_id"], "engine_fp")


@query(
    f"""SELECT sha256(question) AS question_hash, count(DISTINCT gold) AS n_values FROM (SELECT question, CAST(replace(gold, ',', '') AS DOUBLE) AS gold FROM {_planted_sql("items", "idx, question, gold", "idx % 41 = 0", gold="'-1'")})
    GROUP BY 1 HAVING count(DISTINCT gold) > 1"""
)
def answer_key_conflicts(spark, d):
    """Questions, by hash, with more than one gold answer; every 41st is planted."""
    rows = planted(table(spark, d, "items", "idx", "question", "gold"), "idx % 41 = 0", gold="'-1'")
    return conflicts(rows.select(F.sha2("question", 256).alias("question_hash"), canonical_gold(F.col("gold")).alias("gold")), ["question_hash"], "gold")


@query("SELECT sha256(question) AS user_hash, CAST(replace(min(gold), ',', '') AS DOUBLE) AS gold, count(DISTINCT split || '/' || idx) AS n_items FROM items GROUP BY 1")
def answer_key(spark, d):
    """The gold answer behind the hash of every question."""
    rows = table(spark, d, "items", "split", "idx", "question", "gold").select(F.sha2("question", 256).alias("user_hash"), "gold", F.concat_ws("/", "split", "idx").alias("item"))
    return rows.groupBy("user_hash").agg(canonical_gold(F.min("gold")).cast("double").alias("gold"), F.count_distinct("item").alias("n_items"))


@query(
    """SELECT DISTINCT a.split AS split_a, a.idx AS idx_a, b.split AS split_b, b.idx AS idx_b FROM items a JOIN items b
    ON a.question = b.question AND a.split < b.split"""
)
def split_leaks_exact(spark, d):
    """Equal questions in two splits."""
    rows = table(spark, d, "items", "split", "idx", "question").select("split", "idx", F.sha2("question", 256).alias("h")).distinct()
    a = rows.select("h", F.col("split").alias("split_a"), F.col("idx").alias("idx_a"))
    b = rows.select("h", F.col("split").alias("split_b"), F.col("idx").alias("idx_b"))
    return salted_join(a, b, "h", F.xxhash64("split_a", "idx_a"), "inner").where("split_a < split_b").select("split_a", "idx_a", "split_b", "idx_b").distinct()


_UNSEEDED = {"where": "substr(gen_key, 1, 1) = 'f' AND seed IS NOT NULL", "gen_key": "'x' || gen_key", "seed": "CAST(NULL AS BIGINT)"}


@query(f"SELECT gen_key FROM (SELECT DISTINCT * FROM {_planted_sql('generations', 'gen_key, decoding_json, seed', **_UNSEEDED)}) WHERE CAST(json_extract(decoding_json, '$.temperature') AS DOUBLE) > 0 AND seed IS NULL")
def unseeded_sampling(spark, d):
    """Sampled generations without a seed; some are planted."""
    rows = planted(table(spark, d, "generations", "gen_key", "decoding_json", "seed").withColumn("seed", F.col("seed").cast("bigint")), **_UNSEEDED).distinct()
    return rows.where((F.get_json_object("decoding_json", "$.temperature").cast("double") > 0) & F.col("seed").isNull()).select("gen_key")


_SWAPPED = {"where": "substr(gen_key, 1, 1) = '0'", "decoding_id": "CASE WHEN decoding_id = 'greedy' THEN 't02' ELSE 'greedy' END"}


@query(
    f"""SELECT DISTINCT c.gen_key, c.decoding_id, json_extract_string(g.decoding_json, '$.id') AS generated_as FROM {_planted_sql("cells", "gen_key, decoding_id", **_SWAPPED)} c JOIN {G} g USING (gen_key)
    WHERE c.decoding_id <> json_extract_string(g.decoding_json, '$.id')"""
)
def decoding_mismatches(spark, d):
    """Cells whose decoding isn't the one their output was generated with; a sixteenth is planted."""
    g = generations(spark, d, "decoding_json").select("gen_key", F.get_json_object("decoding_json", "$.id").alias("generated_as"))
    c = planted(table(spark, d, "cells", "gen_key", "decoding_id").distinct(), **_SWAPPED).distinct()
    return c.join(g, "gen_key").where("decoding_id <> generated_as").select("gen_key", "decoding_id", "generated_as")


@query(
    f"""WITH stored AS (SELECT * FROM {C} WHERE draw_kind <> 'audit')
    SELECT {_KEYS}, gen_key, physical FROM stored UNION ALL
    SELECT {_KEYS}, gen_key, physical FROM {C} c WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE {" AND ".join(f"s.{k} = c.{k}" for k in CELL_KEY)})"""
)
def insert_ignore_cells(spark, d):
    """The audit batch, with all other cells again, added to the stored cells: existing keys stay."""
    rows = cells(spark, d)
    return insert_ignore(rows.where("draw_kind <> 'audit'"), table(spark, d, "cells"), CELL_KEY, [F.col("gen_key")])


@query(
    """SELECT run_id, seed, stage, purpose, round, n_requested FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, seed, stage, purpose, round ORDER BY id DESC) AS r FROM (SELECT DISTINCT * FROM ledger)) WHERE r = 1"""
)
def insert_replace_ledger(spark, d):
    """Ledger entries as last written for each coordinate."""
    rows = table(spark, d, "ledger", "id", "run_id", "seed", "stage", "purpose", "round", "n_requested")
    keys = ["run_id", "seed", "stage", "purpose", "round"]
    return insert_replace(rows.where("stage <> 'audit'"), rows.where("stage = 'audit'"), keys, "id").select(*keys, "n_requested")


@query(
    f"""WITH old AS (SELECT gen_key, length(response) AS score, 'a' AS version FROM {G} WHERE lower(finish_reason) = 'stop'),
    new AS (SELECT gen_key, n_completion_tokens AS score, CASE WHEN model_id LIKE '%-base' THEN 'b' ELSE 'a' END AS version FROM {G})
    SELECT gen_key, CASE WHEN n.gen_key IS NULL OR (o.gen_key IS NOT NULL AND o.version = n.version) THEN o.score ELSE n.score END AS score,
    CASE WHEN n.gen_key IS NULL OR (o.gen_key IS NOT NULL AND o.version = n.version) THEN o.version ELSE n.version END AS version
    FROM old o FULL JOIN new n USING (gen_key)"""
)
def upsert_by_version(spark, d):
    """Scores are replaced only where the version of their rule changed."""
    g = generations(spark, d, "finish_reason", "model_id", "response", "n_completion_tokens")
    old = g.where(F.lower("finish_reason") == "stop").select("gen_key", F.length("response").alias("score"), F.lit("a").alias("version"))
    new = g.select("gen_key", F.col("n_completion_tokens").alias("score"), F.when(F.col("model_id").endswith("-base"), "b").otherwise("a").alias("version"))
    return upsert_if_changed(old, new, ["gen_key"], "version")


@query(
    """SELECT p AS after, v AS before, v - p - 1 AS n_missing FROM (
    SELECT id AS v, lag(id) OVER (ORDER BY id) AS p FROM (SELECT DISTINCT id FROM ledger WHERE stage <> 'audit' AND id IS NOT NULL)) WHERE v - p > 1"""
)
def sequence_gaps_ledger(spark, d):
    """Missing numbers in the log when the audit entries are lost."""
    return sequence_gaps(table(spark, d, "ledger", "id", "stage").where("stage <> 'audit'"), "id", 1)


def _digest_sql(name: str, columns: list[str]) -> str:
    parts = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in columns)
    return f"SELECT '{name}' AS tab, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', {parts})), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM (SELECT DISTINCT {', '.join(columns)} FROM {name})"


_DIGESTS = {
    "items": ["split", "idx", "question", "answer_text", "gold"],
    "prompts": ["prompt_hash", "text"],
    "slots": ["run_id", "seed", "slot", "prompt_hash", "created_round", "parent_slot", "origin"],
    "generations": ["gen_key", "engine_fp", "model_id", "system_hash", "user_hash", "seed", "response", "finish_reason"],
    "cells": [*CELL_KEY, "gen_key"],
    "ledger": ["id", "run_id", "seed", "stage", "purpose", "round", "n_requested", "n_executed", "n_cache_hits"],
}


@query(" UNION ALL ".join(_digest_sql(n, c) for n, c in _DIGESTS.items()))
def content_digest(spark, d):
    """A digest of each table's rows that doesn't depend on their order, timestamps left out."""
    parts = []
    for name, columns in _DIGESTS.items():
        rows = table(spark, d, name, *columns).select(row_digest(columns).alias("h")).distinct()  # digests, not texts, are shuffled
        parts.append(rows.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n_rows"), F.sum(head32(F.col("h"))).alias("digest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tab", "n_rows", "digest")


@query(
    """SELECT purpose, stage, CAST(sum(n_requested) AS BIGINT) AS n_requested, CAST(sum(n_executed) AS BIGINT) AS n_executed,
    CAST(sum(n_cache_hits) AS BIGINT) AS n_cache_hits FROM (SELECT DISTINCT * FROM ledger) GROUP BY GROUPING SETS ((purpose), (stage), ())"""
)
def ledger_totals(spark, d):
    """Requests by purpose, by stage and in total."""
    rows = table(spark, d, "ledger").distinct().groupingSets([["purpose"], ["stage"], []], "purpose", "stage")
    return rows.agg(*[F.sum(c).alias(c) for c in ("n_requested", "n_executed", "n_cache_hits")])


@query(
    """SELECT stage, count(*) AS n_entries, sum(completion_tokens) / sum(wall_s) AS tokens_per_s, CASE WHEN bool_and(n_executed IS NOT NULL) THEN sum(completion_tokens) / CAST(sum(n_executed) AS DOUBLE) END AS tokens_per_request
    FROM (SELECT DISTINCT * FROM ledger) WHERE completion_tokens IS NOT NULL AND wall_s > 0 AND (n_executed IS NULL OR n_executed > 0) GROUP BY 1"""
)
def ledger_calibration(spark, d):
    """Measured throughput and completion length by stage; the length is null where an entry doesn't tell what it executed."""
    rows = table(spark, d, "ledger").distinct().where("completion_tokens IS NOT NULL AND wall_s > 0 AND (n_executed IS NULL OR n_executed > 0)")
    length = F.when(F.bool_and(F.col("n_executed").isNotNull()), F.sum("completion_tokens") / F.sum("n_executed").cast("double"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n_entries"), (F.sum("completion_tokens") / F.sum("wall_s")).alias("tokens_per_s"), length.alias("tokens_per_request"))


_MISCOUNTED = {"where": "id % 19 = 0", "n_executed": "n_executed + 1"}


@query(f"SELECT DISTINCT id FROM {_planted_sql('ledger', 'id, n_requested, n_executed, n_cache_hits', **_MISCOUNTED)} WHERE n_requested <> n_executed + n_cache_hits")
def ledger_violations(spark, d):
    """Entries whose requests aren't executed ones and hits; every 19th is planted."""
    rows = planted(table(spark, d, "ledger", "id", "n_requested", "n_executed", "n_cache_hits"), **_MISCOUNTED)
    return rows.where("n_requested <> n_executed + n_cache_hits").select("id").distinct()


@query(
    f"""WITH a AS (SELECT * FROM {C} WHERE draw_kind = 'audit'), r AS (SELECT DISTINCT run_id, seed, split, decoding_id, slot, item_idx, gen_key FROM {C} WHERE draw_kind = 'round'),
    p AS (SELECT a.run_id, a.decoding_id, x.response AS t1, y.response AS t2 FROM a JOIN r USING (run_id, seed, split, decoding_id, slot, item_idx)
    JOIN {G} x ON x.gen_key = a.gen_key JOIN {G} y ON y.gen_key = r.gen_key)
    SELECT decoding_id, count(*) AS n, avg(CASE WHEN t1 = t2 THEN 100.0 ELSE 0.0 END) AS pct_text_identical FROM p GROUP BY 1"""
)
def audit_identity(spark, d):
    """How often an audited rerun gives the text of its round cell."""
    c = cells(spark, d)
    on = ["run_id", "seed", "split", "decoding_id", "slot", "item_idx"]
    audit = c.where("draw_kind = 'audit'").select(*on, F.col("gen_key").alias("k1"))
    rounds = c.where("draw_kind = 'round'").select(*on, F.col("gen_key").alias("k2")).distinct()
    # texts are compared by their hash, so that they aren't shuffled
    h = generations(spark, d, "response").select("gen_key", F.sha2("response", 256).alias("h"))
    pairs = audit.join(rounds, on).join(h.select(F.col("gen_key").alias("k1"), F.col("h").alias("h1")), "k1").join(h.select(F.col("gen_key").alias("k2"), F.col("h").alias("h2")), "k2")
    return pairs.groupBy("decoding_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("h1") == F.col("h2"), 100.0).otherwise(0.0)).alias("pct_text_identical"))


@query(
    f"""SELECT run_id, seed, split, decoding_id, slot, draw_kind, draw, count(*) AS n_items, bool_or(physical) AS physical,
    avg(CASE WHEN lower(finish_reason) IN ('length', 'max_tokens') THEN 1.0 ELSE 0.0 END) AS truncated
    FROM {C} c JOIN {G} g USING (gen_key) GROUP BY ALL"""
)
def cell_completeness(spark, d):
    """Each cell group: its items, whether any was physical, and the share cut by the token limit."""
    g = table(spark, d, "generations", "gen_key", "finish_reason").groupBy("gen_key").agg(F.min("finish_reason").alias("finish_reason"))
    rows = salted_join(cells(spark, d), g, "gen_key", F.xxhash64(*CELL_KEY), "inner", hot=hot_keys(table(spark, d, "cells", "gen_key"), "gen_key"))
    limited = F.when(F.lower("finish_reason").isin("length", "max_tokens"), 1.0).otherwise(0.0)
    return rows.groupBy(*CELL_KEY[:-1]).agg(F.count(F.lit(1)).alias("n_items"), F.bool_or("physical").alias("physical"), F.avg(limited).alias("truncated"))


@query(
    f"""WITH r AS (SELECT * FROM {C} WHERE draw_kind = 'round')
    SELECT a.decoding_id, b.draw - a.draw AS age, count(*) AS n, avg(CASE WHEN a.gen_key = b.gen_key THEN 1.0 ELSE 0.0 END) AS same_gen_frac
    FROM r a JOIN r b USING (run_id, seed, split, decoding_id, slot, item_idx) WHERE a.draw < b.draw GROUP BY ALL"""
)
def same_generation_by_age(spark, d):
    """How often cells of one prompt and item share their output, by the rounds between them."""
    r = cells(spark, d).where("draw_kind = 'round'")
    on = ["run_id", "seed", "split", "decoding_id", "slot", "item_idx"]
    a, b = r.select(*on, F.col("draw").alias("r1"), F.col("gen_key").alias("k1")), r.select(*on, F.col("draw").alias("r2"), F.col("gen_key").alias("k2"))
    pairs = a.join(b, on).where("r1 < r2")
    return pairs.groupBy("decoding_id", (F.col("r2") - F.col("r1")).alias("age")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("k1") == F.col("k2"), 1.0).otherwise(0.0)).alias("same_gen_frac"))


@query(
    """WITH RECURSIVE s AS (SELECT DISTINCT run_id, seed, slot, parent_slot FROM slots), t AS (
    SELECT run_id, seed, slot, 0 AS depth, slot AS root FROM s WHERE parent_slot IS NULL UNION ALL
    SELECT s.run_id, s.seed, s.slot, t.depth + 1, t.root FROM s JOIN t ON t.run_id = s.run_id AND t.seed = s.seed AND t.slot = s.parent_slot)
    SELECT run_id, seed, slot, depth, root FROM t"""
)
def slot_lineage(spark, d):
    """Depth of each slot below the initial prompt of its trajectory."""
    rows = table(spark, d, "slots", "run_id", "seed", "slot", "parent_slot").distinct()
    return spark.sql(
        """WITH RECURSIVE t(run_id, seed, slot, depth, root) AS (
        SELECT run_id, seed, slot, 0, slot FROM {s} WHERE parent_slot IS NULL UNION ALL
        SELECT s.run_id, s.seed, s.slot, t.depth + 1, t.root FROM {s} s JOIN t ON t.run_id = s.run_id AND t.seed = s.seed AND t.slot = s.parent_slot)
        SELECT * FROM t""",
        s=rows,
    )


BATCH, LENGTH_BUCKET = 32, 16


@query(
    f"""SELECT gen_key, decoding_id, CAST(floor((r - 1) / {BATCH}.0) AS BIGINT) AS batch FROM (
    SELECT gen_key, decoding_id, row_number() OVER (PARTITION BY decoding_id ORDER BY n_prompt_tokens // {LENGTH_BUCKET} DESC NULLS LAST, gen_key) AS r FROM (
    SELECT gen_key, min(json_extract_string(decoding_json, '$.id')) AS decoding_id, min(n_prompt_tokens) AS n_prompt_tokens FROM generations GROUP BY 1))"""
)
def batch_plan(spark, d):
    """Batches of 32 requests for each decoding: by length bucket from the longest, then by key, cut one after the other.

    The place in the order is the start of a slice (length bucket and first two digits
    of the key) plus the rank in it, so that no window spans a decoding.
    """
    g = table(spark, d, "generations", "gen_key", "decoding_json", "n_prompt_tokens").groupBy("gen_key").agg(F.min(F.get_json_object("decoding_json", "$.id")).alias("decoding_id"), F.min("n_prompt_tokens").alias("n"))
    rows = g.withColumn("bucket", F.coalesce(F.floor(F.col("n") / LENGTH_BUCKET), F.lit(-1))).withColumn("part", F.substring("gen_key", 1, 2))
    slices = rows.groupBy("decoding_id", "bucket", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("decoding_id").orderBy(F.desc("bucket"), "part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    starts = slices.select("decoding_id", "bucket", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("decoding_id", "bucket", "part").orderBy("gen_key")) - 1
    placed = rows.withColumn("rank", rank).join(starts, ["decoding_id", "bucket", "part"])
    return placed.select("gen_key", "decoding_id", F.floor((F.col("start") + F.col("rank")) / BATCH).alias("batch"))


_PARAMS = ("max_new_tokens", "repetition_penalty", "temperature", "top_k", "top_p")
_DECODING_SQL = "'{' || concat_ws(',', " + ", ".join(f"""'"{p}":' || json_extract(decoding_json, '$.{p}')""" for p in _PARAMS) + ") || '}'"
_KEY_SQL = f"""sha256('{{"decoding":' || {_DECODING_SQL} || ',"engine":' || to_json(engine_fp) || ',"model":' || to_json(model_id) || ',"nonce":' ||
    coalesce(to_json(nonce), 'null') || ',"prompt":' || to_json(rendered_sha) || ',"revision":' || to_json(model_revision) || ',"seed":' ||
    CASE WHEN CAST(json_extract(decoding_json, '$.temperature') AS DOUBLE) = 0 OR seed IS NULL THEN 'null' ELSE CAST(CAST(seed AS BIGINT) AS VARCHAR) END || ',"v":1}}')"""


@query(f"SELECT gen_key, {_KEY_SQL} AS content_key FROM (SELECT DISTINCT gen_key, decoding_json, engine_fp, model_id, nonce, rendered_sha, model_revision, seed FROM generations)")
def content_keys(spark, d):
    """Content-derived keys: greedy outputs ignore the seed, a nonce makes them distinct."""
    rows = table(spark, d, "generations", "gen_key", "decoding_json", "engine_fp", "model_id", "nonce", "rendered_sha", "model_revision", "seed").distinct()
    greedy = F.get_json_object("decoding_json", "$.temperature").cast("double") == 0
    seed = F.when(greedy | F.col("seed").isNull(), "null").otherwise(F.col("seed").cast("bigint").cast("string"))
    quoted = {name: json_text(F.col(column)) for name, column in (("engine", "engine_fp"), ("model", "model_id"), ("nonce", "nonce"), ("prompt", "rendered_sha"), ("revision", "model_revision"))}
    return rows.select("gen_key", content_key({**quoted, "v": F.lit("1"), "seed": seed, "decoding": canonical_object(F.col("decoding_json"), _PARAMS)}).alias("content_key"))


@query(
    f"""SELECT {_KEYS}, CAST('0x' || substr(sha256('sample|' || seed || '|' || split || '|' || decoding_id || '|' || slot || '|' || draw_kind || '|' || draw || '|' || item_idx), 1, 8) AS BIGINT) & 2147483647 AS derived_seed FROM {C}"""
)
def seed_derivation(spark, d):
    parts = [F.col(c) for c in CELL_KEY[1:]]
    return cells(spark, d).select(*CELL_KEY, derive_seed(F.lit("sample"), *parts).alias("derived_seed"))


_NUM = r"^-?\d+(\.\d+)?$"
_TRIM = r"'^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'"
_HASHED = f"regexp_replace(split_part(list_extract(string_split(response, '####'), -1), chr(10), 1), {_TRIM})"
_BOXED = r"list_extract(regexp_extract_all(response, '\\boxed\s*\{([^{}]*)\}', 1), -1)"
_STRICT = rf"""CASE WHEN contains(response, '####') AND len(regexp_extract_all(list_extract(string_split(response, '####'), -1), '\\boxed\s*\{{[^{{}}]*\}}')) = 0
    THEN regexp_replace({_HASHED}, '[\s\x{{00A0}}]*\.$', '') ELSE regexp_replace({_BOXED}, {_TRIM}) END"""


@query(rf"SELECT gen_key, CASE WHEN regexp_full_match(m, '-?\d+(\.\d+)?') THEN CAST(m AS DOUBLE) END AS value FROM (SELECT gen_key, {_STRICT} AS m FROM (SELECT DISTINCT gen_key, response FROM generations))")
def extract_strict_values(spark, d):
    """The strict extractor over all generations, as numbers."""
    rows = generations(spark, d, "response")
    return rows.select("gen_key", extract_strict(F.col("response")).cast("double").alias("value"))


@query()
def extract_lenient_values(spark, d):
    """The lenient extractor over all generations: canonical value and the stage that gave it."""
    rows = generations(spark, d, "response").withColumn("e", extract_lenient(F.coalesce("response", F.lit(""))))
    return rows.select("gen_key", F.col("e.value").alias("value"), F.col("e.method").alias("method"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(gen_key, model_id, decoding_id, gold, strict, lenient, method): both extractors graded on every generation with a known question."""
    i = table(spark, d, "items", "question", "gold").groupBy(F.sha2("question", 256).alias("user_hash")).agg(canonical_gold(F.min("gold")).alias("gold"))
    g = generations(spark, d, "user_hash", "model_id", "decoding_json", "response")
    text = F.coalesce("response", F.lit(""))
    g = g.select("gen_key", "user_hash", "model_id", F.get_json_object("decoding_json", "$.id").alias("decoding_id"), extract_strict(text).alias("v1"), extract_lenient(text).alias("v2"))
    rows = g.join(i, "user_hash")
    return rows.select("gen_key", "model_id", "decoding_id", "gold", F.coalesce(F.col("v1") == F.col("gold"), F.lit(False)).alias("strict"), F.coalesce(F.col("v2.value") == F.col("gold"), F.lit(False)).alias("lenient"), F.col("v2.method").alias("method"))


_SCORES = rf"""i AS (SELECT sha256(question) AS user_hash, CAST(replace(min(gold), ',', '') AS DOUBLE) AS gold FROM items GROUP BY 1),
g AS (SELECT DISTINCT gen_key, user_hash, model_id, json_extract_string(decoding_json, '$.id') AS decoding_id, response FROM generations),
s AS (SELECT gen_key, model_id, decoding_id, coalesce(CASE WHEN regexp_full_match(m, '-?\d+(\.\d+)?') THEN CAST(m AS DOUBLE) END = gold, false) AS correct FROM (SELECT *, {_STRICT} AS m FROM g JOIN i USING (user_hash)))"""


@query(f"WITH {_SCORES} SELECT model_id, decoding_id, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM s GROUP BY 1, 2")
def accuracy_by_model(spark, d):
    return scores(spark, d).groupBy("model_id", "decoding_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("strict").alias("n_correct"))


@query("SELECT 0 AS n_violations")
def strict_implies_lenient(spark, d):
    """What the strict extractor gets right, the lenient one must."""
    return scores(spark, d).agg(F.count_if(F.col("strict") & ~F.col("lenient")).cast("int").alias("n_violations"))


@query()
def extraction_methods(spark, d):
    """Stages of the lenient extractor: how often each decides, and how often rightly."""
    return scores(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if("lenient").alias("n_correct"))
