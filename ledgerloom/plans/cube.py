"""Outcomes measured in the log: cells joined to graded extractions, and the drift of stored scores over them.

A cell's generation is graded against the gold of the cell's own item.  A cell whose
generation or item is unknown has no outcome: it is absent, not wrong.  Both joins
have hot keys (one item may hold a tenth of the cells) and are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.answers import canonical_gold, extract_strict
from ledgerloom.functions.lenient import extract_lenient
from ledgerloom.functions.stats import rate
from ledgerloom.operators.skew import hot_keys, salted_join
from ledgerloom.plans.matrix import ENVS
from ledgerloom.plans.protocol import STORAGE_ENV
from ledgerloom.plans.store import _STRICT, C, CELL_KEY, G, I, cells, generations, items
from ledgerloom.registry import query

LIMIT_REASONS = ("length", "max_tokens")


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """(gen_key, strict, lenient, truncated): what both extractors read from every generation."""
    text = F.coalesce("response", F.lit(""))
    g = generations(spark, d, "response", "finish_reason")
    return g.select("gen_key", extract_strict(text).alias("strict"), extract_lenient(text)["value"].alias("lenient"), F.coalesce(F.lower("finish_reason").isin(*LIMIT_REASONS), F.lit(False)).cast("int").alias("truncated"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    """The keys of a cell, gen_key, physical, truncated, v1, v2 (0 or 1), one row for each cell with a known generation and item."""
    c = cells(spark, d).withColumn("_item", F.concat_ws("/", "split", "item_idx"))
    gold = items(spark, d, "gold").select(F.concat_ws("/", "split", "idx").alias("_item"), canonical_gold(F.col("gold")).alias("gold"))
    spread = F.xxhash64(*CELL_KEY)
    graded = salted_join(c, gold, "_item", spread, "inner", hot=hot_keys(c.select("_item"), "_item")).drop("_item")
    rows = salted_join(graded, extracted(spark, d), "gen_key", spread, "inner", hot=hot_keys(c.select("gen_key"), "gen_key"))
    right = lambda value: F.coalesce(F.col(value) == F.col("gold"), F.lit(False)).cast("int")
    return rows.select(*CELL_KEY, "gen_key", "physical", "truncated", right("strict").alias("v1"), right("lenient").alias("v2"))


def as_matrix(outcomes: DataFrame, run: Column, split: str = "test") -> DataFrame:
    """A run's measured cells in the form that the all-pairs and policy analyses take."""
    rows = outcomes.where((F.col("run_id") == run) & (F.col("split") == split))
    return rows.select("seed", F.col("decoding_id").alias("decoding"), "slot", "draw_kind", "draw", F.col("item_idx").alias("item"), "physical", "truncated", F.xxhash64("gen_key").alias("generation"), "v1", "v2")


_CELL = ", ".join(f"c.{k}" for k in CELL_KEY)
_CUBE = f"""g AS (SELECT gen_key, response, CASE WHEN lower(finish_reason) IN {LIMIT_REASONS} THEN 1 ELSE 0 END AS truncated FROM {G}),
    x AS (SELECT gen_key, truncated, CASE WHEN regexp_full_match(m, '-?\\d+(\\.\\d+)?') THEN CAST(m AS DOUBLE) END AS value FROM (SELECT *, {_STRICT} AS m FROM g)),
    cu AS (SELECT {_CELL}, c.gen_key, physical, truncated, CASE WHEN value = CAST(replace(i.gold, ',', '') AS DOUBLE) THEN 1 ELSE 0 END AS v1 FROM {C} c JOIN {I} i ON i.split = c.split AND i.idx = c.item_idx JOIN x USING (gen_key))"""


@query(f"WITH {_CUBE} SELECT * FROM cu")
def cube_outcomes(spark, d):
    """The measured cube under the strict extractor; SQL can't express the other."""
    return cube(spark, d).drop("v2")


@query(f"WITH {_CUBE} SELECT run_id, seed, split, decoding_id, slot, draw_kind, draw, count(*) AS n_items, bool_or(physical) AS physical, round(avg(truncated), 9) AS truncated, round(avg(v1), 9) AS acc FROM cu GROUP BY ALL")
def cube_vectors(spark, d):
    """Each measured cell group: items, physical flag, share at the token limit, strict accuracy."""
    return cube(spark, d).groupBy(*CELL_KEY[:-1]).agg(F.count(F.lit(1)).alias("n_items"), F.bool_or("physical").alias("physical"), F.round(F.avg("truncated"), 9).alias("truncated"), F.round(F.avg("v1"), 9).alias("acc"))


def stored_drift(outcomes: DataFrame, extractor: str, decoding: str) -> DataFrame:
    """(age, n, stored_right, rerun_right, gained, lost, same_gen_frac, inflation): outputs stored under the storage environment against later rounds of the same prompt and item.

    Storage keeps its decoding and extractor; the rerun has the given ones.
    """
    kept_decoding, kept = next((dec, x) for e, dec, x in ENVS if e == STORAGE_ENV)
    on = ["run_id", "seed", "split", "slot", "item_idx"]
    rounds = outcomes.where("draw_kind = 'round'")
    old = rounds.where(F.col("decoding_id") == kept_decoding).select(*on, F.col("draw").alias("i"), F.col(kept).alias("s"), F.col("gen_key").alias("g1"))
    new = rounds.where(F.col("decoding_id") == decoding).select(*on, F.col("draw").alias("j"), F.col(extractor).alias("r"), F.col("gen_key").alias("g2"))
    met = old.join(new, on).where("i <= j")
    s, r, n = F.col("s"), F.col("r"), F.count(F.lit(1))
    got = met.groupBy((F.col("j") - F.col("i")).alias("age")).agg(
        n.alias("n"), F.sum("s").alias("stored_right"), F.sum("r").alias("rerun_right"), F.sum((1 - s) * r).alias("gained"), F.sum(s * (1 - r)).alias("lost"), F.avg((F.col("g1") == F.col("g2")).cast("int")).alias("same_gen_frac")
    )
    return got.withColumn("inflation", rate(F.col("stored_right") - F.col("rerun_right"), F.col("n")))


def _drift_sql(env: str, decoding: str) -> str:
    return f"""SELECT '{env}' AS env, b.draw - a.draw AS age, count(*) AS n, CAST(sum(a.v1) AS BIGINT) AS stored_right, CAST(sum(b.v1) AS BIGINT) AS rerun_right, count(*) FILTER (b.v1 > a.v1) AS gained, count(*) FILTER (a.v1 > b.v1) AS lost,
    round(count(*) FILTER (a.gen_key = b.gen_key) / count(*), 9) AS same_gen_frac, round(avg(a.v1 - b.v1), 9) AS inflation
    FROM cu a JOIN cu b USING (run_id, seed, split, slot, item_idx) WHERE a.draw_kind = 'round' AND b.draw_kind = 'round' AND a.decoding_id = 'greedy' AND b.decoding_id = '{decoding}' AND a.draw <= b.draw GROUP BY 2"""


@query(f"WITH {_CUBE} {_drift_sql('E1', 'greedy')} UNION ALL {_drift_sql('E2', 't02')}")
def stored_drift_by_age(spark, d):
    """Measured drift of stored scores by age, without and with a change of decoding."""
    outcomes = cube(spark, d)
    parts = [stored_drift(outcomes, "v1", dec).withColumn("env", F.lit(env)) for env, dec in (("E1", "greedy"), ("E2", "t02"))]
    rows = parts[0].unionByName(parts[1]).select("env", "age", "n", "stored_right", "rerun_right", "gained", "lost", "same_gen_frac", "inflation")
    return rows.select(*[F.round(c, 9).alias(c) if c in ("same_gen_frac", "inflation") else F.col(c) for c in rows.columns])


@query()
def stored_drift_by_extraction(spark, d):
    """The same with the lenient extractor in the rerun."""
    outcomes = cube(spark, d)
    parts = [stored_drift(outcomes, "v2", dec).withColumn("env", F.lit(env)) for env, dec in (("E3", "greedy"), ("E4", "t02"))]
    return parts[0].unionByName(parts[1])


@query(
    f"""WITH {_CUBE}, a AS (SELECT * FROM cu WHERE draw_kind = 'audit'), r AS (SELECT DISTINCT run_id, seed, split, decoding_id, slot, item_idx, gen_key, v1 FROM cu WHERE draw_kind = 'round')
    SELECT a.run_id, a.decoding_id, a.slot, a.draw AS repeat, count(*) AS n, round(avg(CASE WHEN a.v1 <> r.v1 THEN 100.0 ELSE 0 END), 9) AS pct_correct_flip
    FROM a JOIN r USING (run_id, seed, split, decoding_id, slot, item_idx) GROUP BY ALL"""
)
def audit_flips(spark, d):
    """How often an audited rerun is graded otherwise than its round cell, by run, decoding, slot and repeat."""
    outcomes = cube(spark, d)
    on = ["run_id", "seed", "split", "decoding_id", "slot", "item_idx"]
    audit = outcomes.where("draw_kind = 'audit'").select(*on, F.col("draw").alias("repeat"), F.col("v1").alias("a"))
    rounds = outcomes.where("draw_kind = 'round'").select(*on, "gen_key", F.col("v1").alias("r")).distinct()
    flipped = F.when(F.col("a") != F.col("r"), 100.0).otherwise(0.0)
    return audit.join(rounds, on).groupBy("run_id", "decoding_id", "slot", "repeat").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(flipped), 9).alias("pct_correct_flip"))
