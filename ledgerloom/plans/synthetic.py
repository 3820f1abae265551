"""Synthetic answers: what a model might have said to each item, from hashes alone.

An item gets a value (right for seven in ten), one of eight layouts and a text that
states the value in that layout.  Extraction over the texts must give back what was
put in: the strict extractor reads boxes and hash lines, the lenient one everything
but texts that break off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.answers import canonical_gold, extract_strict
from ledgerloom.functions.environments import Environment
from ledgerloom.functions.hashing import hash32, joined
from ledgerloom.functions.lenient import extract_lenient
from ledgerloom.functions.prompting import numbered_blocks, sampled
from ledgerloom.plans.cube import _CUBE, cube
from ledgerloom.plans.matrix import ENVS, duck
from ledgerloom.plans.store import I, generations, items
from ledgerloom.registry import query

# The layouts with the text around a value.
LAYOUTS = (
    ("box", "The final answer is \\boxed{", "}."), ("hash", "#### ", ""), ("answer_is", "So the answer is ", "."), ("bold", "That makes **", "** in all."),
    ("currency", "The answer is $", "."), ("units", "The total is ", " units altogether."), ("comma", "Answer: ", ""), ("truncated", "So the answ", ""),
)
STRICT_LAYOUTS = ("box", "hash")


def _drawn(name: str, modulus: int) -> Column:
    return F.pmod(hash32(joined(F.lit(name), F.col("split"), F.col("idx"))), F.lit(modulus))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(split, idx, layout, is_right, value, response, n_tokens) for every item with a whole number as its gold."""
    rows = items(spark, d, "gold").withColumn("g", canonical_gold(F.col("gold"))).where(F.col("g").rlike(r"^\d{1,15}$")).withColumn("g", F.col("g").cast("bigint"))
    rows = rows.withColumn("is_right", _drawn("ok", 10) < 7).withColumn("n", _drawn("layout", len(LAYOUTS)))
    rows = rows.withColumn("value", F.when(F.col("is_right"), F.col("g")).otherwise(F.col("g") + 1 + _drawn("off", 9)))
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in LAYOUTS]), F.col("n").cast("int") + 1)
    layout = pick(0)
    written = F.when(layout == "comma", F.format_number("value", 0)).when(layout == "truncated", F.lit("")).otherwise(F.col("value").cast("string"))
    text = F.concat(F.lit("Let us add up what is given, one by one.\n"), pick(1), written, pick(2))
    rows = rows.select("split", "idx", layout.alias("layout"), "is_right", "value", text.alias("response"))
    return rows.withColumn("n_tokens", F.ceil(F.size(F.split("response", r"\s+")) * 1.3).cast("int"))


_H = "H('{0}|' || split || '|' || idx)"
_PICK = lambda i: "CASE n " + " ".join(f"WHEN {k} THEN '{x[i]}'" for k, x in enumerate(LAYOUTS)) + " END"
_ANSWERS = duck(f"""s0 AS (SELECT split, idx, CAST(replace(gold, ',', '') AS DOUBLE) AS gd FROM {I}), s1 AS (SELECT split, idx, CAST(gd AS BIGINT) AS g, {_H.format("ok")} % 10 < 7 AS is_right, {_H.format("layout")} % {len(LAYOUTS)} AS n, {_H.format("off")} % 9 AS off FROM s0 WHERE gd = floor(gd) AND gd >= 0),
    s2 AS (SELECT *, CASE WHEN is_right THEN g ELSE g + 1 + off END AS value, {_PICK(0)} AS layout FROM s1),
    sy AS (SELECT split, idx, layout, is_right, value, 'Let us add up what is given, one by one.' || chr(10) || {_PICK(1)} || CASE layout WHEN 'comma' THEN format('{{:,}}', value) WHEN 'truncated' THEN '' ELSE CAST(value AS VARCHAR) END || {_PICK(2)} AS response FROM s2)""")


@query(f"WITH {_ANSWERS} SELECT *, CAST(ceil(len(regexp_split_to_array(response, '\\s+')) * 1.3) AS INT) AS n_tokens FROM sy")
def synthetic_answers(spark, d):
    return answers(spark, d)


@query(f"WITH {_ANSWERS} SELECT layout, count(*) AS n, count(*) FILTER (is_right AND layout IN {STRICT_LAYOUTS}) AS n_strict, count(*) FILTER (is_right AND layout <> 'truncated') AS n_lenient FROM sy GROUP BY 1")
def synthetic_round_trip(spark, d):
    """What both extractors read back from the synthetic answers, by layout; the SQL counts what was put in."""
    rows = answers(spark, d).join(items(spark, d, "gold").withColumn("gold", canonical_gold(F.col("gold"))), ["split", "idx"])
    right = lambda value: F.count_if(value == F.col("gold"))
    return rows.groupBy("layout").agg(F.count(F.lit(1)).alias("n"), right(extract_strict(F.col("response"))).alias("n_strict"), right(extract_lenient(F.col("response"))["value"]).alias("n_lenient"))


@query(
    rf"""SELECT split, idx, len(list_distinct(regexp_extract_all(question, '\d+'))) AS n_numbers, contains(question, '$') AS has_dollar, nullif(regexp_extract(lower(question), 'how many (\w+)', 1), '') AS unit,
    ({duck("H('difficulty|' || question)")}) % 1000 AS difficulty FROM {I}"""
)
def synthetic_items(spark, d):
    """What the generator knows of an item: its numbers, whether money is meant, the unit asked for, a hashed difficulty."""
    q = F.col("question")
    unit = F.nullif(F.regexp_extract(F.lower(q), r"how many (\w+)", 1), F.lit(""))
    numbers = F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(r"(\d+)"), F.lit(1))))
    return items(spark, d, "question").select("split", "idx", numbers.alias("n_numbers"), q.contains("$").alias("has_dollar"), unit.alias("unit"), F.pmod(hash32(joined(F.lit("difficulty"), q)), F.lit(1000)).alias("difficulty"))


def _environments() -> list[Environment]:
    from ledgerloom.functions.environments import from_config
    from ledgerloom.plans.planner import FULL

    return list(from_config(FULL, model="m@1", engine="e").values())


_JSON = """'{"decoding":{"repetition_penalty":1.0,"temperature":' || t || ',"top_k":0,"top_p":1.0},"engine":"e","extractor":"' || x || '","max_new_tokens":640,"model":"m@1"}'"""


@query("SELECT env, substr(sha256(" + _JSON + "), 1, 16) AS fingerprint FROM (VALUES " + ", ".join(f"('{e}', '{'0.0' if dec == 'greedy' else '0.2'}', '{x}')" for e, dec, x in ENVS) + ") AS v(env, t, x)")
def env_fingerprints(spark, d):
    """Fingerprints of the environments' tracked components."""
    return spark.createDataFrame([(e.name, e.fingerprint()) for e in _environments()], "env string, fingerprint string")


SAMPLE = 5
_ERRORS = (
    "WITH "
    + _CUBE
    + duck(
        f""", er AS (SELECT DISTINCT cu.run_id, cu.seed, cu.slot, cu.item_idx, cu.gen_key FROM cu WHERE split = 'train' AND v1 = 0),
    rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, seed, slot ORDER BY H('errors|' || run_id || '|' || seed || '|' || slot || '|' || gen_key), gen_key) AS r FROM er), sa AS (SELECT * FROM rk WHERE r <= {SAMPLE})"""
    )
)


def error_sample(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, seed, slot, item_idx, gen_key): up to five wrong training answers of each slot, by hash."""
    wrong = cube(spark, d).where("split = 'train' AND v1 = 0").select("run_id", "seed", "slot", "item_idx", "gen_key").distinct()
    return sampled(wrong, ["run_id", "seed", "slot"], F.col("gen_key"), SAMPLE)


@query(_ERRORS + " SELECT run_id, seed, slot, item_idx, gen_key FROM sa")
def error_samples(spark, d):
    return error_sample(spark, d)


@query(
    _ERRORS
    + f""", b AS (SELECT sa.*, row_number() OVER (PARTITION BY run_id, seed, slot ORDER BY item_idx, gen_key) AS i, it.question, it.gold, CASE WHEN length(g.response) > 163 THEN substr(g.response, 1, 120) || '...' || right(g.response, 40) ELSE g.response END AS said
      FROM sa JOIN {I} it ON it.split = 'train' AND it.idx = sa.item_idx JOIN g USING (gen_key))
    SELECT run_id, seed, slot, count(*) AS n_errors, string_agg(gold, ',' ORDER BY i) AS golds, string_agg('### ' || i || chr(10) || question || chr(10) || said || chr(10) || 'Correct: ' || gold, chr(10) || chr(10) ORDER BY i) AS blocks FROM b GROUP BY 1, 2, 3"""
)
def meta_prompt_blocks(spark, d):
    """The numbered error blocks that a proposer is shown for each slot, and the golds it sees."""
    from ledgerloom.functions.prompting import shorten

    chosen = error_sample(spark, d)
    texts = generations(spark, d, "response").join(chosen.select("gen_key").distinct(), "gen_key", "left_semi").select("gen_key", shorten(F.coalesce("response", F.lit("")), 120, 40).alias("said"))
    known = items(spark, d, "question", "gold").where("split = 'train'").select(F.col("idx").alias("item_idx"), "question", "gold")
    rows = chosen.join(texts, "gen_key").join(known, "item_idx").select("run_id", "seed", "slot", "item_idx", "gen_key", "question", "said", "gold")
    blocks = numbered_blocks(rows, ["run_id", "seed", "slot"], [F.col("item_idx"), F.col("gen_key")], "### {i}\n{question}\n{said}\nCorrect: {gold}")
    return blocks.select("run_id", "seed", "slot", F.col("n_errors").cast("bigint").alias("n_errors"), F.array_join("golds", ",").alias("golds"), "blocks")
