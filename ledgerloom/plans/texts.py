"""Queries over prompt and response texts of the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.answers import canonical_decimal, canonical_gold
from ledgerloom.functions.prompting import fill, normal_form, numbers_in, shorten, tagged, violations
from ledgerloom.operators.skew import join_small
from ledgerloom.plans.store import generations, items
from ledgerloom.registry import query
from ledgerloom.sources.tables import table

_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^[\s!-/:-@\[-`{-~]+', ''), '[\s!-/:-@\[-`{-~]+$', '')"""
LEAST, MOST = 150, 700


def _prompts(spark, d):
    return table(spark, d, "prompts").groupBy("prompt_hash").agg(F.min("text").alias("text"))


@query(f"SELECT prompt_hash, {_NORMAL} AS normal FROM (SELECT DISTINCT prompt_hash, text FROM prompts)")
def prompt_normal_forms(spark, d):
    return _prompts(spark, d).select("prompt_hash", normal_form(F.col("text")).alias("normal"))


_SHOUTED = "substr(prompt_hash, 1, 1) = '0'"
_COPIED = f"(SELECT DISTINCT prompt_hash, text FROM prompts UNION SELECT reverse(prompt_hash), upper(text) || '!' FROM prompts WHERE {_SHOUTED})"


@query(f"SELECT sha256({_NORMAL}) AS normal_hash, count(*) AS n, min(prompt_hash) AS first FROM {_COPIED} GROUP BY 1 HAVING count(*) > 1")
def prompt_duplicates(spark, d):
    """Prompts that are equal in normal form, by its hash; copies in capitals are planted."""
    p = _prompts(spark, d)
    copies = p.where(_SHOUTED).select(F.reverse("prompt_hash").alias("prompt_hash"), F.concat(F.upper("text"), F.lit("!")).alias("text"))
    rows = p.unionByName(copies).select("prompt_hash", F.sha2(normal_form(F.col("text")), 256).alias("normal_hash"))
    return rows.groupBy("normal_hash").agg(F.count(F.lit(1)).alias("n"), F.min("prompt_hash").alias("first")).where("n > 1")


# numbers that stand alone: whole runs of word characters, points and commas, without points and commas at their end
_ALONE = r"""SELECT DISTINCT prompt_hash, TRY_CAST(replace(w, ',', '') AS DECIMAL(38, 9)) AS v FROM (SELECT prompt_hash, rtrim(unnest(regexp_extract_all(text, '[\p{L}\p{N}_.,]+')), '.,') AS w FROM (SELECT prompt_hash, text FROM prompts UNION ALL SELECT prompt_hash, text || ' ' || (SELECT max(gold) FROM items WHERE length(gold) >= 3) FROM prompts WHERE substr(prompt_hash, 1, 1) = '1'))
    WHERE regexp_full_match(w, '\d{1,3}(,\d{3})+(\.\d+)?|\d+(\.\d+)?')"""
_GOLDS = r"""SELECT DISTINCT regexp_replace(CAST(v AS VARCHAR), '\.?0+$', '') AS gold, v FROM (SELECT TRY_CAST(replace(replace(gold, ',', ''), ' ', '') AS DECIMAL(38, 9)) AS v FROM items)
    WHERE length(regexp_replace(regexp_replace(CAST(v AS VARCHAR), '\.?0+$', ''), '\D', '', 'g')) >= 3"""
_LEAKS = f"SELECT DISTINCT prompt_hash, gold FROM ({_ALONE}) JOIN ({_GOLDS}) USING (v)"


@query(
    f"""WITH k AS ({_LEAKS}), p AS (SELECT DISTINCT prompt_hash, text, {_NORMAL} AS normal FROM prompts), e AS (SELECT normal, min(prompt_hash) AS first FROM p GROUP BY 1)
    SELECT prompt_hash, concat_ws(',', CASE WHEN length(text) < {LEAST} THEN 'too_short' END, CASE WHEN length(text) > {MOST} THEN 'too_long' END, CASE WHEN NOT contains(text, '\\boxed') THEN 'no_format_instruction' END,
    CASE WHEN prompt_hash > first THEN 'duplicate' END, CASE WHEN prompt_hash IN (SELECT prompt_hash FROM k) THEN 'leaks_gold' END,
    CASE WHEN regexp_matches(text, '(?i)</?(prompt|current_prompt|example|response|question)\\b[^>]*>') THEN 'contains_tags' END) AS violations FROM p JOIN e USING (normal)"""
)
def prompt_violations(spark, d):
    """What is wrong with each prompt as a candidate; a duplicate has the normal form of one with a lower hash."""
    p = _prompts(spark, d).withColumn("h", F.sha2(normal_form(F.col("text")), 256))
    first = p.groupBy("h").agg(F.min("prompt_hash").alias("first"))
    leaking = prompt_gold_leaks(spark, d).select("prompt_hash").distinct().withColumn("leaks", F.lit(True))
    rows = p.join(first, "h").join(leaking, "prompt_hash", "left")
    found = violations(F.col("text"), F.col("prompt_hash") > F.col("first"), F.col("leaks"), LEAST, MOST)
    return rows.select("prompt_hash", F.array_join(found, ",").alias("violations"))


@query(_LEAKS)
def prompt_gold_leaks(spark, d):
    """Prompts that hold a gold answer of three digits or more as a number of its own; one is planted into those whose hash begins with 1."""
    most = table(spark, d, "items", "gold").where("length(gold) >= 3").agg(F.max("gold").alias("planted"))  # one row
    texts = _prompts(spark, d).crossJoin(F.broadcast(most)).withColumn("text", F.when(F.col("prompt_hash").startswith("1") & F.col("planted").isNotNull(), F.concat_ws(" ", "text", "planted")).otherwise(F.col("text")))
    p = texts.select("prompt_hash", F.explode(numbers_in(F.col("text"))).alias("number"))
    gold = table(spark, d, "items", "gold").select(canonical_gold(F.col("gold")).alias("number")).where(F.length(F.regexp_replace("number", r"\D", "")) >= 3).distinct()
    return p.withColumn("number", canonical_decimal(F.col("number"))).join(gold, "number", "left_semi").select("prompt_hash", F.col("number").alias("gold")).distinct()


@query("SELECT gen_key, CASE WHEN length(response) > 163 THEN substr(response, 1, 120) || '...' || right(response, 40) ELSE response END AS short FROM (SELECT DISTINCT gen_key, response FROM generations)")
def responses_shortened(spark, d):
    return generations(spark, d, "response").select("gen_key", shorten(F.col("response"), 120, 40).alias("short"))


_TEMPLATE = "Problem {split}/{idx}\nQuestion: {question}\nCorrect answer: {gold}"


@query("SELECT split, idx, 'Problem ' || split || '/' || idx || chr(10) || 'Question: ' || question || chr(10) || 'Correct answer: ' || gold AS block FROM (SELECT DISTINCT split, idx, question, gold FROM items)")
def error_blocks(spark, d):
    """The template of an error block filled for each item."""
    rows = items(spark, d, "question", "gold")
    return rows.select("split", "idx", fill(_TEMPLATE, {c: F.col(c) for c in ("split", "idx", "question", "gold")}).alias("block"))


@query(r"SELECT prompt_hash, NULLIF(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS body FROM (SELECT DISTINCT prompt_hash, text FROM prompts)")
def tagged_prompts(spark, d):
    """The last tagged part of a wrapped prompt is the prompt itself."""
    p = _prompts(spark, d)
    return p.select("prompt_hash", tagged(F.concat(F.lit("Old: <prompt>x</prompt>\n<PROMPT>\n"), F.col("text"), F.lit("\n</Prompt>")), "prompt").alias("body"))


@query(
    r"""SELECT prompt_hash, regexp_matches(text, '(?i)step') AS steps, regexp_matches(text, '(?i)check|verify|double') AS checks, contains(text, '\boxed') AS boxed,
    regexp_matches(text, '(?i)\b(never|not|don.t|without)\b') AS negated FROM (SELECT DISTINCT prompt_hash, text FROM prompts)"""
)
def prompt_features(spark, d):
    text = F.col("text")
    return _prompts(spark, d).select("prompt_hash", text.rlike("(?i)step").alias("steps"), text.rlike("(?i)check|verify|double").alias("checks"), text.contains("\\boxed").alias("boxed"), text.rlike(r"(?i)\b(never|not|don.t|without)\b").alias("negated"))


@query("SELECT s.origin, count(*) AS n_slots, count(DISTINCT prompt_hash) AS n_prompts, round(avg(length(p.text)), 6) AS mean_chars FROM (SELECT DISTINCT * FROM slots) s JOIN (SELECT DISTINCT * FROM prompts) p USING (prompt_hash) GROUP BY 1")
def prompts_by_origin(spark, d):
    p = _prompts(spark, d).select("prompt_hash", F.length("text").alias("n"))
    rows = join_small(table(spark, d, "slots").distinct(), p, "prompt_hash", F.xxhash64("run_id", "seed", "slot"), "inner")
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n_slots"), F.count_distinct("prompt_hash").alias("n_prompts"), F.round(F.avg("n"), 6).alias("mean_chars"))
