"""What a run will take: planned cells, physical reruns, request counts by stage and purpose, hours."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.matrix import PHYSICAL, SEEDS, R
from ledgerloom.registry import query
from ledgerloom.sources.tables import table

# Tokens per second, low and high, by serving stack and card; planning figures.
THROUGHPUT = (("vllm", "T4", 1000, 2000), ("vllm", "L4", 2000, 4000), ("vllm", "A100", 6000, 12000), ("vllm", "CPU", 5, 30), ("hf", "T4", 250, 450), ("hf", "L4", 500, 900), ("hf", "A100", 1500, 2500), ("hf", "CPU", 5, 15))
# Defaults of the estimate, the band around a measured throughput, the longest session in hours.
COMPLETION_TOKENS, ATTEMPTS, BAND, SESSION_HOURS = 300, 1.3, (0.8, 1.25), 12.0
# The registered configurations, full, lean and smoke.
FULL = {
    "run": {"name": "full", "seeds": [0, 1, 2], "rounds": 11},
    "data": {"dev": {"n": 200}, "eval": {"n": 200}},
    "decodings": {"greedy": {"temperature": 0.0}, "t02": {"temperature": 0.2}},
    "environments": {"E1": {"decoding": "greedy", "extractor": "v1"}, "E2": {"decoding": "t02", "extractor": "v1"}, "E3": {"decoding": "greedy", "extractor": "v2"}, "E4": {"decoding": "t02", "extractor": "v2"}},
    "trajectory": {"env": "E1", "proposer": {"max_attempts": 3}},
    "matrix": {"mode": "full", "physical_greedy_reruns": "ages", "physical_ages": [0, 1, 3, 5, 10], "gt_draws": 1},
    "audit": {"enabled": True, "seed": 0, "slots": [0, 11], "repeats": 2, "decodings": ["greedy", "t02"], "n_items": 200},
}


def with_parts(config: dict, **parts: dict) -> dict:
    """``config`` with the given parts merged in, key by key."""
    from ledgerloom.sources.configs import merge

    return merge(config, parts)


SMOKE = with_parts(FULL, run={"name": "smoke", "seeds": [0, 1], "rounds": 4}, data={"dev": {"n": 24}, "eval": {"n": 24}}, audit={"repeats": 1, "n_items": 24, "slots": [0, 4]})
LEAN = with_parts(FULL, run={"name": "lean"}, matrix={"mode": "lean", "physical_greedy_reruns": "none"}, audit={"repeats": 1, "n_items": 100})


def used_decodings(config: dict) -> tuple[list[str], list[str]]:
    """The greedy and the sampling decodings that the environments use, in their order."""
    used = {e["decoding"] for e in config["environments"].values()}
    known = [(name, spec["temperature"] == 0.0) for name, spec in config["decodings"].items() if name in used]
    return [n for n, greedy in known if greedy], [n for n, greedy in known if not greedy]


def rerun_pairs(rounds: int, ages: Sequence[int]) -> int:
    """Physical greedy reruns per seed, in cells: one for each pair of rounds that far apart."""
    return sum(rounds + 1 - age for age in set(ages) if 0 < age <= rounds)


def request_rows(config: dict, attempts: float = ATTEMPTS) -> list[tuple[str, str, str, float, float]]:
    """(stage, purpose, component, logical, executed) of everything a run asks for.

    Greedy requests of slot 0 are the same for every seed and executed once; greedy
    reruns are executed only where the matrix wants them physical; a lean matrix
    draws once for each slot.
    """
    rounds, seeds = config["run"]["rounds"], len(config["run"]["seeds"])
    n_eval, n_dev = config["data"]["eval"]["n"], config["data"]["dev"]["n"]
    slots, matrix, audit = rounds + 1, config["matrix"], config["audit"]
    triangle = slots * (slots + 1) // 2
    tries = min(max(attempts, 1.0), config["trajectory"]["proposer"]["max_attempts"])
    greedy, sampled = used_decodings(config)
    once = config["environments"][config["trajectory"]["env"]]["decoding"] in greedy
    out = [
        ("trajectory", "trajectory_dev", "first prompt", seeds * n_dev, n_dev if once else seeds * n_dev),
        ("trajectory", "candidate_dev", "candidates", seeds * rounds * n_dev, seeds * rounds * n_dev),
        ("trajectory", "proposer", "attempts", seeds * rounds * tries, seeds * rounds * tries),
    ]
    physical = {"all": triangle - slots, "none": 0}.get(matrix["physical_greedy_reruns"], rerun_pairs(rounds, matrix["physical_ages"]))
    for name in greedy:
        out.append(("matrix", "eval_matrix", f"{name} creation", seeds * slots * n_eval, (1 + seeds * rounds) * n_eval))
        out.append(("matrix", "eval_matrix", f"{name} reruns", seeds * (triangle - slots) * n_eval, seeds * physical * n_eval))
    for name in sampled:
        out.append(("matrix", "eval_matrix", f"{name} triangle", seeds * triangle * n_eval, seeds * (triangle if matrix["mode"] == "full" else slots) * n_eval))
        if matrix["gt_draws"]:
            out.append(("matrix", "gt_draw", f"{name} ground truth", *[seeds * slots * n_eval * matrix["gt_draws"]] * 2))
    if audit["enabled"]:
        out.append(("audit", "audit", "determinism", *[len(set(audit["slots"])) * audit["repeats"] * min(audit["n_items"], n_eval) * len(audit["decodings"])] * 2))
    return out


def counted(spark: SparkSession, configs: dict[str, dict], attempts: float = ATTEMPTS) -> DataFrame:
    """(config, stage, purpose, component, logical, executed) with counts rounded up."""
    rows = [(name, *row[:3], float(row[3]), float(row[4])) for name, config in configs.items() for row in request_rows(config, attempts)]
    df = spark.createDataFrame(rows, "config string, stage string, purpose string, component string, logical double, executed double")
    up = lambda c: F.ceil(F.round(c, 6)).cast("bigint").alias(c)
    return df.select("config", "stage", "purpose", "component", up("logical"), up("executed"))


def planned(spark: SparkSession, seeds: int = SEEDS, rounds: int = R, reruns: str = "ages", ages: Sequence[int] = PHYSICAL, mode: str = "full") -> DataFrame:
    """(seed, decoding, draw_kind, slot, draw, physical): the cell groups of the matrix.

    A greedy output of an older prompt is generated again never (``none``), always
    (``all``) or at the physical ages; a sampled one always, or once for each slot in
    a lean matrix.
    """
    triangle = spark.range(seeds).select(F.col("id").cast("int").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("draw")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("draw"))))
    age = F.col("draw") - F.col("slot")
    both = triangle.withColumn("decoding", F.explode(F.array(F.lit("greedy"), F.lit("t02"))))
    again = {"none": F.lit(False), "all": F.lit(True)}.get(reruns, age.isin(*ages))
    sampled = (F.col("decoding") == "t02") & (F.lit(mode == "full") | (age == 0))
    cells = both.select("seed", "decoding", F.lit("round").alias("draw_kind"), "slot", "draw", (sampled | (F.col("decoding") == "greedy") & ((age == 0) | again)).alias("physical"))
    truth = triangle.where("slot = draw").select("seed", F.lit("t02").alias("decoding"), F.lit("gt").alias("draw_kind"), "slot", F.lit(0).alias("draw"), F.lit(True).alias("physical"))
    return cells.unionByName(truth)


def hours(executed: float, speed: tuple[float, float], tokens: float = COMPLETION_TOKENS, measured: tuple[float, float | None] | None = None) -> tuple[float, float]:
    """(low, high) hours; ``measured`` (tokens a second, tokens a completion) replaces the planning figures by a band around it."""
    if measured is not None:
        if measured[0] <= 0:
            raise ValueError("a measured throughput must be positive")
        speed, tokens = (measured[0] * BAND[0], measured[0] * BAND[1]), measured[1] or tokens
    return executed * tokens / speed[1] / 3600.0, executed * tokens / speed[0] / 3600.0


def card(name: str) -> str:
    """The card of a name like "NVIDIA A100-80GB"."""
    m = re.fullmatch(r"(?:nvidia)?[-_]*(?:tesla[-_]?)?(t4|l4|a100|cpu)(?:[-_].*)?", name.strip().lower().replace(" ", ""))
    if m is None:
        raise ValueError(f"unknown card {name!r}")
    return m[1].upper()


def stack(name: str) -> str:
    """The serving stack of a name; "auto" is vllm."""
    plain = name.strip().lower().replace("-", "_")
    plain = "vllm" if plain == "auto" else plain
    if plain not in ("vllm", "hf", "mock", "openai_compat"):
        raise ValueError(f"unknown stack {name!r}")
    return plain


def warnings(stack_: str, card_: str, low: float, high: float, config: dict) -> list[str]:
    """What speaks against a run as planned."""
    out = []
    if high > SESSION_HOURS:
        out.append(f"{'even the low' if low > SESSION_HOURS else 'the high'} estimate exceeds a session of {SESSION_HOURS:g} h")
    if stack_ == "hf" and card_ == "T4" and config["matrix"]["mode"] == "full":
        out.append("a full matrix is very slow on this stack and card")
    if card_ == "CPU" and stack_ != "mock":
        out.append("a CPU serves only for smoke tests")
    if stack_ == "mock":
        out.append("synthetic data: the hours mean nothing")
    return out


def format_hours(low: float, high: float) -> str:
    written = lambda h: f"{h * 60:.0f} min" if h < 1 else f"{h:.1f} h"
    return f"{written(low)} – {written(high)}"


_PLAN = f"""WITH t AS (SELECT s.seed, r.draw, k.slot FROM range(0, {SEEDS}) s(seed) CROSS JOIN range(0, {R + 1}) r(draw) JOIN range(0, {R + 1}) k(slot) ON k.slot <= r.draw),
    p AS (SELECT CAST(seed AS INT) AS seed, decoding, 'round' AS draw_kind, CAST(slot AS INT) AS slot, CAST(draw AS INT) AS draw, decoding = 't02' OR draw = slot OR draw - slot IN {PHYSICAL} AS physical FROM t CROSS JOIN (VALUES ('greedy'), ('t02')) d(decoding)
      UNION ALL SELECT seed, 't02', 'gt', slot, 0, true FROM t WHERE slot = draw)"""


@query(_PLAN + " SELECT * FROM p")
def plan_cells(spark, d):
    return planned(spark)


@query(_PLAN + ", n AS (SELECT count(DISTINCT idx) AS n FROM items WHERE split = 'test') SELECT decoding, draw_kind, CAST(count(*) * max(n) AS BIGINT) AS logical, CAST(count(*) FILTER (physical) * max(n) AS BIGINT) AS executed FROM p CROSS JOIN n GROUP BY GROUPING SETS ((decoding, draw_kind), ())")
def request_counts(spark, d):
    """Logical and executed requests of the matrix over the test items."""
    n = table(spark, d, "items", "split", "idx").where("split = 'test'").agg(F.count_distinct("idx").alias("n"))
    rows = planned(spark).crossJoin(F.broadcast(n))  # one row
    return rows.groupingSets([["decoding", "draw_kind"], []], "decoding", "draw_kind").agg(F.sum("n").alias("logical"), F.sum(F.when(F.col("physical"), F.col("n")).otherwise(0)).alias("executed"))


# the same by counting: every cell of the planned matrix, times its items
def _stage_sql(name: str, config: dict) -> str:
    s, r, n, dev = len(config["run"]["seeds"]), config["run"]["rounds"], config["data"]["eval"]["n"], config["data"]["dev"]["n"]
    m, a = config["matrix"], config["audit"]
    again = {"none": "false", "all": "true"}.get(m["physical_greedy_reruns"], f"r.x - k.x IN ({', '.join(map(str, m['physical_ages']))})")
    lean = "true" if m["mode"] == "full" else "r.x = k.x"
    parts = [
        f"SELECT 'trajectory' AS stage, 'trajectory_dev' AS purpose, {s * dev} AS logical, {dev} AS executed",
        f"SELECT 'trajectory', 'candidate_dev', count(*) * {dev}, count(*) * {dev} FROM range({s}) s CROSS JOIN range({r}) r",
        f"SELECT 'trajectory', 'proposer', ceil(round(count(*) * {ATTEMPTS}, 6)), ceil(round(count(*) * {ATTEMPTS}, 6)) FROM range({s}) s CROSS JOIN range({r}) r",
        f"SELECT 'matrix', 'eval_matrix', count(*) * {n}, count(*) FILTER (CASE WHEN r.x = k.x THEN k.x > 0 OR s.x = 0 ELSE {again} END) * {n} FROM range({s}) s(x) CROSS JOIN range({r + 1}) r(x) JOIN range({r + 1}) k(x) ON k.x <= r.x",
        f"SELECT 'matrix', 'eval_matrix', count(*) * {n}, count(*) FILTER ({lean}) * {n} FROM range({s}) s(x) CROSS JOIN range({r + 1}) r(x) JOIN range({r + 1}) k(x) ON k.x <= r.x",
        f"SELECT 'matrix', 'gt_draw', count(*) * {n * m['gt_draws']}, count(*) * {n * m['gt_draws']} FROM range({s}) s CROSS JOIN range({r + 1}) k",
    ]
    if a["enabled"]:
        parts.append(f"SELECT 'audit', 'audit', count(*) * {min(a['n_items'], n)}, count(*) * {min(a['n_items'], n)} FROM range({len(set(a['slots']))}) x CROSS JOIN range({a['repeats']}) y CROSS JOIN range({len(a['decodings'])}) z")
    return f"SELECT '{name}' AS config, * FROM ({' UNION ALL '.join(parts)})"


_CONFIGS = {"full": FULL, "lean": LEAN, "smoke": SMOKE}
_STAGES = " UNION ALL ".join(_stage_sql(name, c) for name, c in _CONFIGS.items())


@query(f"SELECT config, stage, purpose, CAST(sum(logical) AS BIGINT) AS logical, CAST(sum(executed) AS BIGINT) AS executed FROM ({_STAGES}) GROUP BY GROUPING SETS ((config, stage), (config, purpose), (config))")
def requests_by_stage(spark, d):
    """Requests of the registered configurations by stage, by purpose and in total."""
    rows = counted(spark, _CONFIGS).groupingSets([["config", "stage"], ["config", "purpose"], ["config"]], "config", "stage", "purpose")
    return rows.agg(F.sum("logical").alias("logical"), F.sum("executed").alias("executed"))


@query(
    f"WITH e AS (SELECT config, sum(executed) AS executed FROM ({_STAGES}) GROUP BY 1) SELECT config, stack, card, round(executed * {COMPLETION_TOKENS} / CAST(hi AS DOUBLE) / 3600, 9) AS hours_lo, round(executed * {COMPLETION_TOKENS} / CAST(lo AS DOUBLE) / 3600, 9) AS hours_hi, executed * {COMPLETION_TOKENS} / CAST(lo AS DOUBLE) / 3600 > {SESSION_HOURS} AS too_long FROM e CROSS JOIN (VALUES "
    + ", ".join(str(t) for t in THROUGHPUT)
    + ") AS v(stack, card, lo, hi)"
)
def estimate_hours(spark, d):
    """Hours of generation, low and high, of each configuration on each stack and card."""
    total = counted(spark, _CONFIGS).groupBy("config").agg(F.sum("executed").alias("executed"))
    speeds = spark.createDataFrame(list(THROUGHPUT), "stack string, card string, lo int, hi int")
    tokens = F.col("executed") * F.lit(COMPLETION_TOKENS)
    high = tokens / F.col("lo") / 3600
    return speeds.crossJoin(F.broadcast(total)).select("config", "stack", "card", F.round(tokens / F.col("hi") / 3600, 9).alias("hours_lo"), F.round(high, 9).alias("hours_hi"), (high > SESSION_HOURS).alias("too_long"))
