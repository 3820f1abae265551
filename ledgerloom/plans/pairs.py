"""All-pairs drift: a candidate of round j against a stored baseline of round i <= j, under four comparators.

``stored`` keeps the baseline's outputs and scores, ``rescored`` scores them with
the current extractor, ``rerun`` generates them again now, ``fresh`` is the current
incumbent now.  Inflation is what stored wins more than rerun, and splits into
extraction (stored - rescored) and generation (rescored - rerun).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.stats import EPS, accepts, mcnemar_tail, rate, spread, wilson
from ledgerloom.plans.protocol import ALPHA, MARGIN, RULE, T4_AGE, T4_LABELS, T7_AGES, T7_CHANGED, T7_UNCHANGED, TAU
from ledgerloom.plans.matrix import ENVS, SCORES, STORAGE, duck, environments, packed, scores, spark_sql, trajectory
from ledgerloom.registry import query

REFS = ("stored", "rescored", "rerun", "fresh")
_STORAGE = next((d, x) for e, d, x in ENVS if e == STORAGE)


def spine(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """(seed, env, d_c, x_c, j, i, ref, cur), one row for each pair."""
    tr = trajectory(spark, d)
    a = tr.where("t > 0").select("seed", F.col("t").alias("j"), F.col("inc_slot").alias("cur"))
    b = tr.select("seed", F.col("t").alias("i"), F.col("inc_slot").alias("inc_i"))
    env = environments(spark).select("env", F.col("decoding").alias("d_c"), F.col("extractor").alias("x_c"))
    ref = F.col("i") if mode == "chain" else F.col("inc_i")
    return a.join(b, "seed").where("i <= j").crossJoin(F.broadcast(env)).select("seed", "env", "d_c", "x_c", "j", "i", ref.alias("ref"), "cur")  # rounds and environments are fixed


def _mask(extractor: Column) -> Column:
    return F.when(extractor == "v1", F.col("v1")).otherwise(F.col("v2"))


def ground_truth(cells: DataFrame, same_draw: bool = False) -> DataFrame:
    """(seed, decoding, slot, draw, extractor, acc): a greedy cell itself, for sampling the mean of the ground-truth draws whatever the round.

    With ``same_draw`` sampled cells are their own truth as well, which couples decision and truth.
    """
    long = cells.select("*", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("extractor"))
    acc = lambda df, *by: df.groupBy(*by).agg((F.sum(F.bit_count(_mask(F.col("extractor")))) / F.sum(F.bit_count("p"))).alias("acc"))
    greedy = acc(long.where("draw_kind = 'round'" if same_draw else "decoding = 'greedy' AND draw_kind = 'round'"), "seed", "decoding", "slot", "draw", "extractor")
    drawn = acc(long.where("draw_kind = 'gt'"), "seed", "decoding", "slot", "extractor").withColumn("draw", F.lit(-1))
    return greedy if same_draw else greedy.unionByName(drawn)


ROLES = ("cand", *REFS)


class MissingCell(LookupError):
    """A pair needs a cell that isn't complete."""


def _counted(spark: SparkSession, d: str, mode: str, rows: DataFrame, truth: DataFrame, same_draw: bool = False) -> DataFrame:
    """Every pair of the spine with its counts, the items each of its cells has (n_<role>), and ground truth; counts are null without cells."""
    cells = packed(rows)
    rounds = cells.where("draw_kind = 'round'").drop("draw_kind")
    d_st, x_st = (F.lit(v) for v in _STORAGE)
    wanted = {
        "stored": (d_st, F.col("ref"), F.col("i"), x_st),
        "rescored": (d_st, F.col("ref"), F.col("i"), F.col("x_c")),
        "rerun": (F.col("d_c"), F.col("ref"), F.col("j"), F.col("x_c")),
        "fresh": (F.col("d_c"), F.col("cur"), F.col("j"), F.col("x_c")),
        "cand": (F.col("d_c"), F.col("j"), F.col("j"), F.col("x_c")),
    }
    pairs = spine(spark, d, mode)
    role = lambda name, v: F.struct(F.lit(name).alias("role"), v[0].alias("decoding"), v[1].cast("int").alias("slot"), v[2].cast("int").alias("draw"), v[3].alias("x"))
    roles = pairs.select("seed", "env", "j", "i", F.explode(F.array(*[role(k, v) for k, v in wanted.items()])).alias("r")).select("seed", "env", "j", "i", "r.*")
    got = rounds.join(F.broadcast(roles), ["seed", "decoding", "slot", "draw"])  # a few thousand roles, fixed by rounds and environments
    of = lambda k, c: F.max(F.when(F.col("role") == k, c))
    none = F.lit(0).cast("bigint")
    wide = got.groupBy("seed", "env", "j", "i", "block").agg(
        *[F.coalesce(of(k, _mask(F.col("x"))), none).alias(k) for k in wanted],
        *[F.coalesce(of(k, F.col("p")), none).alias(f"p_{k}") for k in wanted],
        F.coalesce(of("rerun", F.col("truncated")), none).alias("t"),
        of("stored", F.col("gens")).alias("g_stored"), of("rerun", F.col("gens")).alias("g_rerun"),
    )
    ones = lambda c: F.sum(F.bit_count(c))
    counts = wide.groupBy("seed", "env", "j", "i").agg(
        *[ones(F.col(f"p_{k}")).alias(f"n_{k}") for k in ROLES],
        rate(ones(F.col("t")), ones(F.col("p_rerun"))).alias("trunc_rerun"),
        rate(F.sum(F.size(F.array_intersect("g_stored", "g_rerun"))), ones(F.col("p_stored").bitwiseAND(F.col("p_rerun")))).alias("same"),
        *[ones(F.col("cand").bitwiseAND(F.bitwise_not(k))).alias(f"w_{k}") for k in REFS],
        *[ones(F.bitwise_not("cand").bitwiseAND(F.col(k))).alias(f"l_{k}") for k in REFS],
    )
    gt = ground_truth(cells if truth is rows else packed(truth), same_draw)
    at = F.col("j") if same_draw else F.when(F.col("d_c") == "greedy", F.col("j")).otherwise(F.lit(-1))
    out = pairs.join(counts, ["seed", "env", "j", "i"], "left").withColumn("_at", at).withColumn("cand_slot", F.col("j"))
    for name, slot in (("gt_cand", "cand_slot"), ("gt_cur", "cur"), ("gt_ref", "ref")):
        found = gt.select("seed", F.col("decoding").alias("d_c"), F.col("slot").alias(slot), F.col("draw").alias("_at"), F.col("extractor").alias("x_c"), F.col("acc").alias(name))
        out = out.join(found, ["seed", "d_c", slot, "_at", "x_c"], "left")
    return out


def _reason(n_items: Column) -> Column:
    """Why a pair can't be judged: the first of its cells that lacks items, or ground truth; null if it can."""
    lacks = [F.when(F.coalesce(F.col(f"n_{k}"), F.lit(0)) < n_items, F.lit(f"missing cell: {k}")) for k in ROLES]
    return F.coalesce(*lacks, F.when(F.col("gt_cand").isNull() | F.col("gt_cur").isNull() | F.col("gt_ref").isNull(), F.lit("missing ground truth")))


def _halves(rows: DataFrame, half: bool) -> tuple[DataFrame, DataFrame]:
    if not half:
        return rows, rows
    split = rows.crossJoin(F.broadcast(rows.agg(((F.max("item") + 1) / 2).cast("int").alias("mid"))))  # one row
    return split.where("item < mid").drop("mid"), split.where("item >= mid").drop("mid")


def skipped_pairs(spark: SparkSession, d: str, rows: DataFrame, mode: str = "incumbent", half: bool = False) -> DataFrame:
    """(seed, env, j, i, reason): pairs that need a cell without all items, or ground truth that isn't there."""
    decide_on, truth_on = _halves(rows, half)
    n_items = F.broadcast(decide_on.agg(F.count_distinct("item").alias("n_items")))  # one row
    judged = _counted(spark, d, mode, decide_on, truth_on).crossJoin(n_items).withColumn("reason", _reason(F.col("n_items")))
    return judged.where("reason IS NOT NULL").select("seed", "env", "j", "i", "reason")


def all_pairs(spark: SparkSession, d: str, mode: str = "incumbent", rule: str = RULE, half: bool = False, rows: DataFrame | None = None, on_missing: str = "skip", same_draw: bool = False) -> DataFrame:
    """One row per pair; ``half`` decides on the first half of the items and takes ground truth from the second, ``same_draw`` takes it from the cells compared.

    ``rows`` are cells item by item (seed, decoding, slot, draw_kind, draw, item,
    physical, truncated, generation, v1, v2), by default the synthetic matrix.  A pair
    one of whose cells lacks items is left out (``skipped_pairs`` lists it), or raises
    ``MissingCell`` with ``on_missing`` "raise".
    """
    rows = scores(spark, d) if rows is None else rows
    decide_on, truth_on = _halves(rows, half)
    n_items = F.broadcast(decide_on.agg(F.count_distinct("item").alias("n_items")))  # one row
    judged = _counted(spark, d, mode, decide_on, truth_on, same_draw).crossJoin(n_items).withColumn("reason", _reason(F.col("n_items")))
    if on_missing == "raise" and (bad := judged.where("reason IS NOT NULL").select("seed", "env", "j", "i", "reason").first()) is not None:
        raise MissingCell(str(bad.asDict()))
    out = judged.where("reason IS NULL").withColumn("n", F.col("n_cand"))
    n = F.col("n")
    tail = {k: mcnemar_tail(F.col(f"w_{k}"), F.col(f"l_{k}")) if rule == "mcnemar" else None for k in REFS}
    dec = {k: accepts(rule, F.col(f"w_{k}"), F.col(f"l_{k}"), n, MARGIN, TAU, tail[k], ALPHA) for k in REFS}
    worse = {c: F.col("gt_cand") <= F.col(f"gt_{c}") + EPS for c in ("cur", "ref")}
    same_frac = F.when(F.col("d_c") == _STORAGE[0], F.col("same")).otherwise(F.lit(0.0))
    part = {"infl_extract": rate(F.col("w_stored") - F.col("w_rescored"), n), "infl_generation": rate(F.col("w_rescored") - F.col("w_rerun"), n)}
    return out.select(
        "seed", "env", "j", "i", (F.col("j") - F.col("i")).alias("age"), F.col("ref").alias("ref_slot"), F.col("cur").alias("cur_slot"), "n",
        *[f"w_{k}" for k in REFS], *[f"l_{k}" for k in REFS], *[rate(F.col(f"w_{k}"), n).alias(f"win_{k}") for k in REFS],
        (part["infl_extract"] + part["infl_generation"]).alias("inflation"), *[v.alias(k) for k, v in part.items()],
        *[dec[k].alias(f"dec_{k}") for k in REFS], (dec["stored"] != dec["rerun"]).alias("flip"),
        "gt_cand", "gt_cur", "gt_ref",
        *[(dec[k] & worse[c]).alias(f"fa_{c}_{k}") for c in ("cur", "ref") for k in REFS],
        same_frac.alias("same_gen_frac"), ((same_frac == 1.0) & (F.col("x_c") == _STORAGE[1])).alias("by_construction"), "trunc_rerun", (F.col("env") != STORAGE).alias("env_changed"),
    )


def item_diffs(spark: SparkSession, d: str, age: int, mode: str = "incumbent", rows: DataFrame | None = None) -> DataFrame:
    """(env, item, x): per item the mean over pairs of that age of (candidate beats stored) - (candidate beats rerun), the unit of resampling."""
    rows = (scores(spark, d) if rows is None else rows).where("draw_kind = 'round'").select("seed", "decoding", "slot", "draw", "item", "v1", "v2")
    pairs = spine(spark, d, mode).where(F.col("j") - F.col("i") == age)
    role = lambda name, dec, slot, draw, x: F.struct(F.lit(name).alias("role"), dec.alias("decoding"), slot.cast("int").alias("slot"), draw.cast("int").alias("draw"), x.alias("x"))
    d_st, x_st = (F.lit(v) for v in _STORAGE)
    three = F.array(role("cand", F.col("d_c"), F.col("j"), F.col("j"), F.col("x_c")), role("stored", d_st, F.col("ref"), F.col("i"), x_st), role("rerun", F.col("d_c"), F.col("ref"), F.col("j"), F.col("x_c")))
    roles = pairs.select("seed", "env", "j", "i", F.explode(three).alias("r")).select("seed", "env", "j", "i", "r.*")
    got = rows.join(F.broadcast(roles), ["seed", "decoding", "slot", "draw"])  # fixed by rounds and environments
    of = lambda k: F.max(F.when(F.col("role") == k, _mask(F.col("x"))))
    wide = got.groupBy("seed", "env", "j", "i", "item").agg(of("cand").alias("c"), of("stored").alias("s"), of("rerun").alias("r"))
    return wide.groupBy("env", "item").agg(F.avg(F.col("c") * (1 - F.col("s")) - F.col("c") * (1 - F.col("r"))).alias("x"))


def summary(pairs: DataFrame, *by: str) -> DataFrame:
    """Pooled rates and two-level means of pairs grouped by ``by``; no names make one global row."""
    total = {k: F.sum(f"w_{k}") for k in REFS}
    n = F.sum("n")
    share = lambda c: F.avg(F.col(c).cast("int"))
    fa, dec = F.sum(F.col("fa_cur_stored").cast("int")), F.sum(F.col("dec_stored").cast("int"))
    pooled = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("seed").alias("n_seeds"), *[rate(total[k], n).alias(f"win_{k}") for k in REFS],
        rate(total["stored"] - total["rerun"], n).alias("inflation"), rate(total["stored"] - total["rescored"], n).alias("infl_extract"), rate(total["rescored"] - total["rerun"], n).alias("infl_generation"),
        F.bool_and("by_construction").alias("all_by_construction"), share("flip").alias("flip_rate"), share("by_construction").alias("by_construction_frac"), F.avg("trunc_rerun").alias("trunc_rerun"),
        dec.alias("n_accepted"), rate(fa, dec).alias("far"), wilson(fa, dec, False).alias("far_lo"), wilson(fa, dec, True).alias("far_hi"),
    )
    seeds = pairs.groupBy(*by, "seed").agg(F.avg("inflation").alias("m")).groupBy(*by).agg(F.avg("m").alias("inflation_seed_mean"), spread(F.col("m")).alias("inflation_seed_sd"))
    if not by:
        return pooled.crossJoin(F.broadcast(seeds))  # one row each
    on = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by])
    return pooled.alias("p").join(seeds.alias("s"), on).select("p.*", "s.inflation_seed_mean", "s.inflation_seed_sd")


def _pairs_sql(mode: str = "incumbent", half: bool = False, same_draw: bool = False) -> str:
    keep, truth = ("item < m", "item >= m") if half else ("true", "true")
    pick = lambda a, x: f"CASE WHEN {x} = 'v1' THEN {a}.v1 ELSE {a}.v2 END"
    on = lambda a, dec, slot, draw: f"JOIN dd {a} ON {a}.seed = sp.seed AND {a}.decoding = {dec} AND {a}.slot = {slot} AND {a}.draw = {draw}"
    gt = lambda slot: f"(SELECT acc FROM gt WHERE gt.seed = q.seed AND gt.decoding = q.d_c AND gt.slot = q.{slot} AND gt.extractor = q.x_c AND gt.draw = {'q.j' if same_draw else "CASE WHEN q.d_c = 'greedy' THEN q.j ELSE -1 END"})"
    of = "draw_kind = 'round'" if same_draw else "(draw_kind = 'gt' OR decoding = 'greedy')"
    return f"""WITH {SCORES},
    mm AS (SELECT (max(item) + 1) // 2 AS m FROM it),
    dd AS (SELECT sc.* FROM sc, mm WHERE draw_kind = 'round' AND {keep}),
    gl AS (SELECT seed, decoding, slot, CASE WHEN draw_kind = 'gt' THEN -1 ELSE draw END AS draw, v1, v2 FROM sc, mm WHERE {of} AND {truth}),
    gt AS (SELECT seed, decoding, slot, draw, 'v1' AS extractor, sum(v1) / count(*) AS acc FROM gl GROUP BY ALL UNION ALL SELECT seed, decoding, slot, draw, 'v2', sum(v2) / count(*) FROM gl GROUP BY ALL),
    sp AS (SELECT a.seed, env, decoding AS d_c, extractor AS x_c, a.t AS j, b.t AS i, {"b.t" if mode == "chain" else "b.inc_slot"} AS ref, a.inc_slot AS cur, a.t AS cand_slot
      FROM tr a JOIN tr b ON a.seed = b.seed AND b.t <= a.t AND a.t > 0 CROSS JOIN envs),
    f AS (SELECT sp.*, c.item, {pick("c", "x_c")} AS cand, {pick("s", "'v1'")} AS stored, {pick("s", "x_c")} AS rescored, {pick("r", "x_c")} AS rerun, {pick("h", "x_c")} AS fresh, r.truncated AS tr_,
      CASE WHEN d_c = 'greedy' AND s.generation = r.generation THEN 1.0 ELSE 0.0 END AS same
      FROM sp {on("c", "d_c", "j", "j")} {on("s", "'greedy'", "ref", "i")} AND s.item = c.item {on("r", "d_c", "ref", "j")} AND r.item = c.item {on("h", "d_c", "cur", "j")} AND h.item = c.item),
    q AS (SELECT seed, env, d_c, x_c, j, i, ref, cur, cand_slot, count(*) AS n, avg(same) AS same_gen_frac, avg(tr_) AS trunc_rerun,
      {", ".join(f"CAST(sum(cand * (1 - {k})) AS BIGINT) AS w_{k}, CAST(sum((1 - cand) * {k}) AS BIGINT) AS l_{k}" for k in REFS)} FROM f GROUP BY ALL),
    g AS (SELECT *, {gt("cand_slot")} AS gt_cand, {gt("cur")} AS gt_cur, {gt("ref")} AS gt_ref FROM q),
    pairs AS (SELECT seed, env, j, i, j - i AS age, ref AS ref_slot, cur AS cur_slot, n, {", ".join(f"w_{k}, l_{k}, CAST(w_{k} AS DOUBLE) / n AS win_{k}" for k in REFS)},
      CAST(w_stored - w_rerun AS DOUBLE) / n AS inflation, CAST(w_stored - w_rescored AS DOUBLE) / n AS infl_extract, CAST(w_rescored - w_rerun AS DOUBLE) / n AS infl_generation,
      {", ".join(f"w_{k} > l_{k} AS dec_{k}" for k in REFS)}, (w_stored > l_stored) <> (w_rerun > l_rerun) AS flip, gt_cand, gt_cur, gt_ref,
      {", ".join(f"w_{k} > l_{k} AND gt_cand <= gt_{c} + 1e-9 AS fa_{c}_{k}" for c in ("cur", "ref") for k in REFS)},
      same_gen_frac, same_gen_frac = 1 AND x_c = 'v1' AS by_construction, trunc_rerun, env <> 'E1' AS env_changed FROM g)"""


def _round(df: DataFrame) -> DataFrame:
    """Doubles to nine places, so that engines that add in other orders agree."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_DOUBLES = ("win_stored", "win_rescored", "win_rerun", "win_fresh", "inflation", "infl_extract", "infl_generation", "gt_cand", "gt_cur", "gt_ref", "same_gen_frac", "trunc_rerun")
_PAIRS = "SELECT * REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in _DOUBLES) + ") FROM pairs"


@query(duck(_pairs_sql()) + _PAIRS)
def all_pairs_incumbent(spark, d):
    return _round(all_pairs(spark, d))


@query(duck(_pairs_sql("chain")) + _PAIRS)
def all_pairs_chain(spark, d):
    return _round(all_pairs(spark, d, "chain"))


@query(duck(_pairs_sql(half=True)) + _PAIRS)
def all_pairs_split_half(spark, d):
    return _round(all_pairs(spark, d, half=True))


@query(duck(_pairs_sql(same_draw=True)) + _PAIRS)
def all_pairs_same_draw(spark, d):
    return _round(all_pairs(spark, d, same_draw=True))


def filter_pairs(pairs: DataFrame, envs: list[str] | None = None, ages: list[int] | None = None, seeds: list[int] | None = None) -> DataFrame:
    """The pairs of some environments, ages and seeds; None takes all."""
    for column, values in (("env", envs), ("age", ages), ("seed", seeds)):
        if values is not None:
            pairs = pairs.where(F.col(column).isin(*values)) if values else pairs.limit(0)
    return pairs


@query(duck(_pairs_sql()) + " SELECT seed, env, j, i, age, round(inflation, 9) AS inflation FROM pairs WHERE env IN ('E2', 'E4') AND age IN (1, 3) AND seed IN (0, 2)")
def pairs_filtered(spark, d):
    return _round(filter_pairs(all_pairs(spark, d), ["E2", "E4"], [1, 3], [0, 2]).select("seed", "env", "j", "i", "age", "inflation"))


_Z = 1.959963984540054
_W = "round(greatest(0, least(1, (far + {z2} / (2 * n_accepted) {s} {z} * sqrt(far * (1 - far) / n_accepted + {z2} / (4.0 * n_accepted * n_accepted))) / (1 + {z2} / n_accepted))), 9)"


def _summary_sql(by: str, full: bool = False) -> str:
    group, on = (f"GROUP BY {by}", f"USING ({by})") if by else ("", "ON true")
    lead = f"{by}, " if by else ""
    bound = lambda s: _W.format(z=_Z, z2=_Z * _Z, s=s)
    return f""", a AS (SELECT {lead}count(*) AS n_pairs, count(DISTINCT seed) AS n_seeds, {", ".join(f"round(sum(w_{k}) / sum(n), 9) AS win_{k}" for k in REFS)}, round((sum(w_stored) - sum(w_rerun)) / sum(n), 9) AS inflation,
    round((sum(w_stored) - sum(w_rescored)) / sum(n), 9) AS infl_extract, round((sum(w_rescored) - sum(w_rerun)) / sum(n), 9) AS infl_generation, bool_and(by_construction) AS all_by_construction,
    round(avg(CASE WHEN flip THEN 1.0 ELSE 0 END), 9) AS flip_rate, round(avg(CASE WHEN by_construction THEN 1.0 ELSE 0 END), 9) AS by_construction_frac, round(avg(trunc_rerun), 9) AS trunc_rerun,
    count(*) FILTER (dec_stored) AS n_accepted, count(*) FILTER (fa_cur_stored) / nullif(count(*) FILTER (dec_stored), 0) AS far FROM pairs {group}),
    b AS (SELECT {lead}round(avg(m), 9) AS inflation_seed_mean, round(CASE WHEN count(m) = 1 THEN 0 ELSE stddev_samp(m) END, 9) AS inflation_seed_sd FROM (SELECT {lead}seed, avg(inflation) AS m FROM pairs GROUP BY {lead}seed) {group})
    SELECT a.* REPLACE (round(far, 9) AS far), CASE WHEN n_accepted > 0 THEN {bound("-")} END AS far_lo, CASE WHEN n_accepted > 0 THEN {bound("+")} END AS far_hi, b.inflation_seed_mean, b.inflation_seed_sd FROM a JOIN b {on}"""


@query(duck(_pairs_sql()) + _summary_sql("env, age"))
def pair_summary(spark, d):
    return _round(summary(all_pairs(spark, d), "env", "age"))


@query(duck(_pairs_sql()) + _summary_sql(""))
def pair_summary_global(spark, d):
    return _round(summary(all_pairs(spark, d)))


@query(duck(_pairs_sql()) + " SELECT env, age, count(*) AS n_pairs, round((sum(w_stored) - sum(w_rerun)) / sum(n), 9) AS inflation FROM pairs GROUP BY env, age")
def pairs_inflation_by_env_age(spark, d):
    n = F.sum("n")
    rows = all_pairs(spark, d).groupBy("env", "age").agg(F.count(F.lit(1)).alias("n_pairs"), rate(F.sum("w_stored") - F.sum("w_rerun"), n).alias("inflation"))
    return _round(rows)


@query(duck(_pairs_sql()) + " SELECT age, " + ", ".join(f"round((sum(w_stored) FILTER (env = '{e}') - sum(w_rerun) FILTER (env = '{e}')) / sum(n) FILTER (env = '{e}'), 9) AS {e.lower()}" for e, _, _ in ENVS) + " FROM pairs GROUP BY age")
def inflation_grid(spark, d):
    """Age by environment."""
    rows = all_pairs(spark, d).groupBy("age").pivot("env", [e for e, _, _ in ENVS]).agg(rate(F.sum("w_stored") - F.sum("w_rerun"), F.sum("n")))
    return _round(rows.select("age", *[F.col(e).alias(e.lower()) for e, _, _ in ENVS]))


def _cells_sql(spine: str, columns: str) -> str:
    return f"""{_summary_sql("env, age", full=True).replace("SELECT a.* REPLACE", ", sm AS (SELECT a.* REPLACE", 1)})
    SELECT {columns} FROM {spine} LEFT JOIN sm USING (env, age)"""


_TABLE_COLUMNS = ("win_stored", "win_rerun", "inflation", "infl_extract", "infl_generation", "flip_rate", "by_construction_frac", "far", "far_lo", "far_hi", "inflation_seed_mean", "inflation_seed_sd")
_SHOWN = "coalesce(n_pairs, 0) AS n_pairs, coalesce(n_seeds, 0) AS n_seeds, " + ", ".join(_TABLE_COLUMNS) + ", coalesce(all_by_construction, false) AS by_construction"


def table_of(spine: DataFrame, pairs: DataFrame) -> DataFrame:
    """``spine`` (env, age, ...) with the summary of its cells; cells without pairs keep their row with 0 pairs."""
    rows = spine.join(summary(pairs, "env", "age"), ["env", "age"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pairs", "n_seeds")}
    return rows.select(*spine.columns, *zero.values(), *_TABLE_COLUMNS, F.coalesce("all_by_construction", F.lit(False)).alias("by_construction"))


_T7 = [(e, a, f"{name} ({e})") for a in T7_AGES for e, name in ((T7_UNCHANGED, "Unchanged"), (T7_CHANGED, "Changed"))]
_T4 = [(e, T4_AGE, label) for e, label in T4_LABELS.items()]
_values_of = lambda rows: "(VALUES " + ", ".join(f"('{e}', {a}, '{x}')" for e, a, x in rows) + ") AS v(env, age, label)"


@query(duck(_pairs_sql()) + _cells_sql(_values_of(_T7), "env, age, label, " + _SHOWN))
def table_ages_by_change(spark, d):
    """T7: chosen ages under the unchanged and the changed environment."""
    return _round(table_of(spark.createDataFrame(_T7, "env string, age int, label string"), all_pairs(spark, d)))


@query(duck(_pairs_sql()) + _cells_sql(_values_of(_T4), "env, age, label, " + _SHOWN))
def table_envs_at_age(spark, d):
    """T4: every environment at the registered age."""
    return _round(table_of(spark.createDataFrame(_T4, "env string, age int, label string"), all_pairs(spark, d)))


_HOLE = "H('hole|' || seed || '|' || decoding || '|' || slot || '|' || draw) % 29 = 0 AND draw_kind = 'round'"


@query(
    duck(_pairs_sql().replace("dd AS (SELECT sc.* FROM sc, mm WHERE draw_kind = 'round' AND true)", f"dd AS (SELECT sc.* FROM sc, mm WHERE draw_kind = 'round' AND NOT ({_HOLE}))").replace("FROM sc, mm WHERE (draw_kind = 'gt'", f"FROM sc, mm WHERE NOT ({_HOLE}) AND (draw_kind = 'gt'"))
    + """, hv AS (SELECT DISTINCT seed, decoding, slot, draw FROM dd), c1 AS (SELECT sp.*, EXISTS (SELECT 1 FROM hv h WHERE h.seed = sp.seed AND h.decoding = d_c AND h.slot = j AND h.draw = j) AS cand,
      EXISTS (SELECT 1 FROM hv h WHERE h.seed = sp.seed AND h.decoding = 'greedy' AND h.slot = ref AND h.draw = i) AS stored, EXISTS (SELECT 1 FROM hv h WHERE h.seed = sp.seed AND h.decoding = d_c AND h.slot = ref AND h.draw = j) AS rerun,
      EXISTS (SELECT 1 FROM hv h WHERE h.seed = sp.seed AND h.decoding = d_c AND h.slot = cur AND h.draw = j) AS fresh FROM sp)
    SELECT seed, env, j, i, CASE WHEN NOT cand THEN 'missing cell: cand' WHEN NOT stored THEN 'missing cell: stored' WHEN NOT rerun THEN 'missing cell: rerun' ELSE 'missing cell: fresh' END AS reason
    FROM c1 WHERE NOT (cand AND stored AND rerun AND fresh)"""
)
def pairs_skipped(spark, d):
    """Pairs of a matrix with holes (every 29th cell by hash is lost) that can't be judged, with the reason."""
    lost = spark_sql(_HOLE)
    return skipped_pairs(spark, d, scores(spark, d).where(f"NOT ({lost})"))


@query(duck(_pairs_sql()) + f" SELECT env, item, round(avg(cand * (1 - stored) - cand * (1 - rerun)), 9) AS x FROM f WHERE j - i = {T4_AGE} GROUP BY 1, 2")
def pair_item_diffs(spark, d):
    """Per item and environment the drift at the registered age."""
    return _round(item_diffs(spark, d, T4_AGE))


_MC = "wins_ > losses_ AND (SELECT sum(exp(lgamma(m + 1.0) - lgamma(q + 1.0) - lgamma(m - q + 1.0) - m * ln(2.0))) FROM (SELECT wins_ + losses_ AS m, unnest(range(wins_, wins_ + losses_ + 1)) AS q)) < " + str(ALPHA)


@query(
    duck(_pairs_sql())
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT seed, env, j, i, '{k}' AS comparator, w_{k} AS wins_, l_{k} AS losses_, n FROM pairs" for k in REFS)
    + f") SELECT comparator, env, count(*) FILTER (CAST(wins_ - losses_ AS DOUBLE) / n > {MARGIN}) AS net_win, count(*) FILTER (wins_ > losses_ AND CAST(wins_ AS DOUBLE) / n >= {TAU}) AS win_rate, count(*) FILTER ({_MC}) AS mcnemar FROM u GROUP BY 1, 2"
)
def promotions_by_rule(spark, d):
    """How many pairs each promotion rule accepts under each comparator."""
    pairs = all_pairs(spark, d)
    long = pairs.select("env", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("comparator"), F.col(f"w_{k}").alias("w"), F.col(f"l_{k}").alias("l")) for k in REFS])).alias("r")).select("env", "n", "r.*")
    w, l, n = F.col("w"), F.col("l"), F.col("n")
    return long.groupBy("comparator", "env").agg(
        F.count_if(accepts("net_win", w, l, n, MARGIN)).alias("net_win"), F.count_if(accepts("win_rate", w, l, n, tau=TAU)).alias("win_rate"), F.count_if(accepts("mcnemar", w, l, n, tail=mcnemar_tail(w, l), alpha=ALPHA)).alias("mcnemar")
    )
