"""Replay of baseline-refresh policies over the rounds of a trajectory.

Every step compares the candidate of round t with a stored baseline that a slot,
a round, a decoding and an extractor determine; all those comparisons are
precomputed as one fact table (``duels``).  The replay itself is a fold over the
rounds, sequential in t and parallel over schedules, policies and seeds: one
``aggregate`` in the JVM for each of them, no Python.

Policies: ``frozen`` never refreshes (``frozen_adopt`` takes over promoted
candidates), ``per_batch`` refreshes every round, ``env_triggered`` when the
environment changes, ``age_triggered`` at age k, ``component_aware`` generates
again when the decoding changes and only scores again when the extractor does,
``oracle`` goes by ground truth, ``fixed_age`` compares with the incumbent of k
rounds ago.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stats import EPS, accepts, rate, spread, wilson
from ledgerloom.plans import protocol
from ledgerloom.plans.matrix import ENVS, SCHEDULE, SCORES, R, duck, environments, packed, scores
from ledgerloom.plans.pairs import _mask, _pairs_sql, _round, all_pairs, ground_truth
from ledgerloom.registry import query

# (name, kind, adopts a promoted candidate, k)
POLICIES = (("P1", "frozen", False, 0), ("P1b", "frozen_adopt", True, 0), ("P2", "per_batch", True, 0), ("P3", "env_triggered", True, 0), ("P4_k3", "age_triggered", True, 3), ("P5", "component_aware", True, 0), ("ORACLE", "oracle", False, 0), ("FIXEDAGE_k1", "fixed_age", False, 1))
DEFAULT = (("default", SCHEDULE),)
ABLATIONS = tuple((a.name, a.schedule) for a in protocol.ABLATIONS)


def parse_policy(name: str) -> tuple[str, str, bool, int]:
    """The policy of a name, whatever its case; P4_k<n> and FIXEDAGE_k<n> take any n."""
    low = name.strip().lower()
    for policy in POLICIES:
        if policy[0].lower() == low:
            return policy
    for head, kind, adopts in (("p4_k", "age_triggered", True), ("fixedage_k", "fixed_age", False)):
        if low.startswith(head) and low[len(head) :].isdigit():
            k = int(low[len(head) :])
            return (f"{'P4' if adopts else 'FIXEDAGE'}_k{k}", kind, adopts, k)
    raise ValueError(f"unknown policy {name!r}")


def dense(changes: tuple[tuple[int, str], ...], rounds: int | None = None) -> list[tuple[int, str]]:
    """The environment of every round: the one of the greatest change at or before it."""
    if not changes or min(changes)[0] != 0:
        raise ValueError("a schedule must define round 0")
    return [(t, max((c for c in changes if c[0] <= t), key=lambda c: c[0])[1]) for t in range((R if rounds is None else rounds) + 1)]


def schedules(spark: SparkSession, named: tuple) -> DataFrame:
    rows = [(name, t, env) for name, changes in named for t, env in dense(changes)]
    return spark.createDataFrame(rows, "schedule string, t int, env string").join(F.broadcast(environments(spark)), "env")


def duels(cells: DataFrame) -> DataFrame:
    """(seed, t, d, x, ref_slot, ref_round, ref_d, ref_x, w, l, n): the candidate of round t under (d, x) against every stored baseline of rounds up to t."""
    rounds = cells.where("draw_kind = 'round'")
    both = F.explode(F.array(F.lit("v1"), F.lit("v2")))
    cand = rounds.where("slot = draw AND slot > 0").select("seed", "block", F.col("draw").alias("t"), F.col("decoding").alias("d"), "p", "v1", "v2").withColumn("x", both)
    cand = cand.select("seed", "block", "t", "d", "x", "p", _mask(F.col("x")).alias("c"))
    ref = rounds.select("seed", "block", F.col("slot").alias("ref_slot"), F.col("draw").alias("ref_round"), F.col("decoding").alias("ref_d"), "v1", "v2").withColumn("ref_x", both)
    ref = ref.select("seed", "block", "ref_slot", "ref_round", "ref_d", "ref_x", _mask(F.col("ref_x")).alias("s"))
    ones = lambda c: F.sum(F.bit_count(c)).cast("int")
    met = cand.join(ref, ["seed", "block"]).where("ref_round <= t")
    return met.groupBy("seed", "t", "d", "x", "ref_slot", "ref_round", "ref_d", "ref_x").agg(ones(F.col("c").bitwiseAND(F.bitwise_not("s"))).alias("w"), ones(F.bitwise_not("c").bitwiseAND(F.col("s"))).alias("l"), ones(F.col("p")).alias("n"))


_STEP = "named_struct('t', t, 'env', env, 'd', decoding, 'x', extractor)"
_LOG = "array<struct<t:int,env:string,ref_slot:int,ref_round:int,ref_env:string,ref_d:string,ref_x:string,refresh:string,wins:int,losses:int,n:int,accepted:boolean,gt_cand:double,gt_inc:double,inc_before:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def replay(spark: SparkSession, cells: DataFrame, named: tuple, policies: tuple) -> DataFrame:
    """One row for each schedule, policy, seed and round: the baseline used, what happened to it, the decision."""
    duel = duels(cells).select("seed", F.concat_ws("|", "t", "d", "x").alias("at"), F.concat_ws("|", "ref_slot", "ref_round", "ref_d", "ref_x").alias("k"), F.struct("w", "l", "n").alias("v"))
    # two levels, as a map is searched from its start; its size follows rounds x slots, not the items
    duel = duel.groupBy("seed", "at").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    duel = duel.groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("duel"))
    gt = ground_truth(cells).select("seed", F.concat_ws("|", "decoding", "slot", "draw", "extractor").alias("k"), F.col("acc").alias("v"))
    gt = gt.groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("gt"))
    steps = schedules(spark, named).groupBy("schedule").agg(F.sort_array(F.collect_list(F.expr(_STEP))).alias("steps"))
    spec = spark.createDataFrame(list(policies), "policy string, kind string, adopts boolean, k int")
    rows = duel.join(gt, "seed").crossJoin(F.broadcast(steps)).crossJoin(F.broadcast(spec))  # schedules and policies are parameters

    def truth(slot: Column, step: Column) -> Column:
        at = F.when(step["d"] == "greedy", step["t"]).otherwise(F.lit(-1))
        return F.element_at(F.col("gt"), F.concat_ws("|", step["d"], slot, at, step["x"]))

    first = F.col("steps")[0]
    none = F.from_json(F.lit("[]"), _LOG)
    ref0 = F.struct(F.lit(0).alias("slot"), F.lit(0).alias("round"), first["env"].alias("env"), first["d"].alias("d"), first["x"].alias("x"))
    start = F.struct(F.lit(0).alias("inc"), F.array(F.lit(0)).alias("hist"), ref0.alias("ref"), none.alias("log"))

    def refreshed(s: Column, step: Column) -> Column:
        """struct(ref, what): the baseline after this round's refresh rule."""
        ref, kind, t = s["ref"], F.col("kind"), step["t"]
        keep = F.struct(ref.alias("ref"), F.lit("none").alias("what"))
        new = F.struct(F.struct(s["inc"].alias("slot"), t.alias("round"), step["env"].alias("env"), step["d"].alias("d"), step["x"].alias("x")).alias("ref"), F.lit("refresh").alias("what"))
        again = F.struct(F.struct(ref["slot"].alias("slot"), ref["round"].alias("round"), step["env"].alias("env"), ref["d"].alias("d"), step["x"].alias("x")).alias("ref"), F.lit("rescore").alias("what"))
        back = F.greatest(t - F.col("k"), F.lit(0))
        then = F.element_at(F.col("steps"), back + 1)
        slot = F.element_at(s["hist"], back + 1)
        aged = F.struct(F.struct(slot.alias("slot"), back.alias("round"), then["env"].alias("env"), then["d"].alias("d"), then["x"].alias("x")).alias("ref"), F.lit("fixed_age").alias("what"))
        stays = (ref["slot"] == slot) & (ref["round"] == back) & (ref["env"] == then["env"])
        return (
            F.when(kind == "per_batch", new)
            .when((kind == "env_triggered") & (ref["env"] != step["env"]), new)
            .when((kind == "age_triggered") & (t - ref["round"] >= F.col("k")), new)
            .when((kind == "component_aware") & (ref["d"] != step["d"]), new)
            .when((kind == "component_aware") & (ref["x"] != step["x"]), again)
            .when((kind == "fixed_age") & ~stays, aged)
            .otherwise(keep)
        )

    def step_of(s: Column, step: Column) -> Column:
        s = F.struct(s["inc"].alias("inc"), F.when(step["t"] > 0, F.concat(s["hist"], F.array(s["inc"]))).otherwise(s["hist"]).alias("hist"), s["ref"].alias("ref"), s["log"].alias("log"))

        def decided(a: Column) -> Column:
            state, ref, what = a["s"], a["r"]["ref"], a["r"]["what"]
            key = F.concat_ws("|", ref["slot"], ref["round"], ref["d"], ref["x"])
            judged = F.struct(F.element_at(F.element_at(F.col("duel"), F.concat_ws("|", step["t"], step["d"], step["x"])), key).alias("v"), truth(step["t"], step).alias("gc"), truth(state["inc"], step).alias("gi"))

            def logged(j: Column) -> Column:
                oracle = F.col("kind") == "oracle"
                yes = F.when(oracle, j["gc"] > j["gi"] + EPS).otherwise(accepts(protocol.RULE, j["v"]["w"], j["v"]["l"], j["v"]["n"], protocol.MARGIN))
                only = lambda c, other: F.when(oracle, other).otherwise(c)
                row = F.struct(
                    step["t"].alias("t"), step["env"].alias("env"), only(ref["slot"], F.lit(-1)).alias("ref_slot"), only(ref["round"], F.lit(-1)).alias("ref_round"), only(ref["env"], F.lit("")).alias("ref_env"),
                    only(ref["d"], F.lit("")).alias("ref_d"), only(ref["x"], F.lit("")).alias("ref_x"), only(what, F.lit("none")).alias("refresh"), only(j["v"]["w"], F.lit(0)).alias("wins"), only(j["v"]["l"], F.lit(0)).alias("losses"),
                    j["v"]["n"].alias("n"), yes.alias("accepted"), j["gc"].alias("gt_cand"), j["gi"].alias("gt_inc"), state["inc"].alias("inc_before"),
                )
                adopted = F.struct(step["t"].alias("slot"), step["t"].alias("round"), step["env"].alias("env"), step["d"].alias("d"), step["x"].alias("x"))
                return F.struct(F.when(yes, step["t"]).otherwise(state["inc"]).alias("inc"), state["hist"].alias("hist"), F.when(yes & F.col("adopts"), adopted).otherwise(ref).alias("ref"), F.concat(state["log"], F.array(row)).alias("log"))

            return _let(judged, logged)

        return F.when(step["t"] == 0, s).otherwise(_let(F.struct(s.alias("s"), refreshed(s, step).alias("r")), decided))

    folded = rows.withColumn("log", F.aggregate("steps", start, step_of, lambda s: s["log"]))
    flat = folded.select("schedule", "policy", "seed", F.explode("log").alias("r")).select("schedule", "policy", "seed", "r.*")
    out = flat.withColumn("false_accept", F.col("accepted") & (F.col("gt_cand") <= F.col("gt_inc") + EPS))
    out = out.withColumn("inc_after", F.when(F.col("accepted"), F.col("t")).otherwise(F.col("inc_before")))
    out = out.withColumn("ref_age", F.when(F.col("ref_round") >= 0, F.col("t") - F.col("ref_round")).otherwise(F.lit(-1)))
    kept = F.col("ref_slot") >= 0
    out = out.withColumn("ties", F.when(kept, F.col("n") - F.col("wins") - F.col("losses")).otherwise(F.lit(0))).withColumn("ref_env_stale", kept & (F.col("ref_env") != F.col("env")))
    # model calls: the incumbent's and the candidate's evaluation, a proposal, and what refreshing or ground truth takes
    extra = F.when(F.col("policy") == "ORACLE", F.col("n")).when(F.col("refresh").isin("refresh", "fixed_age"), F.col("n")).otherwise(F.lit(0))
    return out.withColumn("calls", (F.lit(1) + 2 * F.col("n") + extra).cast("bigint")).drop("ref_d", "ref_x")


def _replay_sql(named: tuple) -> str:
    env = {e: (d, x) for e, d, x in ENVS}
    sched = ", ".join(f"('{name}', {t}, '{e}', '{env[e][0]}', '{env[e][1]}')" for name, changes in named for t, e in dense(changes))
    pol = ", ".join(f"('{n}', '{kind}', {str(a).lower()}, {k})" for n, kind, a, k in POLICIES)
    back = "greatest(s.t - k, 0)"
    then = lambda c: f"(SELECT {c} FROM sch b WHERE b.schedule = s.schedule AND b.t = {back})"
    # the refresh rule, column by column
    new = "kind = 'per_batch' OR (kind = 'env_triggered' AND r_env <> s.env) OR (kind = 'age_triggered' AND s.t - r_round >= k) OR (kind = 'component_aware' AND r_d <> s.d)"
    again = "kind = 'component_aware' AND r_d = s.d AND r_x <> s.x"
    rule = lambda n, g, a, old: f"CASE WHEN {new} THEN {n} WHEN {again} THEN {g} WHEN kind = 'fixed_age' THEN {a} ELSE {old} END"
    return f"""WITH RECURSIVE {SCORES},
    sch AS (SELECT * FROM (VALUES {sched}) AS v(schedule, t, env, d, x)), pol AS (SELECT * FROM (VALUES {pol}) AS v(policy, kind, adopts, k)),
    rr AS (SELECT seed, decoding, slot, draw, item, v1, v2 FROM sc WHERE draw_kind = 'round'),
    ref AS (SELECT *, 'v1' AS x, v1 AS v FROM rr UNION ALL SELECT *, 'v2', v2 FROM rr),
    duel AS (SELECT c.seed, c.slot AS t, c.decoding AS d, c.x, r.slot AS ref_slot, r.draw AS ref_round, r.decoding AS ref_d, r.x AS ref_x,
      CAST(sum(c.v * (1 - r.v)) AS BIGINT) AS w, CAST(sum((1 - c.v) * r.v) AS BIGINT) AS l, count(*) AS n
      FROM ref c JOIN ref r ON c.slot = c.draw AND c.slot > 0 AND r.seed = c.seed AND r.item = c.item AND r.draw <= c.slot GROUP BY ALL),
    gl AS (SELECT seed, decoding, slot, CASE WHEN draw_kind = 'gt' THEN -1 ELSE draw END AS draw, v1, v2 FROM sc WHERE draw_kind = 'gt' OR decoding = 'greedy'),
    gt AS (SELECT seed, decoding, slot, draw, 'v1' AS x, sum(v1) / count(*) AS acc FROM gl GROUP BY ALL UNION ALL SELECT seed, decoding, slot, draw, 'v2', sum(v2) / count(*) FROM gl GROUP BY ALL),
    f AS (
      SELECT s.schedule, policy, kind, adopts, k, seed, 0 AS t, CAST('' AS VARCHAR) AS env, 0 AS inc, [0] AS hist, 0 AS r_slot, 0 AS r_round, s.env AS r_env, s.d AS r_d, s.x AS r_x,
        0 AS u_slot, 0 AS u_round, s.env AS u_env, 'none' AS refresh, CAST(0 AS BIGINT) AS wins, CAST(0 AS BIGINT) AS losses, CAST(0 AS BIGINT) AS n, false AS accepted, CAST(0 AS DOUBLE) AS gt_cand, CAST(0 AS DOUBLE) AS gt_inc, 0 AS inc_before
      FROM sch s CROSS JOIN pol CROSS JOIN sd WHERE s.t = 0
      UNION ALL
      SELECT schedule, policy, kind, adopts, k, seed, t, env, CASE WHEN yes THEN t ELSE inc END, list_append(hist, inc), CASE WHEN yes AND adopts THEN t ELSE u_slot END, CASE WHEN yes AND adopts THEN t ELSE u_round END,
        CASE WHEN yes AND adopts THEN env ELSE u_env END, CASE WHEN yes AND adopts THEN d ELSE u_d END, CASE WHEN yes AND adopts THEN x ELSE u_x END, u_slot, u_round, u_env, what, w, l, n, yes, gc, gi, inc
      FROM (SELECT z.*, CASE WHEN kind = 'oracle' THEN gc > gi + 1e-9 ELSE w > l END AS yes FROM (
        SELECT y.*, duel.w, duel.l, duel.n, a.acc AS gc, b.acc AS gi FROM (
          SELECT s.schedule, policy, kind, adopts, k, seed, s.t, s.env, s.d, s.x, inc, hist,
            {rule("inc", "r_slot", f"list_extract(list_append(hist, inc), CAST({back} + 1 AS INT))", "r_slot")} AS u_slot, {rule("s.t", "r_round", back, "r_round")} AS u_round,
            {rule("s.env", "s.env", then("b.env"), "r_env")} AS u_env, {rule("s.d", "r_d", then("b.d"), "r_d")} AS u_d, {rule("s.x", "s.x", then("b.x"), "r_x")} AS u_x,
            CASE WHEN {new} THEN 'refresh' WHEN {again} THEN 'rescore' WHEN kind = 'fixed_age' AND NOT (r_slot = list_extract(list_append(hist, inc), CAST({back} + 1 AS INT)) AND r_round = {back} AND r_env = {then("b.env")}) THEN 'fixed_age' ELSE 'none' END AS what
          FROM f JOIN sch s ON s.schedule = f.schedule AND s.t = f.t + 1) y
        JOIN duel ON duel.seed = y.seed AND duel.t = y.t AND duel.d = y.d AND duel.x = y.x AND duel.ref_slot = u_slot AND duel.ref_round = u_round AND duel.ref_d = u_d AND duel.ref_x = u_x
        JOIN gt a ON a.seed = y.seed AND a.decoding = y.d AND a.slot = y.t AND a.x = y.x AND a.draw = CASE WHEN y.d = 'greedy' THEN y.t ELSE -1 END
        JOIN gt b ON b.seed = y.seed AND b.decoding = y.d AND b.slot = y.inc AND b.x = y.x AND b.draw = CASE WHEN y.d = 'greedy' THEN y.t ELSE -1 END) z)),
    o AS (SELECT schedule, policy, seed, t, env, CASE WHEN kind = 'oracle' THEN -1 ELSE u_slot END AS ref_slot, CASE WHEN kind = 'oracle' THEN -1 ELSE u_round END AS ref_round, CASE WHEN kind = 'oracle' THEN '' ELSE u_env END AS ref_env,
      CASE WHEN kind = 'oracle' THEN 'none' ELSE refresh END AS refresh, CASE WHEN kind = 'oracle' THEN 0 ELSE wins END AS wins, CASE WHEN kind = 'oracle' THEN 0 ELSE losses END AS losses, n, accepted, round(gt_cand, 9) AS gt_cand, round(gt_inc, 9) AS gt_inc, inc_before,
      CASE WHEN kind = 'oracle' THEN 0 ELSE n - wins - losses END AS ties, kind <> 'oracle' AND u_env <> env AS ref_env_stale, accepted AND gt_cand <= gt_inc + 1e-9 AS false_accept, CASE WHEN accepted THEN t ELSE inc_before END AS inc_after, CASE WHEN kind = 'oracle' THEN -1 ELSE t - u_round END AS ref_age,
      1 + 2 * n + CASE WHEN kind = 'oracle' OR refresh IN ('refresh', 'fixed_age') THEN n ELSE 0 END AS calls FROM f WHERE t > 0)"""


def _default(spark: SparkSession, d: str) -> DataFrame:
    return replay(spark, packed(scores(spark, d)), DEFAULT, POLICIES)


@query(duck(_replay_sql(DEFAULT)) + " SELECT * FROM o")
def policy_rounds(spark, d):
    return _round(_default(spark, d))


def finals(rounds: DataFrame, cells: DataFrame) -> DataFrame:
    """(schedule, policy, seed, final_inc, acc_canonical, acc_final): ground truth of the last incumbent under the canonical environment and the last round's."""
    env = environments(rounds.sparkSession)
    last = rounds.groupBy("schedule", "policy", "seed").agg(F.max_by("inc_after", "t").alias("final_inc"), F.max_by("env", "t").alias("last_env"), F.max("t").alias("t"))
    gt = ground_truth(cells)
    out = last
    for name, which in (("acc_canonical", F.lit(protocol.CANONICAL_ENV)), ("acc_final", F.col("last_env"))):
        at = out.withColumn("env", which).join(F.broadcast(env), "env").withColumn("draw", F.when(F.col("decoding") == "greedy", F.col("t")).otherwise(F.lit(-1)))
        truth = gt.select("seed", "decoding", F.col("slot").alias("final_inc"), "draw", "extractor", F.col("acc").alias(name))
        out = at.join(truth, ["seed", "decoding", "final_inc", "draw", "extractor"], "left").drop("env", "decoding", "draw", "extractor")
    return out.drop("last_env", "t")


_FINALS = f""", fi AS (SELECT schedule, policy, seed, max_by(inc_after, t) AS inc, max_by(env, t) AS env, max(t) AS t FROM o GROUP BY 1, 2, 3),
    ac AS (SELECT fi.schedule, fi.policy, fi.seed, fi.inc AS final_inc, a.acc AS acc_canonical, b.acc AS acc_final FROM fi JOIN envs ce ON ce.env = '{protocol.CANONICAL_ENV}' JOIN envs fe ON fe.env = fi.env
      JOIN gt a ON a.seed = fi.seed AND a.slot = fi.inc AND a.decoding = ce.decoding AND a.x = ce.extractor AND a.draw = CASE WHEN ce.decoding = 'greedy' THEN fi.t ELSE -1 END
      JOIN gt b ON b.seed = fi.seed AND b.slot = fi.inc AND b.decoding = fe.decoding AND b.x = fe.extractor AND b.draw = CASE WHEN fe.decoding = 'greedy' THEN fi.t ELSE -1 END)"""
_SPREAD = "round(CASE WHEN count({0}) = 1 THEN 0 ELSE stddev_samp({0}) END, 9)"


@query(
    duck(_replay_sql(DEFAULT))
    + _FINALS
    + f""", s AS (SELECT o.policy, o.seed, max(acc_canonical) AS acc, max(acc_final) AS accf, count(*) FILTER (false_accept) / nullif(count(*) FILTER (accepted), 0) AS far FROM o JOIN ac USING (schedule, policy, seed) GROUP BY 1, 2),
    p AS (SELECT policy, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS n_evaluated, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (false_accept) AS n_false, count(*) FILTER (refresh IN ('refresh', 'fixed_age')) AS n_refreshes, count(*) FILTER (refresh = 'rescore') AS n_rescores FROM o GROUP BY 1)
    SELECT policy, calls, n_evaluated, n_accepted, n_false, n_refreshes, n_rescores, round(n_false / nullif(n_accepted, 0), 9) AS far_pooled,
    round(avg(acc), 9) AS gt_acc_mean, {_SPREAD.format("acc")} AS gt_acc_sd, round(avg(accf), 9) AS gt_acc_final_mean, {_SPREAD.format("accf")} AS gt_acc_final_sd, round(avg(far), 9) AS far_seed_mean, {_SPREAD.format("far")} AS far_seed_sd, count(far) AS n_seeds_far
    FROM p JOIN s USING (policy) GROUP BY ALL"""
)
def policy_summary(spark, d):
    """One row per policy: accuracy of its last incumbent, false accepts by seed and pooled, calls."""
    cells = packed(scores(spark, d))
    rows = replay(spark, cells, DEFAULT, POLICIES)
    yes, wrong = F.count_if("accepted"), F.count_if("false_accept")
    total = rows.groupBy("policy").agg(
        F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("n_evaluated"), yes.alias("n_accepted"), wrong.alias("n_false"), F.count_if(F.col("refresh").isin("refresh", "fixed_age")).alias("n_refreshes"),
        F.count_if(F.col("refresh") == "rescore").alias("n_rescores"), F.round(rate(wrong, yes), 9).alias("far_pooled"),
    )
    seeds = rows.groupBy("policy", "seed").agg(rate(wrong, yes).alias("far")).join(finals(rows, cells).select("policy", "seed", "acc_canonical", "acc_final"), ["policy", "seed"])
    mean = lambda c, name: (F.round(F.avg(c), 9).alias(f"{name}_mean"), F.round(spread(F.col(c)), 9).alias(f"{name}_sd"))
    by = seeds.groupBy("policy").agg(*mean("acc_canonical", "gt_acc"), *mean("acc_final", "gt_acc_final"), *mean("far", "far_seed"), F.count("far").alias("n_seeds_far"))
    return total.join(by, "policy")


@query(duck(_replay_sql(DEFAULT)) + " SELECT policy, seed, CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (false_accept) AS n_false, max_by(inc_after, t) AS final_inc FROM o GROUP BY 1, 2")
def policy_per_seed(spark, d):
    return _default(spark, d).groupBy("policy", "seed").agg(F.sum("calls").alias("calls"), F.count_if("accepted").alias("n_accepted"), F.count_if("false_accept").alias("n_false"), F.max_by("inc_after", "t").alias("final_inc"))


@query(
    duck(_replay_sql(DEFAULT))
    + " SELECT policy, seed, ref_slot, ref_round, ref_env, min(t) AS first_used, max(t) AS last_used, count(*) AS n_uses FROM o WHERE ref_slot >= 0 GROUP BY ALL"
)
def policy_refs(spark, d):
    """The baselines each policy held, and the rounds it used them in."""
    rows = _default(spark, d).where("ref_slot >= 0")
    return rows.groupBy("policy", "seed", "ref_slot", "ref_round", "ref_env").agg(F.min("t").alias("first_used"), F.max("t").alias("last_used"), F.count(F.lit(1)).alias("n_uses"))


def calls_by_purpose(rounds: DataFrame, how: protocol.Convention, n_dev: Column | None = None, attempts: Column | None = None) -> DataFrame:
    """(schedule, policy, seed, the eight purposes, calls) summed over the rounds under a convention; ``n_dev`` defaults to the number of items."""
    n, dev = F.col("n"), F.col("n") if n_dev is None else n_dev
    tries = F.lit(1) if attempts is None or not how.attempts else attempts
    zero = F.lit(0)
    per = {
        "trajectory_dev": dev, "proposer": tries, "candidate_dev": dev if how.candidate_dev else zero, "candidate_eval": n,
        "reference_init": F.when((F.col("t") == 1) & (F.col("policy") != "ORACLE"), n).otherwise(zero) if how.initial else zero,
        "reference_refresh": F.when(F.col("refresh").isin("refresh", "fixed_age"), n).otherwise(zero), "rescore": zero, "oracle_gt": F.when(F.col("policy") == "ORACLE", n).otherwise(zero),
    }
    sums = rounds.groupBy("schedule", "policy", "seed").agg(*[F.sum(per[p]).cast("bigint").alias(p) for p in protocol.CALL_PURPOSES])
    return sums.withColumn("calls", sum((F.col(p) for p in protocol.CALL_PURPOSES[1:]), F.col(protocol.CALL_PURPOSES[0])))


@query(
    duck(_replay_sql(DEFAULT))
    + """, k AS (SELECT 'teammate_v1' AS convention, 0 AS more UNION ALL SELECT 'full', 1)
    SELECT convention, policy, seed, CAST(sum(n) AS BIGINT) AS trajectory_dev, count(*) AS proposer, CAST(sum(n * more) AS BIGINT) AS candidate_dev, CAST(sum(n) AS BIGINT) AS candidate_eval,
    CAST(sum(CASE WHEN t = 1 AND policy <> 'ORACLE' THEN n * more ELSE 0 END) AS BIGINT) AS reference_init, CAST(sum(CASE WHEN refresh IN ('refresh', 'fixed_age') THEN n ELSE 0 END) AS BIGINT) AS reference_refresh,
    CAST(0 AS BIGINT) AS rescore, CAST(sum(CASE WHEN policy = 'ORACLE' THEN n ELSE 0 END) AS BIGINT) AS oracle_gt,
    CAST(sum(calls + n * more + CASE WHEN t = 1 AND policy <> 'ORACLE' THEN n * more ELSE 0 END) AS BIGINT) AS calls FROM o CROSS JOIN k GROUP BY 1, 2, 3"""
)
def policy_calls(spark, d):
    """Logical model calls of each policy and seed by purpose, under both conventions."""
    rounds = _default(spark, d)
    parts = [calls_by_purpose(rounds, c).withColumn("convention", F.lit(c.name)) for c in protocol.CONVENTIONS.values()]
    return parts[0].unionByName(parts[1]).select("convention", "policy", "seed", *protocol.CALL_PURPOSES, "calls")


def references(rounds: DataFrame) -> DataFrame:
    """(schedule, policy, seed, ref_no, source, slot, created_round, env, rescored_round, parent, retired_round): the life of every baseline a policy held.

    A baseline begins at the start, by a refresh, a re-score (which keeps slot and
    round and names the one before as its parent) or by adopting a promoted candidate,
    and is retired when the next begins.
    """
    held = rounds.where("ref_slot >= 0")
    by = ["schedule", "policy", "seed"]
    start = held.where("t = 1").select(*by, F.lit(0).alias("at"), F.lit(0).alias("turn"), F.lit("initial").alias("source"), F.lit(0).alias("slot"), F.lit(0).alias("created_round"), F.col("first_env").alias("env"))
    made = held.where("refresh <> 'none'").select(*by, F.col("t").alias("at"), F.lit(0).alias("turn"), F.col("refresh").alias("source"), F.col("ref_slot").alias("slot"), F.col("ref_round").alias("created_round"), F.col("ref_env").alias("env"))
    adopted = held.where("accepted AND adopts").select(*by, F.col("t").alias("at"), F.lit(1).alias("turn"), F.lit("adopt").alias("source"), F.col("t").alias("slot"), F.col("t").alias("created_round"), "env")
    order = Window.partitionBy(*by).orderBy("at", "turn")  # a policy's rounds
    every = start.unionByName(made).unionByName(adopted).withColumn("ref_no", F.row_number().over(order) - 1).withColumn("retired_round", F.lead("at").over(order))
    again = F.col("source") == "rescore"
    return every.select(*by, "ref_no", "source", "slot", "created_round", "env", F.when(again, F.col("at")).alias("rescored_round"), F.when(again, F.col("ref_no") - 1).alias("parent"), "retired_round")


def _lifecycle_rows(spark, d) -> DataFrame:
    adopts = spark.createDataFrame([(p[0], p[2]) for p in POLICIES], "policy string, adopts boolean")
    return _default(spark, d).join(F.broadcast(adopts), "policy").withColumn("first_env", F.lit(SCHEDULE[0][1]))


@query(
    duck(_replay_sql(DEFAULT))
    + f""", a AS (SELECT o.*, p.adopts FROM o JOIN pol p USING (policy) WHERE ref_slot >= 0),
    e AS (SELECT policy, seed, 0 AS began, 0 AS turn, 'initial' AS source, 0 AS slot, 0 AS created_round, '{SCHEDULE[0][1]}' AS env FROM a WHERE t = 1
      UNION ALL SELECT policy, seed, t, 0, refresh, ref_slot, ref_round, ref_env FROM a WHERE refresh <> 'none' UNION ALL SELECT policy, seed, t, 1, 'adopt', t, t, env FROM a WHERE accepted AND adopts),
    n AS (SELECT *, CAST(row_number() OVER w - 1 AS INT) AS ref_no, lead(began) OVER w AS retired_round FROM e WINDOW w AS (PARTITION BY policy, seed ORDER BY began, turn))
    SELECT policy, seed, ref_no, source, slot, created_round, env, CASE WHEN source = 'rescore' THEN began END AS rescored_round, CASE WHEN source = 'rescore' THEN ref_no - 1 END AS parent, retired_round FROM n"""
)
def policy_ref_lifecycle(spark, d):
    return references(_lifecycle_rows(spark, d)).drop("schedule")


def schedule_flags(spark: SparkSession, named: tuple) -> DataFrame:
    """(schedule, decoding_changes, extraction_changes, first_change, envs_after_change, written), one row per schedule."""
    w = Window.partitionBy("schedule").orderBy("t")
    rows = schedules(spark, named)
    for c in ("env", "decoding", "extractor"):
        rows = rows.withColumn(f"p_{c}", F.lag(c).over(w))
    moved = F.col("p_env") != F.col("env")
    first = F.min(F.when(moved, F.col("t"))).over(Window.partitionBy("schedule"))
    rows = rows.withColumn("first_change", first)
    written = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("p_env").isNull() | moved, F.struct("t", "env")))), lambda s: F.concat(s["t"].cast("string"), F.lit(":"), s["env"])), ", ")
    after = F.array_join(F.sort_array(F.collect_set(F.when(F.col("t") >= F.col("first_change"), F.col("env")))), ",")
    return rows.groupBy("schedule").agg(
        F.coalesce(F.bool_or(F.col("p_decoding") != F.col("decoding")), F.lit(False)).alias("decoding_changes"), F.coalesce(F.bool_or(F.col("p_extractor") != F.col("extractor")), F.lit(False)).alias("extraction_changes"),
        F.min("first_change").alias("first_change"), after.alias("envs_after_change"), written.alias("written"),
    )


_FLAG_ROWS = "(VALUES " + ", ".join(f"('{n}', {t}, '{e}', '{dict((x[0], x) for x in ENVS)[e][1]}', '{dict((x[0], x) for x in ENVS)[e][2]}')" for n, c in ABLATIONS for t, e in dense(c)) + ") AS v(schedule, t, env, d, x)"
_FLAGS = f"""fl AS (SELECT *, lag(env) OVER w AS pe, lag(d) OVER w AS pd, lag(x) OVER w AS px FROM {_FLAG_ROWS} WINDOW w AS (PARTITION BY schedule ORDER BY t)),
    fc AS (SELECT *, min(t) FILTER (pe <> env) OVER (PARTITION BY schedule) AS first_change FROM fl),
    flags AS (SELECT schedule, coalesce(bool_or(pd <> d), false) AS decoding_changes, coalesce(bool_or(px <> x), false) AS extraction_changes, min(first_change) AS first_change,
      coalesce(string_agg(DISTINCT env, ',' ORDER BY env) FILTER (t >= first_change), '') AS envs_after_change, string_agg(t || ':' || env, ', ' ORDER BY t) FILTER (pe IS NULL OR pe <> env) AS written FROM fc GROUP BY 1)"""


@query(f"WITH {_FLAGS} SELECT * FROM flags")
def schedule_flags_table(spark, d):
    """Which component types each ablation's schedule changes, when first, and the environments from then on."""
    return schedule_flags(spark, ABLATIONS)


_AGES = ", ".join(f"('{a.name}', {protocol.T4_AGE if a.fixed_age is None else a.fixed_age}, '{'P3' if a.fixed_age is None else f'FIXEDAGE_k{a.fixed_age}'}')" for a in protocol.ABLATIONS)


@query(
    duck(_replay_sql(ABLATIONS) + "," + _FLAGS + ", " + _pairs_sql().split(SCORES + ",", 1)[1].replace("gl AS", "pgl AS").replace("FROM gl", "FROM pgl").replace("gt AS", "pgt AS").replace("FROM gt ", "FROM pgt gt ").replace("f AS (SELECT sp", "pf AS (SELECT sp").replace("FROM f GROUP", "FROM pf GROUP"))
    + _FINALS
    + f""", ag AS (SELECT * FROM (VALUES {_AGES}) AS v(schedule, inflation_age, p3_policy)),
    dft AS (SELECT ag.schedule, count(pairs.env) AS n_pairs, round(avg(inflation) * 100, 6) AS drift_inflation_pp FROM ag JOIN flags USING (schedule) LEFT JOIN pairs ON pairs.age = inflation_age AND list_contains(string_split(envs_after_change, ','), pairs.env) GROUP BY 1),
    fa AS (SELECT schedule, policy, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (false_accept) / nullif(count(*) FILTER (accepted), 0) AS far, sum(calls) / count(DISTINCT seed) AS calls FROM o GROUP BY 1, 2),
    ca AS (SELECT schedule, policy, avg(acc_canonical) AS acc FROM ac GROUP BY 1, 2)
    SELECT ag.schedule AS ablation, written, decoding_changes, extraction_changes, inflation_age, envs_after_change, n_pairs, drift_inflation_pp, p3_policy, round(a.far, 9) AS far_p1, round(b.far, 9) AS far_p1b, round(c.far, 9) AS far_p3,
    a.n_accepted AS n_accepted_p1, b.n_accepted AS n_accepted_p1b, c.n_accepted AS n_accepted_p3, round(acc, 9) AS gt_acc_p3, round(c.calls, 9) AS calls_p3
    FROM ag JOIN flags USING (schedule) JOIN dft USING (schedule) JOIN fa a ON a.schedule = ag.schedule AND a.policy = 'P1' JOIN fa b ON b.schedule = ag.schedule AND b.policy = 'P1b' JOIN fa c ON c.schedule = ag.schedule AND c.policy = p3_policy
    JOIN ca ON ca.schedule = ag.schedule AND ca.policy = p3_policy"""
)
def ablation_table(spark, d):
    """One row per registered ablation: its changes, drift inflation in percentage points, false accepts of P1, P1b and P3 (or the fixed age in its place)."""
    cells = packed(scores(spark, d))
    rounds = replay(spark, cells, ABLATIONS, POLICIES)
    ages = [(a.name, protocol.T4_AGE if a.fixed_age is None else a.fixed_age, "P3" if a.fixed_age is None else f"FIXEDAGE_k{a.fixed_age}") for a in protocol.ABLATIONS]
    heads = schedule_flags(spark, ABLATIONS).join(F.broadcast(spark.createDataFrame(ages, "schedule string, inflation_age int, p3_policy string")), "schedule")
    pairs = all_pairs(spark, d).select("env", "age", "inflation")
    wanted = heads.select("schedule", F.col("inflation_age").alias("age"), F.explode(F.split("envs_after_change", ",")).alias("env"))
    drift = pairs.join(F.broadcast(wanted), ["age", "env"]).groupBy("schedule").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("inflation") * 100, 6).alias("drift_inflation_pp"))
    yes, wrong = F.count_if("accepted"), F.count_if("false_accept")
    far = rounds.groupBy("schedule", "policy").agg(yes.alias("n_accepted"), F.round(rate(wrong, yes), 9).alias("far"), F.round(F.sum("calls") / F.count_distinct("seed"), 9).alias("calls"))
    acc = finals(rounds, cells).groupBy("schedule", "policy").agg(F.round(F.avg("acc_canonical"), 9).alias("acc"))
    of = lambda policy, name: far.where(F.col("policy") == policy).select("schedule", F.col("far").alias(f"far_{name}"), F.col("n_accepted").alias(f"n_accepted_{name}"))
    third = far.join(acc, ["schedule", "policy"]).select("schedule", F.col("policy").alias("p3_policy"), F.col("far").alias("far_p3"), F.col("n_accepted").alias("n_accepted_p3"), F.col("acc").alias("gt_acc_p3"), F.col("calls").alias("calls_p3"))
    out = heads.join(drift, "schedule", "left").join(of("P1", "p1"), "schedule").join(of("P1b", "p1b"), "schedule").join(third, ["schedule", "p3_policy"])
    names = ("written", "decoding_changes", "extraction_changes", "inflation_age", "envs_after_change")
    return out.select(F.col("schedule").alias("ablation"), *names, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "drift_inflation_pp", "p3_policy", "far_p1", "far_p1b", "far_p3", "n_accepted_p1", "n_accepted_p1b", "n_accepted_p3", "gt_acc_p3", "calls_p3")


@query(duck(_replay_sql(DEFAULT)) + " SELECT seed, t, round(max(gt_cand), 9) AS gt_cand, " + ", ".join(f"bool_or(accepted) FILTER (policy = '{p[0]}') AS {p[0].lower()}" for p in POLICIES) + " FROM o GROUP BY 1, 2")
def candidates_by_policy(spark, d):
    """Each candidate with the decision of every policy."""
    rows = _default(spark, d)
    truth = rows.groupBy("seed", "t").agg(F.round(F.max("gt_cand"), 9).alias("gt_cand"))
    wide = rows.groupBy("seed", "t").pivot("policy", [p[0] for p in POLICIES]).agg(F.bool_or("accepted"))
    return truth.join(wide.select("seed", "t", *[F.col(p[0]).alias(p[0].lower()) for p in POLICIES]), ["seed", "t"])


@query(
    duck(_replay_sql(ABLATIONS))
    + " SELECT schedule, policy, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (false_accept) AS n_false, round(count(*) FILTER (false_accept) / nullif(count(*) FILTER (accepted), 0), 9) AS far, CAST(sum(calls) AS BIGINT) AS calls FROM o GROUP BY 1, 2"
)
def ablations(spark, d):
    """All policies under every ablation schedule, in one pass."""
    rows = replay(spark, packed(scores(spark, d)), ABLATIONS, POLICIES)
    yes, wrong = F.count_if("accepted"), F.count_if("false_accept")
    return rows.groupBy("schedule", "policy").agg(yes.alias("n_accepted"), wrong.alias("n_false"), F.round(rate(wrong, yes), 9).alias("far"), F.sum("calls").alias("calls"))


def random_schedules(n: int, seed: int = protocol.SCHEDULE_SEED, changes: int = protocol.N_CHANGES) -> tuple:
    """``n`` schedules with ``changes`` changes at distinct rounds, each to another environment; the first m of them don't depend on n."""
    import random

    names = [e for e, _, _ in ENVS]
    out = []
    for k in range(n):
        rng = random.Random(f"{seed}|{k}")
        env, parts = "E1", [(0, "E1")]
        for t in sorted(rng.sample(range(1, R + 1), changes)):
            env = rng.choice([e for e in names if e != env])
            parts.append((t, env))
        out.append((f"R{k:03d}", tuple(parts)))
    return tuple(out)


RANDOM = random_schedules(protocol.N_SCHEDULES)


@query(
    duck(_replay_sql(RANDOM))
    + """, s AS (SELECT schedule, policy, count(*) FILTER (false_accept) / nullif(count(*) FILTER (accepted), 0) AS far, sum(calls) AS calls FROM o GROUP BY 1, 2)
    SELECT policy, count(*) AS n_schedules, round(avg(far), 9) AS far_mean, round(max(far), 9) AS far_max, CAST(sum(calls) AS BIGINT) AS calls FROM s GROUP BY 1"""
)
def schedule_randomization(spark, d):
    """False accepts of each policy over randomized schedules."""
    rows = replay(spark, packed(scores(spark, d)), RANDOM, POLICIES)
    each = rows.groupBy("schedule", "policy").agg(rate(F.count_if("false_accept"), F.count_if("accepted")).alias("far"), F.sum("calls").alias("calls"))
    return each.groupBy("policy").agg(F.count(F.lit(1)).alias("n_schedules"), F.round(F.avg("far"), 9).alias("far_mean"), F.round(F.max("far"), 9).alias("far_max"), F.sum("calls").alias("calls"))


@query(
    duck(_replay_sql(DEFAULT))
    + """, c AS (SELECT policy, seed, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(calls + n) + CASE WHEN policy = 'ORACLE' THEN 0 ELSE max(n) END AS BIGINT) AS calls_full, CAST(sum(calls - 1 - 2 * n) AS BIGINT) AS calls_reference FROM o GROUP BY 1, 2)
    SELECT policy, seed, calls, calls_full, calls_reference, round(calls / CAST(max(calls) FILTER (policy = 'P2') OVER (PARTITION BY seed) AS DOUBLE), 9) AS ratio_to_p2 FROM c"""
)
def policy_costs(spark, d):
    """Model calls per seed: the lean convention, the full one (candidate development and the first baseline too), those for references, and the ratio to refreshing every round."""
    first = F.when(F.col("policy") == "ORACLE", F.lit(0)).otherwise(F.max("n"))
    rows = _default(spark, d).groupBy("policy", "seed").agg(F.sum("calls").alias("calls"), (F.sum(F.col("calls") + F.col("n")) + first).cast("bigint").alias("calls_full"), F.sum(F.col("calls") - 1 - 2 * F.col("n")).alias("calls_reference"))
    p2 = F.max(F.when(F.col("policy") == "P2", F.col("calls"))).over(Window.partitionBy("seed"))
    return rows.withColumn("ratio_to_p2", F.round(F.col("calls") / p2, 9))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}, '{e}')" for n, c in ABLATIONS for t, e in dense(c)) + ") AS v(schedule, t, env)")
def schedule_dense(spark, d):
    return schedules(spark, ABLATIONS).select("schedule", "t", "env")


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}, '{e}')" for n, c in ABLATIONS for t, e in dense(c)) + ") AS v(schedule, t, env)), l AS (SELECT *, lag(env) OVER (PARTITION BY schedule ORDER BY t) AS p FROM s) SELECT schedule, count(*) FILTER (p <> env) AS n_changes, min(t) FILTER (p <> env) AS first_change, string_agg(t || ':' || env, ', ' ORDER BY t) FILTER (p IS NULL OR p <> env) AS written FROM l GROUP BY 1")
def schedule_changes(spark, d):
    """Changes of each schedule, and its written form."""
    rows = schedules(spark, ABLATIONS).withColumn("p", F.lag("env").over(Window.partitionBy("schedule").orderBy("t")))
    moved = F.col("p") != F.col("env")
    written = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("p").isNull() | moved, F.struct("t", "env")))), lambda s: F.concat(s["t"].cast("string"), F.lit(":"), s["env"])), ", ")
    return rows.groupBy("schedule").agg(F.count_if(moved).alias("n_changes"), F.min(F.when(moved, F.col("t"))).alias("first_change"), written.alias("written"))


@query("WITH e AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{d}', '{x}')" for e, d, x in ENVS) + ") AS v(env, d, x)) SELECT a.env AS env_a, b.env AS env_b, concat_ws(',', CASE WHEN a.d <> b.d THEN 'decoding' END, CASE WHEN a.x <> b.x THEN 'extractor' END) AS changed FROM e a CROSS JOIN e b")
def env_diff(spark, d):
    """Components in which two environments differ."""
    e = environments(spark)
    a, b = e.select(*[F.col(c).alias(f"{c}_a") for c in e.columns]), e.select(*[F.col(c).alias(f"{c}_b") for c in e.columns])
    changed = F.concat_ws(",", *[F.when(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(c)) for c in ("decoding", "extractor")])
    return a.crossJoin(F.broadcast(b)).select("env_a", "env_b", changed.alias("changed"))


@query(duck(f"WITH {SCORES} SELECT seed, t, advanced, inc_slot FROM tr"))
def incumbent_chain(spark, d):
    from ledgerloom.plans.matrix import trajectory

    return trajectory(spark, d).select("seed", "t", "advanced", "inc_slot")
