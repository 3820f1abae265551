"""Statistics over the scored log: intervals, paired tests, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import hash32, joined
from ledgerloom.functions.stats import accepts, mcnemar_table, mcnemar_tail, rate, spread, wilson
from ledgerloom.lineage import cut
from ledgerloom.plans.matrix import SCORES, duck, packed, scores as matrix_scores
from ledgerloom.plans.pairs import _Z, _pairs_sql, item_diffs
from ledgerloom.plans.policies import DEFAULT, POLICIES, _replay_sql, replay
from ledgerloom.plans.protocol import ALPHA, EQUIVALENCE_MARGIN_PP, REPLICATES, STORAGE_ENV, T4_AGE, TAU
from ledgerloom.plans.store import _SCORES, C, cells, scores
from ledgerloom.registry import query



@query(
    f"""WITH {_SCORES}, a AS (SELECT model_id, count(*) AS n, count(*) FILTER (correct) AS k, count(*) FILTER (correct) / count(*) AS p FROM s GROUP BY 1)
    SELECT model_id, n, k, round((p + {_Z * _Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n), 9) AS lo,
    round((p + {_Z * _Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n), 9) AS hi FROM a"""
)
def accuracy_intervals(spark, d):
    """Accuracy of each model with its Wilson interval."""
    rows = scores(spark, d).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("strict").alias("k"))
    return rows.select("model_id", "n", "k", F.round(wilson(F.col("k"), F.col("n"), False), 9).alias("lo"), F.round(wilson(F.col("k"), F.col("n"), True), 9).alias("hi"))


@query(
    f"""WITH {_SCORES}, c AS (SELECT DISTINCT seed, gen_key FROM {C}), a AS (SELECT s.model_id, c.seed, avg(CASE WHEN correct THEN 1.0 ELSE 0 END) AS acc FROM c JOIN s USING (gen_key) GROUP BY ALL)
    SELECT model_id, count(*) AS n_seeds, round(avg(acc), 9) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(acc) END, 9) AS sd FROM a GROUP BY 1"""
)
def accuracy_by_seed(spark, d):
    """Mean accuracy over seeds, each seed counting once."""
    c = cells(spark, d).select("seed", "gen_key").distinct()
    a = c.join(scores(spark, d).select("gen_key", "model_id", "strict"), "gen_key").groupBy("model_id", "seed").agg(F.avg(F.col("strict").cast("int")).alias("acc"))
    return a.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("acc"), 9).alias("mean"), F.round(spread(F.col("acc")), 9).alias("sd"))


_PAIRED = f"""WITH {_SCORES}, c AS (SELECT run_id, seed, split, slot, item_idx, decoding_id, min(gen_key) AS gen_key FROM {C} WHERE draw_kind = 'round' GROUP BY ALL),
    p AS (SELECT c1.run_id, x.correct AS a, y.correct AS b FROM c c1 JOIN c c2 USING (run_id, seed, split, slot, item_idx) JOIN s x ON x.gen_key = c1.gen_key JOIN s y ON y.gen_key = c2.gen_key WHERE c1.decoding_id = 'greedy' AND c2.decoding_id = 't02'),
    k AS (SELECT run_id, count(*) AS n, count(*) FILTER (a AND NOT b) AS wins, count(*) FILTER (b AND NOT a) AS losses, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither FROM p GROUP BY 1)"""


def paired(spark, d) -> DataFrame:
    """Per run: greedy against sampled decoding on the same prompt, item and seed."""
    on = ["run_id", "seed", "split", "slot", "item_idx"]
    c = cells(spark, d).where("draw_kind = 'round'").groupBy(*on, "decoding_id").agg(F.min("gen_key").alias("gen_key"))
    s = scores(spark, d).select("gen_key", "strict")
    both = c.join(s, "gen_key").groupBy(*on).agg(F.bool_or(F.when(F.col("decoding_id") == "greedy", F.col("strict"))).alias("a"), F.bool_or(F.when(F.col("decoding_id") == "t02", F.col("strict"))).alias("b"))
    known = both.where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return known.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(a & ~b).alias("wins"), F.count_if(b & ~a).alias("losses"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"))


@query(_PAIRED + f" SELECT *, (wins - losses) / n > 0 AS net_win, wins > losses AND wins / n >= {TAU} AS win_rate FROM k")
def paired_decisions(spark, d):
    rows = paired(spark, d)
    return rows.withColumn("net_win", accepts("net_win", F.col("wins"), F.col("losses"), F.col("n"))).withColumn("win_rate", accepts("win_rate", F.col("wins"), F.col("losses"), F.col("n")))


@query(
    _PAIRED
    + """, t AS (SELECT run_id, CASE WHEN wins + losses = 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma(m + 1.0) - lgamma(j + 1.0) - lgamma(m - j + 1.0) - m * ln(2.0))) FROM (SELECT wins + losses AS m, unnest(range(wins, wins + losses + 1)) AS j)) END AS tail FROM k)
    SELECT run_id, wins, losses, round(tail, 9) AS tail, wins > losses AND tail < """
    + str(ALPHA)
    + " AS accepted FROM k JOIN t USING (run_id)"
)
def mcnemar_decisions(spark, d):
    """The exact one-sided McNemar test of each run."""
    rows = paired(spark, d).withColumn("tail", mcnemar_tail(F.col("wins"), F.col("losses")))
    return rows.select("run_id", "wins", "losses", F.round("tail", 9).alias("tail"), accepts("mcnemar", F.col("wins"), F.col("losses"), F.col("n"), tail=F.col("tail")).alias("accepted"))


@query("SELECT n, k, round((SELECT sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) - n * ln(2.0))) FROM (SELECT unnest(range(k, n + 1)) AS j)), 9) AS tail FROM (SELECT n, unnest(range(0, n + 1)) AS k FROM range(1, 41) t(n))")
def mcnemar_tails(spark, d):
    return mcnemar_table(spark, 40).select("n", "k", F.round("tail", 9).alias("tail"))


def item_means(spark, d) -> DataFrame:
    """(env, item, x): the mean over seeds and pairs of stored minus rerun wins per item, the unit of resampling."""
    rows = matrix_scores(spark, d).where("draw_kind = 'round'")
    stored = rows.where("decoding = 'greedy' AND slot = 0 AND draw = 0").groupBy("seed", "item").agg(F.max("v1").alias("s"))
    late = rows.where("slot > 0 AND slot = draw").select("seed", "item", "slot", "decoding", "v1", "v2")
    base = rows.where("slot = 0 AND draw > 0").select("seed", "item", F.col("draw").alias("slot"), "decoding", F.col("v1").alias("r1"), F.col("v2").alias("r2"))
    met = late.join(base, ["seed", "item", "slot", "decoding"]).join(stored, ["seed", "item"])
    diff = lambda c, r: F.col(c) * (1 - F.col("s")) - F.col(c) * (1 - F.col(r))
    long = met.select("item", F.explode(F.array(F.struct(F.concat(F.lit("v1 "), "decoding").alias("env"), diff("v1", "r1").alias("x")), F.struct(F.concat(F.lit("v2 "), "decoding").alias("env"), diff("v2", "r2").alias("x")))).alias("e"))
    return long.groupBy("e.env", "item").agg(F.avg("e.x").alias("x"))


ITEMS_A_BUCKET = 10_000


def numbered(items: DataFrame) -> DataFrame:
    """(item, pos): items numbered from 0 in their order, by buckets, so that no task holds all of them."""
    rows = items.select("item").distinct().withColumn("bucket", F.floor(F.col("item") / ITEMS_A_BUCKET))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    starts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("item")) - 1
    return rows.withColumn("rank", rank).join(starts, "bucket").select("item", (F.col("start") + F.col("rank")).alias("pos"))


def replicate_means(means: DataFrame, replicates: int, *by: str) -> DataFrame:
    """(by, b, m): the mean of every group in every replicate, all groups resampled with the same indices.

    A replicate draws as many items as there are, by hash; only how often each item
    is drawn matters, so replicates are counted per item before they meet the
    values, and no replicate is gathered anywhere.
    """
    index = cut(numbered(means))
    n = index.agg(F.count(F.lit(1)).alias("n_items"))
    draws = index.crossJoin(F.broadcast(n)).select("n_items", F.col("pos").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))  # n is one row
    draws = draws.select("b", F.pmod(hash32(joined(F.lit("b"), F.col("b"), F.col("draw"))), F.col("n_items")).alias("pos")).groupBy("b", "pos").agg(F.count(F.lit(1)).alias("times"))
    weighted = draws.join(index, "pos").join(means, "item")
    return weighted.groupBy(*by, "b").agg((F.sum(F.col("times") * F.col("x")) / F.sum("times")).alias("m"))


def interval(values: DataFrame, *by: str, column: str = "m") -> DataFrame:
    """(by, lo, hi): the 95 % percentile interval, linearly interpolated."""
    ends = values.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return ends.select(*by, F.round(F.col("q")[0], 9).alias("lo"), F.round(F.col("q")[1], 9).alias("hi"))


def bootstrap(means: DataFrame, replicates: int, *by: str) -> DataFrame:
    """(by, point, lo, hi): percentile intervals of the mean over items."""
    point = means.groupBy(*by).agg(F.round(F.avg("x"), 9).alias("point"))
    if replicates < 1:
        return point.select("*", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    return point.join(interval(replicate_means(means, replicates, *by), *by), list(by))


def bootstrap_difference(means: DataFrame, replicates: int, by: str, control: str) -> DataFrame:
    """(by, point, lo, hi): the mean of every group less that of the control, with one index vector for both."""
    stats = cut(replicate_means(means, replicates, by))
    base = stats.where(F.col(by) == control).select("b", F.col("m").alias("c"))
    differ = stats.where(F.col(by) != control).join(base, "b").withColumn("m", F.col("m") - F.col("c"))
    points = means.groupBy(by).agg(F.avg("x").alias("p"))
    of = points.where(F.col(by) == control).select(F.col("p").alias("c"))
    point = points.where(F.col(by) != control).crossJoin(F.broadcast(of)).select(by, F.round(F.col("p") - F.col("c"), 9).alias("point"))  # one row
    return point.join(interval(differ, by), by)


def bootstrap_statistic(means: DataFrame, replicates: int, stat, *by: str) -> DataFrame:
    """(by, lo, hi) for any statistic: ``stat`` takes the values drawn, as an array, and gives a number.

    For statistics that the counts of draws don't determine; a replicate of one group
    is gathered in one task, so its size is that of the item set.
    """
    import pandas as pd

    index = cut(numbered(means))
    n = index.agg(F.count(F.lit(1)).alias("n_items"))
    draws = index.crossJoin(F.broadcast(n)).select("n_items", F.col("pos").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))  # one row
    draws = draws.select("b", F.pmod(hash32(joined(F.lit("b"), F.col("b"), F.col("draw"))), F.col("n_items")).alias("pos"))
    rows = draws.join(index, "pos").join(means, "item").select(*by, "b", "x")
    types = dict(means.dtypes)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{c: group[c].iloc[0] for c in by}, "m": float(stat(group["x"].to_numpy()))}])

    return interval(rows.groupBy(*by, "b").applyInPandas(one, ", ".join([*[f"{c} {types[c]}" for c in by], "m double"])), *by)


_MEANS = f"""WITH {SCORES}, rr AS (SELECT * FROM sc WHERE draw_kind = 'round'), st AS (SELECT seed, item, v1 AS s FROM rr WHERE decoding = 'greedy' AND slot = 0 AND draw = 0),
    mt AS (SELECT a.item, a.decoding, a.v1, a.v2, b.v1 AS r1, b.v2 AS r2, s FROM rr a JOIN rr b ON a.seed = b.seed AND a.item = b.item AND a.decoding = b.decoding AND b.slot = 0 AND b.draw = a.slot AND a.slot > 0 AND a.slot = a.draw JOIN st ON st.seed = a.seed AND st.item = a.item),
    m AS (SELECT 'v1 ' || decoding AS env, item, avg(v1 * (1 - s) - v1 * (1 - r1)) AS x FROM mt GROUP BY ALL UNION ALL SELECT 'v2 ' || decoding, item, avg(v2 * (1 - s) - v2 * (1 - r2)) FROM mt GROUP BY ALL),
    nu AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS pos, count(*) OVER () AS n FROM it),
    dr AS (SELECT b, H('b|' || b || '|' || pos) % n AS pos FROM nu CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS b)),
    bs AS (SELECT env, b, avg(x) AS mean FROM dr JOIN nu USING (pos) JOIN m USING (item) GROUP BY ALL)"""


@query(duck(_MEANS) + " SELECT env, round(max(p), 9) AS point, round(quantile_cont(mean, 0.025), 9) AS lo, round(quantile_cont(mean, 0.975), 9) AS hi FROM bs JOIN (SELECT env, avg(x) AS p FROM m GROUP BY 1) USING (env) GROUP BY env")
def bootstrap_inflation(spark, d):
    """Inflation of a stored round-0 baseline per environment, with percentile intervals over items."""
    return bootstrap(cut(item_means(spark, d)), REPLICATES, "env")


_DIFFS = duck(
    _pairs_sql()
    + f""", m AS (SELECT env, item, avg(cand * (1 - stored) - cand * (1 - rerun)) AS x FROM f WHERE j - i = {T4_AGE} GROUP BY 1, 2), nu AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS pos, count(*) OVER () AS n FROM it),
    dr AS (SELECT b, H('b|' || b || '|' || pos) % n AS pos FROM nu CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS b)), bs AS (SELECT env, b, avg(x) AS mean FROM dr JOIN nu USING (pos) JOIN m USING (item) GROUP BY 1, 2)"""
)


@query(_DIFFS + " SELECT env, round(max(p), 9) AS point, round(quantile_cont(mean, 0.025), 9) AS lo, round(quantile_cont(mean, 0.975), 9) AS hi FROM bs JOIN (SELECT env, avg(x) AS p FROM m GROUP BY 1) USING (env) GROUP BY env")
def inflation_intervals(spark, d):
    """Inflation at the registered age per environment with its interval over items."""
    return bootstrap(cut(item_diffs(spark, d, T4_AGE)), REPLICATES, "env")


@query(
    _DIFFS
    + """, df AS (SELECT a.env, a.mean - c.mean AS m FROM bs a JOIN bs c ON c.env = 'E1' AND c.b = a.b AND a.env <> 'E1'), pt AS (SELECT env, avg(x) AS p FROM m GROUP BY 1)
    SELECT df.env, round(max(pt.p - c.p), 9) AS point, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM df JOIN pt ON pt.env = df.env JOIN pt c ON c.env = 'E1' GROUP BY 1"""
)
def hypothesis_inflation(spark, d):
    """H1: inflation at the registered age under each changed environment less that of the unchanged one."""
    return bootstrap_difference(cut(item_diffs(spark, d, T4_AGE)), REPLICATES, "env", STORAGE_ENV)


@query(
    duck(_replay_sql(DEFAULT))
    + f""", fr AS (SELECT policy, count(*) FILTER (false_accept) / nullif(count(*) FILTER (accepted), 0) AS far, sum(CASE WHEN refresh IN ('refresh', 'fixed_age') THEN n ELSE 0 END) AS ref_calls FROM o GROUP BY 1),
    c AS (SELECT * FROM (VALUES ('H2', 'P1', 'P2'), ('H2', 'P1b', 'P2'), ('H3', 'P3', 'P2')) AS v(hypothesis, policy, control))
    SELECT hypothesis, c.policy, control, round((a.far - b.far) * 100, 6) AS far_difference_pp, CASE WHEN hypothesis = 'H3' THEN round(a.ref_calls / nullif(b.ref_calls, 0), 9) END AS reference_call_ratio,
    CASE WHEN hypothesis = 'H3' THEN abs(a.far - b.far) * 100 <= {EQUIVALENCE_MARGIN_PP} END AS within_margin FROM c JOIN fr a ON a.policy = c.policy JOIN fr b ON b.policy = control"""
)
def hypotheses_policies(spark, d):
    """H2: false-accept rates of the frozen policies less that of refreshing every round; H3: that of refreshing on change, its reference calls and the equivalence margin."""
    rows = replay(spark, packed(matrix_scores(spark, d)), DEFAULT, POLICIES)
    refreshed = F.when(F.col("refresh").isin("refresh", "fixed_age"), F.col("n")).otherwise(F.lit(0))
    far = rows.groupBy("policy").agg(rate(F.count_if("false_accept"), F.count_if("accepted")).alias("far"), F.sum(refreshed).cast("double").alias("calls"))
    wanted = spark.createDataFrame([("H2", "P1", "P2"), ("H2", "P1b", "P2"), ("H3", "P3", "P2")], "hypothesis string, policy string, control string")
    met = wanted.join(far, "policy").join(far.select(F.col("policy").alias("control"), F.col("far").alias("far_c"), F.col("calls").alias("calls_c")), "control")
    apart, third = (F.col("far") - F.col("far_c")) * 100, F.col("hypothesis") == "H3"
    return met.select("hypothesis", "policy", "control", F.round(apart, 6).alias("far_difference_pp"), F.when(third, F.round(F.try_divide("calls", "calls_c"), 9)).alias("reference_call_ratio"), F.when(third, F.abs(apart) <= EQUIVALENCE_MARGIN_PP).alias("within_margin"))
