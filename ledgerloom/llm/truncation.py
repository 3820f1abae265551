"""Text cut off by field limits.

Per source and measure (characters, bytes, tokens) a log-normal length
distribution is fitted by maximum likelihood, with the values at *candidate
limits* right-censored: a value there is either exact or only known to be at least
so long.  Candidates are the token limit that a row's decoding names, and lengths
that more values have than their neighbourhood and the fit allow.  How the values
end plays no part in this.  A value at a limit c has the censoring posterior

    w S(c) / (w S(c) + f(c)),

where f and S are the fitted density and survival at c and w is the maximum
likelihood share of long values that met the limit.

How a value ends (``endings``) and what its finish reason says are the other
evidence.  Each kind of end has a log-likelihood ratio (``endings.KINDS``).  How
far each level of the posterior is to be believed, the share of values lost in
transfer, and what each finish reason is worth, are estimated by EM from counts
over all rows, over the classes cut at a stated token limit, cut at a found limit,
lost in transfer, and complete.  A value is cut if its log-odds,

    log posterior odds of its length + log ratio of its end + log ratio of its finish reason,

are positive.  Nothing is clipped.  An end that is a cut or none by what the
words mean is rated beyond the reach of a length; a result told twice whose
last stop is missing, or a clause that goes on from a mark, is for the length to
decide.

Only histograms reach the fits: at most one row for each distinct length of a
source, and one for each kind, finish reason and whole percentage of posterior.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.llm.endings import KINDS
from ledgerloom.operators.skew import join_small

MEASURES = ("n_chars", "n_bytes", "n_tokens")
#: A candidate limit has at least so many values, so many times its neighbourhood, and so many standard deviations more.
LEAST_AT_LIMIT, TIMES, DEVIATIONS = 8, 1.8, 4.0
#: The share of values taken as cut beforehand where no limit is near.
LOST = 0.03
#: Rows that the priors of a level and of a class of finish reasons are worth.
PRIOR_ROWS = 20.0
# Finish reasons that tell of a limit, of a stop and of a filter.
FINISH = {"length": "limit", "max_tokens": "limit", "max_length": "limit", "stop": "stop", "eos": "stop", "end_turn": "stop", "content_filter": "filter"}
#: Prior shares of the finish reasons of values cut at a stated limit; they are often wrong.
FINISH_PRIOR = {"limit": 0.6, "stop": 0.2, "filter": 0.05, "none": 0.15}


def limit_of(decoding: Column) -> Column:
    """The token limit that a decoding description names, if any."""
    return F.try_to_number(F.get_json_object(decoding, "$.max_new_tokens"), F.lit("999999999")).cast("int")


def _upper_tail(z: np.ndarray) -> np.ndarray:
    return np.maximum(0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in z]), 1e-300)


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def censored_lognormal(length: np.ndarray, exact: np.ndarray, censored: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(mu, sigma) of log-length by EM, given how many values of each length are exact and how many censored."""
    x, n = np.log(np.maximum(length, 1.0)), exact.sum() + censored.sum()
    weight = exact if exact.sum() > 0 else censored
    mu = float((weight * x).sum() / weight.sum())
    sigma = math.sqrt(max(float((weight * (x - mu) ** 2).sum() / weight.sum()), 1e-4))
    for _ in range(rounds):
        z = (x - mu) / sigma
        hazard = np.where(z > 30, z, _density(z) / _upper_tail(z))
        first = mu + sigma * hazard
        second = mu * mu + sigma * sigma + sigma * hazard * (x + mu)
        m1 = float((exact * x + censored * first).sum() / n)
        m2 = float((exact * x * x + censored * second).sum() / n)
        new = math.sqrt(max(m2 - m1 * m1, 1e-4))
        done = abs(m1 - mu) < 1e-5 and abs(new - sigma) < 1e-5
        mu, sigma = m1, new
        if done:
            break
    return mu, sigma


def neighbours(length: np.ndarray, n: np.ndarray, reach: int = 8) -> np.ndarray:
    """The mean number of values of the ``reach`` lengths below or above each of the distinct, sorted lengths, whichever is higher."""
    lo, hi = np.searchsorted(length, length - reach), np.searchsorted(length, length + reach, "right")
    total = np.concatenate(([0.0], np.cumsum(n)))
    at = np.arange(len(length))
    return np.maximum(total[at] - total[lo], total[hi] - total[at + 1]) / reach


def candidate_limits(length: np.ndarray, n: np.ndarray, around: np.ndarray) -> np.ndarray:
    return (n >= LEAST_AT_LIMIT) & (n >= TIMES * around) & (n > around + DEVIATIONS * np.sqrt(around + 1.0)) & (length > 0)


def fit_source(lengths: pd.DataFrame) -> dict:
    """The fit of one source and measure from columns length, token_limit (null but for tokens) and n: mu, sigma, and the posterior at each limit.

    Limits are [length, token limit or null, posterior].
    """
    own = lengths["token_limit"].to_numpy(dtype=float) if "token_limit" in lengths else np.full(len(lengths), np.nan)
    value, count = lengths["length"].to_numpy(dtype=float), lengths["n"].to_numpy(dtype=float)
    met = ~np.isnan(own) & (value >= own) & (own > 0)
    value = np.where(met, own, value)  # token counts are approximate and may pass their limit
    length, at = np.unique(value, return_inverse=True)
    n = np.bincount(at, weights=count * ~met)
    around = neighbours(length, n)
    spikes = candidate_limits(length, n, around)
    local = {float(c): float(e) for c, e in zip(length[spikes], around[spikes])}
    limits = {float(c): (float(k), float(count.sum())) for c, k in zip(length[spikes], n[spikes])}
    stated = {float(c): (float(count[met & (own == c)].sum()), float(count[own == c].sum())) for c in np.unique(own[met])}
    posterior: dict[tuple[float, bool], float] = {**{(c, False): 0.5 for c in limits}, **{(c, True): 0.5 for c in stated}}
    mu = sigma = 0.0
    for _ in range(8):
        exact, censored = n.copy(), np.zeros(len(length))
        for (c, named), p in posterior.items():
            i, k = int(np.searchsorted(length, c)), (stated if named else limits)[c][0]
            exact[i] += ((1.0 - p) if named else -p) * k  # values at a stated limit aren't among n
            censored[i] += p * k
        mu, sigma = censored_lognormal(length, np.maximum(exact, 0.0), censored)
        before = dict(posterior)
        for c, named in posterior:
            k, total = (stated if named else limits)[c]
            z = np.array([(math.log(max(c, 1.0)) - mu) / sigma])
            f, s = float(_density(z)[0]) / (sigma * max(c, 1.0)), float(_upper_tail(z)[0])
            f = max(f, 0.0 if named else local[c] / total)  # where the fit lies too low a length is no limit for that
            w = min(max((k / total - f) / s, 0.0), 1.0)
            posterior[c, named] = min(max(w * s / max(w * s + f, 1e-300), 1e-6), 1.0 - 1e-6)
        if all(abs(posterior[k] - before[k]) < 1e-6 for k in posterior):
            break
    return {"mu": mu, "sigma": sigma, "limits": [[c, c if named else None, p] for (c, named), p in sorted(posterior.items())]}


def length_models(evidence: DataFrame) -> DataFrame:
    """(source, measure, mu, sigma, n, limits as JSON) from rows with source, state, kind, token_limit and the measures."""
    entry = lambda m: F.struct(F.lit(m).alias("measure"), F.col(m).cast("int").alias("length"), (F.col("token_limit") if m == "n_tokens" else F.lit(None)).cast("int").alias("token_limit"))
    prose = evidence.where("state IN ('told', 'untold') AND kind <> 'bare'")  # bare numbers, refusals and copies have other lengths
    long = prose.select("source", F.explode(F.array(*[entry(m) for m in MEASURES])).alias("e"))
    counts = long.select("source", "e.*").where("length > 0").groupBy("source", "measure", "length", "token_limit").agg(F.count(F.lit(1)).alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        got = fit_source(group)
        return pd.DataFrame([{"source": group["source"].iloc[0], "measure": group["measure"].iloc[0], "mu": got["mu"], "sigma": got["sigma"], "n": int(group["n"].sum()), "limits": json.dumps(got["limits"])}])

    return counts.groupBy("source", "measure").applyInPandas(fit, "source string, measure string, mu double, sigma double, n long, limits string")


def end_weights(counts: list[tuple[str, str, str, float, float]], rounds: int = 200) -> tuple[dict[tuple[str, str], float], dict[tuple[str, float], float]]:
    """(log ratio of each (finish, limit), share of cut values at each (limit, posterior)) by EM over the four classes.

    ``counts`` has (kind of end, class of finish reason, ``token`` or ``field`` or
    ``none``, posterior of the length, number of rows).  Each class has its own finish
    reasons; a ratio is that of a cut at the limit or in transfer to complete.
    """
    reasons = list(FINISH_PRIOR)
    rows = [c for c in counts if c[0] in KINDS and c[4] > 0]
    levels = sorted({(c[2], c[3]) for c in rows} | {("none", 0.0)})
    cut_ratio = np.exp([KINDS[c[0]] for c in rows])
    r = np.array([reasons.index(c[1]) for c in rows], int)
    v = np.array([levels.index((c[2], c[3])) for c in rows], int)
    n = np.array([c[4] for c in rows], float)
    own = np.array([{"token": 0, "field": 1}.get(t, -1) for t, _ in levels])
    reason_prior = PRIOR_ROWS * np.array([list(FINISH_PRIOR.values()) if c == 0 else [0.1, 0.7, 0.1, 0.1] for c in range(4)])
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    known = np.where(own >= 0, np.clip([p for _, p in levels], LOST, 1.0 - LOST), 0.0)
    pr, at, lost = share(reason_prior), known, LOST
    for _ in range(rounds if rows else 0):
        before = np.zeros((len(levels), 4))
        for c in (0, 1):
            before[own == c, c] = at[own == c]
        before[:, 2], before[:, 3] = (1.0 - at) * lost, (1.0 - at) * (1.0 - lost)
        z = before[v] * pr[:, r].T * np.stack([cut_ratio] * 3 + [np.ones(len(rows))], axis=1)
        z = z / z.sum(axis=1, keepdims=True) * n[:, None]
        old = at
        limited = np.bincount(v, z[:, 0] + z[:, 1], len(levels))
        at = np.where(own >= 0, (PRIOR_ROWS * known + limited) / (PRIOR_ROWS + np.bincount(v, n, len(levels))), 0.0)
        lost = float((z[:, 2].sum() + PRIOR_ROWS * LOST) / (z[:, 2].sum() + z[:, 3].sum() + PRIOR_ROWS))
        pr = share(reason_prior + np.stack([np.bincount(r, z[:, c], len(reasons)) for c in range(4)]))
        if np.abs(at - old).max() < 1e-7:
            break
    total = at + (1.0 - at) * lost
    told: dict[tuple[str, str], float] = {}
    for i, (limit, _) in enumerate(levels):
        of = np.array([at[i] if own[i] == c else 0.0 for c in (0, 1)] + [(1.0 - at[i]) * lost])
        for j, reason in enumerate(reasons):
            told.setdefault((reason, limit), math.log(float((of * pr[:3, j]).sum() / of.sum()) / float(pr[3, j])))
    return told, {level: float(x) for level, x in zip(levels, total)}


def with_verdict(evidence: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """``evidence`` (gen_key, source, state, kind, finish, the measures) with ``posterior`` of the length, ``end_ratio``, ``log_odds`` and ``is_cut``.

    ``evidence`` is read several times: cut its lineage first.  Rows with a null
    source form a source of their own; rows of the states ``empty``, ``refusal``
    and ``copy`` are no cuts.
    """
    models = cut(length_models(evidence)) if models is None else models
    # one map for each source and measure, read from the JSON once and not per row; a stated token limit has a key of its own
    key = lambda x: F.concat(x[0].cast("long").cast("string"), F.when(x[1].isNotNull(), F.lit("t")).otherwise(F.lit("")))
    places = F.map_from_entries(F.transform(F.from_json("limits", "array<array<double>>"), lambda x: F.struct(key(x).alias("k"), x[2].alias("v"))))
    wide = models.withColumn("m", places).groupBy("source").agg(*[F.first(F.when(F.col("measure") == m, F.col("m")), ignorenulls=True).alias(f"_{m}") for m in MEASURES])
    same = F.coalesce("source", F.lit("\0"))
    rows = join_small(evidence.withColumn("_source", same), wide.withColumn("_source", same).drop("source"), "_source", F.xxhash64("gen_key"))
    at = lambda m, key: F.coalesce(F.try_element_at(F.col(f"_{m}"), key), F.lit(0.0))
    stated = F.when(F.col("n_tokens") >= F.col("token_limit"), at("n_tokens", F.concat(F.col("token_limit").cast("string"), F.lit("t"))))
    fields = F.greatest(at("n_tokens", F.col("n_tokens").cast("string")), *[at(m, F.col(m).cast("string")) for m in MEASURES[:2]])
    stated = F.coalesce(stated, F.lit(0.0))
    reason = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FINISH.items() for x in kv]), F.lower("finish")), F.lit("none"))
    out = rows.withColumn("at_limit", F.round(F.greatest(stated, fields), 2)).withColumn("reason", reason)
    out = out.withColumn("limit", F.when(F.col("at_limit") <= 0, "none").when(stated >= fields, "token").otherwise("field")).drop("_source", *[f"_{m}" for m in MEASURES])
    out = out.withColumn("judged", F.col("state").isin("told", "untold"))
    counts = out.where("judged").groupBy("kind", "reason", "limit", "at_limit").agg(F.count(F.lit(1)).alias("n"))
    # at most kinds x reasons x 3 x 101 rows, whatever the input
    reasons, shares = end_weights([tuple(r) for r in counts.collect()])
    ratio = lambda table, column: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)
    joint = lambda table: {"/".join(map(str, key)): x for key, x in table.items()}
    out = out.withColumn("posterior", F.coalesce(ratio(joint(shares), F.concat_ws("/", "limit", F.col("at_limit").cast("string"))), F.lit(LOST)))
    out = out.withColumn("end_ratio", F.coalesce(ratio(KINDS, F.col("kind")), F.lit(0.0)) + F.coalesce(ratio(joint(reasons), F.concat_ws("/", "reason", "limit")), F.lit(0.0)))
    out = out.withColumn("log_odds", F.col("end_ratio") + F.log(F.col("posterior") / (1.0 - F.col("posterior"))))
    return out.withColumn("is_cut", F.col("judged") & (F.col("log_odds") > 0)).drop("judged", "reason")


def cut_rates(verdicts: DataFrame) -> DataFrame:
    """(model_id, n_generations, n_cut, n_at_limit, n_turned, cut_rate), one row per source.

    ``n_at_limit``: cut ones whose length alone speaks for a limit; ``n_turned``:
    values whose verdict the length posterior turned against their end.
    """
    rows = verdicts.groupBy(F.col("source").alias("model_id")).agg(
        F.count(F.lit(1)).alias("n_generations"),
        F.count_if("is_cut").alias("n_cut"),
        F.count_if(F.col("is_cut") & (F.col("at_limit") > 0.5)).alias("n_at_limit"),
        F.count_if(F.col("state").isin("told", "untold") & (F.col("is_cut") != (F.col("end_ratio") > 0))).alias("n_turned"),
    )
    return rows.withColumn("cut_rate", F.col("n_cut") / F.col("n_generations"))
