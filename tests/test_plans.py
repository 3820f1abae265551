import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.merge import conflicts, first_per_key, insert_ignore, insert_replace, sequence_gaps, upsert_if_changed
from ledgerloom.operators.skew import join_small, salted_join
from ledgerloom.plans import load, policies, protocol
from ledgerloom.plans.matrix import packed
from ledgerloom.plans.policies import ABLATIONS, POLICIES, replay
from ledgerloom.registry import ORACLES, QUERIES
from ledgerloom.sources.snapshots import SnapshotError, manifest, read_snapshot

load()
D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, s int")
    new = spark.createDataFrame([(2, "c", 2), (3, "e", 3), (3, "d", 3), (None, "x", 9)], "k int, v string, s int")
    assert rows(insert_ignore(old, new, ["k"], [F.col("v")])) == [(1, "a", 1), (2, "b", 1), (3, "d", 3)]
    assert rows(insert_replace(old, new.where("k = 2"), ["k"], "s")) == [(1, "a", 1), (2, "c", 2)]
    assert rows(upsert_if_changed(old, new.where("k = 2").withColumn("s", F.lit(1)), ["k"], "s").select("k", "v", "s")) == [(1, "a", 1), (2, "b", 1)]
    assert rows(conflicts(old.unionByName(new), ["k"], "v").where("k IS NOT NULL")) == [(2, 2), (3, 2)]
    assert first_per_key(new, ["k"], [F.col("v")]).count() == 2
    empty = old.limit(0)
    assert insert_ignore(empty, empty, ["k"], [F.col("v")]).count() == 0


def test_gaps_cross_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 5, 9, 10, 31, None, 31)], "v long")
    assert rows(sequence_gaps(df, "v", 1, bucket=4)) == [(10, 31, 20), (2, 5, 2), (5, 9, 3)]


def test_salted_join_keeps_all(spark):
    left = spark.range(2000).select(F.when(F.col("id") < 1500, F.lit("hot")).when(F.col("id") < 1600, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("1700", 3), ("none", 4)], "k string, v int")
    plain = rows(left.join(right, "k", "left").select("k", "id", "v"))
    assert rows(salted_join(left, right, "k", F.col("id")).select("k", "id", "v")) == plain
    assert rows(join_small(left, right, "k", F.col("id"), most=1).select("k", "id", "v")) == plain
    assert rows(join_small(left, right, "k", F.col("id")).select("k", "id", "v")) == plain


def test_snapshot(spark, tmp_path):
    import hashlib
    import json

    body = b'{"a":1}\n{"a":2}\n'
    (tmp_path / "x.jsonl").write_bytes(body)
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"name": "x.jsonl", "rows": 2, "sha256": hashlib.sha256(body).hexdigest()}]}))
    pins = manifest(spark, str(tmp_path / "m.json"))
    schema = spark.createDataFrame([], "a int").schema
    assert read_snapshot(spark, str(tmp_path), "x.jsonl", schema, pins).count() == 2
    with pytest.raises(SnapshotError):
        read_snapshot(spark, str(tmp_path), "x.jsonl", schema, {"x.jsonl": {"rows": 3, "sha256": pins["x.jsonl"]["sha256"]}})


def greedy_cells(spark, correct, n, rounds):
    """Cells of slots with given sets of correct items, the same in every round, decoding and extractor."""
    data = [(0, d, k, kind, r, i, False, 0, -1, int(i in correct[k]), int(i in correct[k])) for d in ("greedy", "t02") for k in range(rounds + 1) for kind, rs in (("round", range(k, rounds + 1)), ("gt", [0])) for r in rs for i in range(n)]
    return packed(spark.createDataFrame(data, "seed int, decoding string, slot int, draw_kind string, draw int, item int, physical boolean, truncated int, generation int, v1 int, v2 int"))


def test_frozen_policy_false_accept(spark, monkeypatch):
    """A frozen baseline accepts a candidate that is worse than the incumbent; refreshed ones don't."""
    cells = greedy_cells(spark, [{0, 1}, set(range(6)), set(range(4)), set(range(7))], 10, 3)
    only = tuple(p for p in POLICIES if p[0] in ("P1", "P1b", "P2", "ORACLE", "FIXEDAGE_k1"))
    monkeypatch.setattr(policies, "R", 3)
    log = replay(spark, cells, (("s", ((0, "E1"),)),), only).collect()
    got = {p[0]: [r.accepted for r in sorted((x for x in log if x.policy == p[0]), key=lambda x: x.t)] for p in only}
    assert got["P1"][:3] == [True, True, True] and got["P1b"][:3] == got["P2"][:3] == got["ORACLE"][:3] == [True, False, True]
    wrong = {p[0]: sum(r.false_accept for r in log if r.policy == p[0]) for p in only}
    assert wrong["P1"] == 1 and wrong["P1b"] == wrong["P2"] == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    df = QUERIES[name](spark, D)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_inflation_splits(spark):
    off = QUERIES["all_pairs_incumbent"](spark, D).where(F.abs(F.col("inflation") - F.col("infl_extract") - F.col("infl_generation")) > 1e-8)
    assert off.count() == 0
    assert set(ORACLES) <= set(QUERIES)
    assert len(ABLATIONS) == 4


def test_replicates_and_schedules_are_those_of_the_plan(spark):
    from ledgerloom.plans import policies, protocol

    assert protocol.REPLICATES == 2000 and len(policies.RANDOM) == 200
    assert {r["n_schedules"] for r in policies.schedule_randomization(spark, "/root/testdata/sf0.001").collect()} == {200}


def test_prompt_with_a_gold_is_no_clean_prompt(spark, tmp_path):
    from ledgerloom.plans.texts import prompt_violations

    say = "Solve the problem step by step, check the result twice and write the answer in \\boxed{} at the end. "
    prompts = [("a", say * 2 + "The answer is 1,234."), ("b", say * 2 + "There are 1234567 ways."), ("c", say * 2 + "Use 12.")]
    spark.createDataFrame(prompts, "prompt_hash string, text string").write.parquet(f"{tmp_path}/prompts.parquet")
    spark.createDataFrame([("test", 0, "q", "1234", "a"), ("test", 1, "q", "12", "a")], "split string, idx int, question string, gold string, answer_text string").write.parquet(f"{tmp_path}/items.parquet")
    assert rows(prompt_violations(spark, str(tmp_path))) == [("a", "leaks_gold"), ("b", ""), ("c", "")]


def policy_log(spark, monkeypatch, correct, n, rounds, schedule, names):
    monkeypatch.setattr(policies, "R", rounds)
    cells = greedy_cells(spark, correct, n, rounds)
    return cells, replay(spark, cells, (("s", schedule),), tuple(p for p in POLICIES if p[0] in names)).cache()


def test_policy_costs_are_those_of_the_plan(spark, monkeypatch):
    """Eleven rounds, 200 items, changes at rounds 4 and 8; no candidate ever wins."""
    _, log = policy_log(spark, monkeypatch, [set(range(50))] * 12, 200, 11, protocol.SCHEDULE, ("P1", "P1b", "P2", "P3", "P5", "ORACLE", "FIXEDAGE_k1"))
    calls = {r.policy: r for r in policies.calls_by_purpose(log, protocol.convention("teammate_v1")).collect()}
    assert {p: r.calls for p, r in calls.items()} == {"P1": 4411, "P1b": 4411, "P2": 6611, "P3": 4811, "P5": 4611, "ORACLE": 6611, "FIXEDAGE_k1": 4411 + 2000}
    refreshes = {r.policy: (r.a, r.b) for r in log.groupBy("policy").agg(F.count_if(F.col("refresh").isin("refresh", "fixed_age")).alias("a"), F.count_if(F.col("refresh") == "rescore").alias("b")).collect()}
    assert refreshes == {"P1": (0, 0), "P1b": (0, 0), "P2": (11, 0), "P3": (2, 0), "P5": (1, 1), "ORACLE": (0, 0), "FIXEDAGE_k1": (10, 0)}
    full = {r.policy: r for r in policies.calls_by_purpose(log, protocol.convention("full"), attempts=F.lit(2)).collect()}
    assert full["P1"].calls == 4411 + 11 + 2200 + 200 and full["ORACLE"].reference_init == 0 and full["P2"].proposer == 22


def test_lives_of_references(spark, monkeypatch):
    _, log = policy_log(spark, monkeypatch, [{0, 1}, {0, 1, 2}, {0, 1}, {0, 1, 2, 3}], 10, 3, ((0, "E1"), (2, "E3")), ("P1", "P1b", "P5"))
    adopts = {p[0]: p[2] for p in POLICIES}
    rows = log.withColumn("adopts", F.element_at(F.create_map(*[F.lit(x) for kv in adopts.items() for x in kv]), F.col("policy"))).withColumn("first_env", F.lit("E1"))
    got = {}
    for r in policies.references(rows).orderBy("policy", "ref_no").collect():
        got.setdefault(r.policy, []).append((r.source, r.slot, r.created_round, r.rescored_round, r.parent, r.retired_round))
    assert got["P1"] == [("initial", 0, 0, None, None, None)]
    assert got["P1b"] == [("initial", 0, 0, None, None, 1), ("adopt", 1, 1, None, None, 3), ("adopt", 3, 3, None, None, None)]
    assert got["P5"] == [("initial", 0, 0, None, None, 1), ("adopt", 1, 1, None, None, 2), ("rescore", 1, 1, 2, 1, 3), ("adopt", 3, 3, None, None, None)]


def test_final_accuracy_is_that_of_the_last_incumbent(spark, monkeypatch):
    cells, log = policy_log(spark, monkeypatch, [{0}, {0, 1, 2}, {0}, {0, 1}], 10, 3, ((0, "E1"), (2, "E4")), ("P1", "P2"))
    got = {r.policy: (r.final_inc, r.acc_canonical, r.acc_final) for r in policies.finals(log, cells).collect()}
    assert got == {"P1": (3, 0.2, 0.2), "P2": (1, 0.3, 0.3)}


def test_missing_cells_are_skipped_or_raise(spark):
    from ledgerloom.plans.matrix import scores
    from ledgerloom.plans.pairs import MissingCell, all_pairs, skipped_pairs

    rows = scores(spark, D).where("seed = 0")
    holed = rows.where("NOT (decoding = 't02' AND slot = 0 AND draw = 3 AND draw_kind = 'round' AND item % 2 = 0)")
    whole = all_pairs(spark, D, rows=rows).count()
    lost = skipped_pairs(spark, D, holed).where("seed = 0").collect()
    assert lost and {r.j for r in lost} == {3} and {r.env for r in lost} == {"E2", "E4"} and all(r.reason.startswith("missing cell") for r in lost)
    assert all_pairs(spark, D, rows=holed).count() == whole - len(lost)
    with pytest.raises(MissingCell):
        all_pairs(spark, D, rows=holed, on_missing="raise")


def test_difference_interval_shares_its_indices(spark):
    from ledgerloom.plans.inference import bootstrap, bootstrap_difference, bootstrap_statistic

    means = spark.createDataFrame([(e, i, float(i % 7) + s) for e, s in (("E1", 0.0), ("E2", 0.0), ("E3", 1.0)) for i in range(40)], "env string, item int, x double")
    got = {r.env: (r.point, r.lo, r.hi) for r in bootstrap_difference(means, 50, "env", "E1").collect()}
    assert got == {"E2": (0.0, 0.0, 0.0), "E3": (1.0, 1.0, 1.0)}  # equal groups: no width at all
    one = {r.env: r for r in bootstrap(means, 50, "env").collect()}
    assert one["E1"].lo <= one["E1"].point <= one["E1"].hi and bootstrap(means, 0, "env").where("lo IS NOT NULL").count() == 0
    any_stat = {r.env: (r.lo, r.hi) for r in bootstrap_statistic(means, 20, lambda x: x.mean(), "env").collect()}
    same = {r.env: (r.lo, r.hi) for r in bootstrap(means, 20, "env").collect()}
    assert all(abs(a - b) < 1e-6 for e in same for a, b in zip(any_stat[e], same[e]))


def test_batches_run_across_length_buckets(spark, tmp_path):
    from ledgerloom.plans.store import batch_plan

    rows = [(f"{i:064x}", '{"id": "greedy"}' if i % 3 else '{"id": "t02"}', (i * 7) % 90) for i in range(100)]
    spark.createDataFrame(rows, "gen_key string, decoding_json string, n_prompt_tokens int").write.parquet(f"{tmp_path}/generations.parquet")
    got = {r.gen_key: (r.decoding_id, r.batch) for r in batch_plan(spark, str(tmp_path)).collect()}
    for decoding in ("greedy", "t02"):
        order = sorted((r for r in rows if got[r[0]][0] == decoding), key=lambda r: (-(r[2] // 16), r[0]))
        assert [got[r[0]][1] for r in order] == [i // 32 for i in range(len(order))]


def test_cluster_needs_a_shared_folder():
    from ledgerloom.lineage import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
