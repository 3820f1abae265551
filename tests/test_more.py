import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import extractors
from ledgerloom.functions.environments import Decoding, Environment, differing, from_config
from ledgerloom.functions.prompting import affirmed, fallback, numbered_blocks, quality, sample_exactly, sampled
from ledgerloom.plans import planner, protocol
from ledgerloom.sources import provenance
from ledgerloom.sources.snapshots import SnapshotError, item_violations, load_items, manifest
from ledgerloom.streaming.ingest import InjectedFailure, merged, run_for, start


def test_environments():
    greedy, sampled_ = Decoding(0.0), Decoding(0.2)
    a, b = Environment("E1", greedy, "v1"), Environment("E4", sampled_, "v2")
    assert differing(a, a) == [] and differing(a, b) == ["decoding", "extractor"]
    assert a.fingerprint() != b.fingerprint() == Environment("other name", sampled_, "v2").fingerprint() and len(a.fingerprint()) == 16
    assert differing(a, Environment("E1", greedy, "v1", engine="x"), {"v1": "v1@1"}) == ["engine"] and a.fingerprint({"v1": "v1@1"}) != a.fingerprint()
    assert greedy.greedy and set(from_config(planner.FULL)) == {"E1", "E2", "E3", "E4"}
    for bad in ({"environments": {"E1": {"decoding": "none", "extractor": "v1"}}}, {"trajectory": {"env": "E9"}}):
        with pytest.raises(ValueError):
            from_config({**planner.FULL, **bad})


def test_extractor_registry(spark):
    df = spark.createDataFrame([("\\boxed{1,234}",)], "t string")
    assert df.select(extractors.extract("v1", F.col("t")).alias("a"), extractors.extract("v2", F.col("t")).alias("b")).first() == (None, "1234")
    pins = {name: extractors.source_hash(name) for name in extractors.names()}
    assert extractors.changed(pins) == {} and extractors.changed({**pins, "v1": "x", "v9": "y"}) == {"v1": ("x", pins["v1"]), "v9": ("y", None)}
    extractors.register("length", lambda text: F.length(text).cast("string"))
    assert df.select(extractors.extract("length", F.col("t")).alias("a")).first().a == "13" and extractors.tag("length").startswith("length@")
    with pytest.raises(ValueError):
        extractors.register("v1", F.upper)
    with pytest.raises(KeyError):
        extractors.extract("v9", F.col("t"))


def test_requests_and_estimates(spark):
    total = {r.config: (r.logical, r.executed) for r in planner.counted(spark, planner._CONFIGS).groupBy("config").agg(F.sum("logical").alias("logical"), F.sum("executed").alias("executed")).collect()}
    assert total == {"full": (109643, 86643), "lean": (108443, 28443), "smoke": (2027, 1787)}
    none = planner.with_parts(planner.FULL, matrix={"physical_greedy_reruns": "none"})
    more = planner.with_parts(planner.FULL, matrix={"gt_draws": 2})
    count = lambda c: sum(round(r[4] + 0.4999) for r in planner.request_rows(c))
    assert count(none) == 69243 and count(more) == 86643 + 7200 and planner.rerun_pairs(11, [0, 1, 3, 5, 10, 12, 3]) == 11 + 9 + 7 + 2
    low, high = planner.hours(86643, (1000, 2000))
    assert (round(low, 1), round(high, 1)) == (3.6, 7.2) and planner.format_hours(0.5, 7.25) == "30 min – 7.2 h"
    assert planner.hours(100, (1, 2), measured=(100.0, 360.0)) == (100 * 360 / 125 / 3600, 100 * 360 / 80 / 3600)
    with pytest.raises(ValueError):
        planner.hours(1, (1, 1), measured=(0.0, None))
    assert [planner.card(c) for c in ("T4", "NVIDIA A100-80GB", "tesla_t4", "l4")] == ["T4", "A100", "T4", "L4"] and planner.stack("auto") == "vllm" and planner.stack("OpenAI-compat") == "openai_compat"
    for bad in (planner.card, planner.stack):
        with pytest.raises(ValueError):
            bad("abacus")
    assert len(planner.warnings("hf", "T4", 13, 20, planner.FULL)) == 2 and planner.warnings("vllm", "T4", 3, 7, planner.FULL) == [] and len(planner.warnings("mock", "CPU", 1, 2, planner.LEAN)) == 1
    assert planner.planned(spark, reruns="all").where("physical").count() == planner.planned(spark).count()
    assert planner.planned(spark, reruns="none", mode="lean").where("physical AND draw_kind = 'round'").count() == 3 * 12 * 2
    assert planner.used_decodings(planner.FULL) == (["greedy"], ["t02"])


def test_plan_constants():
    assert [(a.name, a.schedule, a.fixed_age) for a in protocol.ABLATIONS] == [("A1", ((0, "E1"), (4, "E2"), (8, "E4")), None), ("A2", ((0, "E1"), (8, "E3")), None), ("A3", ((0, "E1"), (4, "E2")), None), ("A4", ((0, "E1"), (4, "E2"), (8, "E4")), 1)]
    assert (protocol.RULE, protocol.MARGIN, protocol.TAU, protocol.ALPHA, protocol.REPLICATES, protocol.N_SCHEDULES) == ("net_win", 0.0, 0.05, 0.10, 2000, 200)
    assert protocol.convention(None).name == "teammate_v1" and protocol.convention("full").initial
    with pytest.raises(ValueError):
        protocol.convention("other")


def test_proposer_texts(spark):
    rows = [("r", i, f"q{i}", f"a{i}", str(i)) for i in range(40)] + [("s", 7, "q7", "a7", "7")]
    df = spark.createDataFrame(rows, "run string, idx int, question string, response string, gold string")
    some = sampled(df, ["run"], F.col("idx"), 5, F.lit(0))
    got = {(r.run, r.idx) for r in some.collect()}
    assert len(got) == 6 and ("s", 7) in got and got == {(r.run, r.idx) for r in sampled(df.repartition(7), ["run"], F.col("idx"), 5, F.lit(0)).collect()}
    assert sampled(df, ["run"], F.col("idx"), 0).count() == 0
    blocks = {r.run: r for r in numbered_blocks(some, ["run"], [F.col("idx")], "{i}. {question} -> {response} ({gold})").collect()}
    assert blocks["s"].blocks == "1. q7 -> a7 (7)" and blocks["s"].golds == ["7"] and blocks["r"].n_errors == 5 and blocks["r"].blocks.count("\n\n") == 4
    assert sample_exactly([3, 1, 2], 5, 1) == [1, 2, 3] and len(sample_exactly(list(range(9)), 3, 1)) == 3 == len(set(sample_exactly(list(range(9)), 3, 2)))
    assert fallback("Do it.", ["Check it.", "Do it."], 2, ["do it. check it"], 1) == "Do it.\n(Revision 2.)"
    assert fallback("Do it.", ["Check it."], 2, [], 1) == "Do it.\nCheck it."
    q = spark.createDataFrame([("Think step by step, then double-check the result.",), ("Do not answer briefly: verify it.",), ("Never show your work.",), ("",)], "t string")
    got = [tuple(r) for r in q.select(affirmed(F.col("t"), r"step[- ]by[- ]step|show your work").alias("s"), F.round(quality(F.col("t")), 2).alias("q")).collect()]
    assert got == [(True, 0.6), (False, 0.25), (False, 0.0), (False, 0.0)]


def test_items_from_snapshot_or_hub(spark, tmp_path):
    import hashlib

    body = "".join(json.dumps({"idx": i, "question": f"q{i}", "answer_text": f"so #### {i}", "gold": str(i)}) + "\n" for i in range(4)).encode()
    (tmp_path / "test.jsonl").write_bytes(body)
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"name": "test.jsonl", "rows": 4, "sha256": hashlib.sha256(body).hexdigest()}]}))
    pins = manifest(spark, str(tmp_path / "m.json"))
    schema = spark.createDataFrame([], "idx int, question string, answer_text string, gold string").schema
    spark.createDataFrame([(f"h{i}", "so #### 1", i) for i in range(6)], "question string, answer string, other int").coalesce(1).write.parquet(str(tmp_path / "hub"))
    source = (str(tmp_path), "test.jsonl", schema, pins)
    items = load_items(spark, "test", 3, source, None)
    assert [r.question for r in items.collect()] == ["q0", "q1", "q2"] and item_violations(items, "test").count() == 0
    assert [r.question for r in load_items(spark, "test", 5, source, str(tmp_path / "hub")).orderBy("idx").collect()] == [f"h{i}" for i in range(5)]
    for first, hub in ((9, str(tmp_path / "hub")), (5, None)):
        with pytest.raises(SnapshotError):
            load_items(spark, "test", first, source, hub)
    bad = items.withColumn("gold", F.when(F.col("idx") == 1, "9").otherwise(F.col("gold"))).withColumn("split", F.when(F.col("idx") == 0, "train").otherwise(F.col("split")))
    assert sorted(map(tuple, item_violations(bad, "test").collect())) == [(0, "split"), (1, "gold")]


def test_provenance(spark):
    a, b = provenance.record(spark, {"x": 1}), provenance.record(spark, {"x": 1})
    b["created_at"], b["git"] = "later", {**b["git"], "dirty": True}
    assert provenance.digest(a) == provenance.digest(b) != provenance.digest(provenance.record(spark, {"x": 2})) and len(provenance.digest(a)) == 16


def test_stream_resumes_after_a_failure(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).repartition(8).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    args = (str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception, match=InjectedFailure.__name__):
        start(spark, *args, files_per_batch=2, fail_after=1).awaitTermination()
    assert 0 < merged(spark, str(tmp_path / "out"), ["k"]).count() < 40
    assert run_for(start(spark, *args, files_per_batch=2), 120)
    assert sorted(tuple(r) for r in merged(spark, str(tmp_path / "out"), ["k"]).collect()) == [(i, 2 * i) for i in range(40)]
