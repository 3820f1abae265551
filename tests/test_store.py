import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.shards import ShardError, ShardGap, read_shard, replay, shards, write_shard
from ledgerloom.sources.store import CellConflict, ConfigMismatch, EngineMismatch, ItemConflict, SlotConflict, Store, StoreError

ITEMS = "split string, idx int, question string, answer_text string, gold string"
CELLS = "run_id string, seed int, split string, decoding_id string, slot int, draw_kind string, draw int, item_idx int, gen_key string, physical boolean"


def items(spark, *rows):
    return spark.createDataFrame([("test", i, q, f"a #### {g}", g) for i, q, g in rows], ITEMS)


def test_commits_are_whole_and_policies_hold(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    scores = lambda h, x: spark.createDataFrame([("g", "v1", "5", h, x)], "gen_key string, extractor string, gold string, ext_hash string, extracted string")
    store.write({"items": items(spark, (0, "q0", "1"), (1, "q1", "2"), (1, "q1", "2")), "scores": scores("h1", "a"), "meta": spark.createDataFrame([("k", "1")], "key string, value string")})
    store.write({"scores": scores("h1", "b"), "meta": spark.createDataFrame([("k", "2")], "key string, value string")})
    assert [r.extracted for r in store.read("scores").collect()] == ["a"] and [r.value for r in store.meta("k").collect()] == ["2"]
    store.write({"scores": scores("h2", "c")})
    again = Store(spark, str(tmp_path / "s"))
    assert [r.extracted for r in again.read("scores").collect()] == ["c"] and again.count("items") == 2 and again.check() == {}
    assert [r.idx for r in again.first("items", 1).collect()] == [0] and again.columns("meta") == ["key", "value"]
    keys = spark.createDataFrame([("test", 1), ("test", 9), ("test", 1)], "split string, idx int")
    assert [r.question for r in again.lookup("items", keys).collect()] == ["q1"] and again.existing("items", keys).count() == 1
    assert again.lookup("items", keys.select("split")).count() == 2
    assert again.sql("SELECT question FROM {items} WHERE idx = :i", i=0).first().question == "q0"
    assert again.read("items", {"idx": 1}).count() == 1 and again.read("cells").count() == 0


def test_guards(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write({"items": items(spark, (0, "q0", "1"))})
    store.write({"items": items(spark, (0, "q0", "1"))})
    with pytest.raises(ItemConflict):
        store.write({"items": items(spark, (0, "other", "1"))})
    slot = lambda h: spark.createDataFrame([("r", 0, 0, h, 0, None, "initial")], "run_id string, seed int, slot int, prompt_hash string, created_round int, parent_slot int, origin string")
    store.write({"slots": slot("a")})
    with pytest.raises(SlotConflict):
        store.write({"slots": slot("b")})
    cell = lambda g: spark.createDataFrame([("r", 0, "test", "greedy", 0, "round", 0, 0, g, False)], CELLS)
    store.write({"cells": cell("a")})
    with pytest.raises(CellConflict):
        store.write({"cells": cell("b")})
    for bad in ({"nothing": cell("a")}, {"meta": cell("a")}, {"meta": spark.createDataFrame([(None, "x")], "key string, value string")}):
        with pytest.raises(StoreError):
            store.write(bad)
    late = Store(spark, str(tmp_path))
    store.write({"meta": spark.createDataFrame([("k", "1")], "key string, value string")})
    with pytest.raises(StoreError):
        late.write({"meta": spark.createDataFrame([("k", "2")], "key string, value string")})
    assert Store(spark, str(tmp_path)).meta("k").first().value == "1"


def test_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.ensure_run("r", "c1", plan_hash="p1", provenance_json="{}", engine_fp="e1", synthetic=True)
    with pytest.raises(ConfigMismatch):
        store.ensure_run("r", "c2")
    with pytest.raises(EngineMismatch):
        store.ensure_run("r", "c1", engine_fp="e2")
    got = store.ensure_run("r", "c2", plan_hash="p2", provenance_json="{1}", engine_fp="e2", allow_config_change=True, allow_engine_change=True)
    assert (got["config_hash"], got["plan_hash"], got["provenance_json"], got["engine_fp"], got["synthetic"]) == ("c2", "p2", "{}", "e2", True)
    assert store.runs() == ["r"] and sorted(r.key.split(":")[0] for r in store.meta().collect()) == ["config_change", "engine_change", "plan_change"]
    copy = store.backup(str(tmp_path / "copy"))
    assert Store(spark, str(tmp_path / "copy")).runs() == copy.runs() == ["r"]


def test_shards(spark, tmp_path):
    folder = str(tmp_path / "log")
    for i in range(3):
        write_shard(spark, folder, "Matrix run!", {"items": items(spark, (i, f"q{i} ü", "1")), "prompts": spark.createDataFrame([(f"h{i}", "t")], "prompt_hash string, text string")})
    assert [n for n, _ in shards(spark, folder)] == [1, 2, 3]
    store = Store(spark, str(tmp_path / "s"))
    assert replay(store, folder) == 6 and replay(store, folder) == 0
    assert store.count("items") == 3 and store.count("shard_log") == 3 and store.read("items", {"idx": 2}).first().question == "q2 ü"
    (tmp_path / "log" / f"{shards(spark, folder)[1][1]}.done").unlink()
    other = Store(spark, str(tmp_path / "o"))
    with pytest.raises(ShardGap):
        replay(other, folder)
    assert other.count("items") == 1 and replay(other, folder, allow_gaps=True) == 2
    name = shards(spark, folder)[0][1]
    spark.createDataFrame([("{}",)], "value string").write.mode("append").text(f"{folder}/{name}")
    with pytest.raises(ShardError):
        read_shard(spark, folder, name).select(F.col("table")).count()
