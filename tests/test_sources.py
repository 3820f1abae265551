import pytest

from ledgerloom.plans.policies import POLICIES, R, random_schedules
from ledgerloom.sources.bundles import render, write_bundle
from ledgerloom.sources.configs import ConfigError, load, override


def test_config_inheritance(tmp_path):
    (tmp_path / "a.yaml").write_text("x: {p: 1, q: [1, 2]}\ny: 1\n")
    (tmp_path / "b.yaml").write_text("extends: a.yaml\nx: {q: [3]}\n")
    (tmp_path / "c.yaml").write_text("extends: c.yaml\n")
    assert load(tmp_path / "b.yaml", {"x.r.s": 5}) == {"x": {"p": 1, "q": [3], "r": {"s": 5}}, "y": 1}
    assert override({}, "a.b", 1) == {"a": {"b": 1}}
    with pytest.raises(ConfigError):
        load(tmp_path / "c.yaml")


def test_bundle_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.12345, None), ("c", 1.0, 2)], "name string, x double, n int")
    write_bundle({"t": df}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    assert render(df).splitlines()[2] == "| a_b | 0.123 | – |" and "a\\_b & 0.123" in render(df, "tex")
    with pytest.raises(ValueError):
        render(df, most=1)


def test_random_schedules_are_stable():
    assert random_schedules(5) == random_schedules(9)[:5]
    for _, changes in random_schedules(20):
        rounds = [t for t, _ in changes]
        assert rounds[0] == 0 and len(set(rounds)) == 3 and max(rounds) <= R
        assert all(a[1] != b[1] for a, b in zip(changes, changes[1:]))
    assert len({p[0] for p in POLICIES}) == len(POLICIES)
