from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.answers import canonical_decimal, canonical_gold, extract_strict, last_hash_line
from ledgerloom.functions.hashing import canonical_object, content_key, derive_seed, json_text, normal, normal_quantile, pick, uniform
from ledgerloom.functions.lenient import canonical, exact, extract_lenient, last_number, lenient
from ledgerloom.functions.prompting import fill, normal_form, numbers_in, shorten, tagged, violations
from ledgerloom.functions.stats import accepts, mcnemar_exact, mcnemar_tail, mean_spread_text, spread, wilson
from ledgerloom.plans.policies import dense, parse_policy

# text, strict value, lenient value, lenient stage
CASES = [
    ("so \\boxed{18}", "18", "18", "boxed"),
    ("\\boxed{1,234}", None, "1234", "boxed"),
    ("#### 42.", "42", "42", "hash"),
    ("\\boxed{\\frac{1,000}{4}}", None, "250", "boxed"),
    ("x2 y3", None, None, "none"),
    ("\\boxed{5.00}", "5", "5", "boxed"),
    ("#### 7\nthen \\boxed{8}", "8", "8", "boxed"),
    ("\\boxed{8}\n#### 7", "7", "7", "hash"),
    ("\\boxed{}", None, None, "none"),
    ("\\boxed{x} but #### 3", "3", "3", "hash"),
    ("\\fbox{-3}", None, "-3", "fbox"),
    ("The final answer is $1,204$ dollars", None, "1204", "answer_phrase"),
    ("we get **86** here", None, "86", "bold"),
    ("2 and then 4.50", None, "4.5", "last_number"),
    ("\\boxed{\\text{about } 1/3}", None, "1", "boxed"),
    ("\\boxed{1/3}", None, "1/3", "boxed"),
    ("", None, None, "none"),
    ("\\boxed{{{7}}}", None, "7", "boxed"),
    ("first \\boxed{5} but finally \\boxed{a{b{c{d{7}}}}}", None, "7", "boxed"),
    ("\\boxed{{{{{{8}}}}}} or \\boxed{9}", "9", "9", "boxed"),
    ("\\boxed{5} then \\boxed{6", "5", "5", "boxed"),
    ("\\boxed{\\}7}", None, "7", "boxed"),
    ("**a __5__ b** and 77", None, "5", "bold"),
    ("\\boxed{a \\boxed{6} b}", "6", "6", "boxed"),
]


def test_extractors(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = rows.select("i", extract_strict(F.col("t")).alias("s"), extract_lenient(F.col("t")).alias("l")).orderBy("i").collect()
    assert [(r.s, r.l.value, r.l.method) for r in got] == [c[1:] for c in CASES]


def test_null_response(spark):
    row = spark.createDataFrame([(None,)], "t string").select(extract_strict(F.col("t")).alias("s"), extract_lenient(F.col("t")).alias("l"), last_hash_line(F.col("t")).alias("h")).first()
    assert (row.s, row.l.value, row.l.method, row.h) == (None, None, "none", None)


@given(st.fractions(max_denominator=10**6))
@settings(max_examples=200, deadline=None)
def test_canonical_round_trip(value):
    text = canonical(value)
    num, _, den = text.partition("/")
    assert Fraction(num) / Fraction(den or 1) == value


@given(st.decimals(allow_nan=False, allow_infinity=False, places=3, min_value=-(10**9), max_value=10**9), st.text(alphabet="ab {}#\\.\n", max_size=20))
@settings(max_examples=200, deadline=None)
def test_lenient_reads_what_strict_reads(number, prose):
    text = f"{prose} \\boxed{{{number:f}}}"
    if prose.count("{") == prose.count("}") == 0:
        assert lenient(text) == (canonical(exact(f"{number:f}")), "boxed")


def test_decimals(spark):
    given_ = ["007.50", "-0", "1,234", ".5", "5.", "abc", "-12.000", None]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given_)], "i int, g string")
    got = [r.c for r in rows.orderBy("i").select(canonical_decimal(F.col("g")).alias("c")).collect()]
    assert got == ["7.5", "0", "1234", "0.5", None, None, "-12", None]
    gold = spark.createDataFrame([("1,234",), ("18.0",), ("2/4",), ("−3",)], "g string").select(canonical_gold(F.col("g")).alias("c")).collect()
    assert [r.c for r in gold] == ["1234", "18", "0.5", "-3"]


def test_seeds(spark):
    """Golden seeds of the three namespaces."""
    lits = lambda *p: [F.lit(x) for x in p]
    row = spark.range(1).select(derive_seed(*lits("sample", 0, "eval", "t02", 3, "round", 5, "test", 17)).alias("a"), derive_seed(*lits("proposer", 1, 2, 0)).alias("b"), derive_seed(*lits("rng", 0, "errors", 1)).alias("c")).first()
    assert (row.a, row.b, row.c) == (85220003, 898977416, 629778058)


def test_last_number_has_its_place():
    assert last_number("a ½ b １２ and c") == ("12", 6, 8) and last_number("none") is None and last_number("−5 x") == ("-5", 0, 2)


def test_json_text_and_keys(spark):
    import hashlib
    import json

    texts = ['plain', 'a "quoted" \\ back\nslash', "tab\t\x00\x1f\x0b é 中 \x7f /", "", "\\u000b", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in rows.orderBy("i").select(json_text(F.col("t")).alias("j")).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in texts]
    key = rows.orderBy("i").select(content_key({"b": json_text(F.col("t")), "a": F.lit("1")}).alias("k")).collect()
    assert [r.k for r in key] == [hashlib.sha256(json.dumps({"a": 1, "b": t}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for t in texts]
    one = spark.range(1).select(canonical_object(F.lit('{"top_p": 1.0, "id": "x", "temperature": 0.20, "max_new_tokens": 9}'), ("temperature", "top_p", "top_k", "max_new_tokens")).alias("o")).first().o
    assert one == '{"max_new_tokens":9,"temperature":0.20,"top_p":1.0}' or one == '{"max_new_tokens":9,"temperature":0.2,"top_p":1.0}'


def test_statistics(spark):
    rows = spark.createDataFrame([(0, 0), (3, 1), (1, 3), (10, 0), (40, 25)], "w long, l long")
    for r in rows.select("w", "l", mcnemar_tail(F.col("w"), F.col("l")).alias("p")).collect():
        assert r.p == pytest.approx(mcnemar_exact(r.w, r.l), abs=1e-12)
    row = spark.range(1).select(wilson(F.lit(1), F.lit(3), False).alias("lo"), wilson(F.lit(1), F.lit(3), True).alias("hi"), wilson(F.lit(0), F.lit(0), True).alias("none")).first()
    assert row.lo == pytest.approx(0.0614919447) and row.hi == pytest.approx(0.7923403992) and row.none is None
    sd = lambda v: spark.createDataFrame([(x,) for x in v], "x double").agg(spread(F.col("x")).alias("s")).first().s
    assert sd([2.0]) == 0.0 and sd([None]) is None and sd([0.3, 0.6, 0.1]) == pytest.approx(0.2516611478)
    one = spark.range(1)
    say = lambda rule, w, l, n: one.select(accepts(rule, F.lit(w), F.lit(l), F.lit(n)).alias("a")).first().a
    assert say("net_win", 3, 2, 20) and not say("win_rate", 1, 0, 21) and say("win_rate", 1, 0, 20) and not say("win_rate", 1, 1, 2) and not say("net_win", 1, 0, 0)
    rule = lambda rule, w, l, n, **k: one.select(accepts(rule, F.lit(w), F.lit(l), F.lit(n), **k).alias("a")).first().a
    assert not rule("net_win", 3, 2, 20, margin=0.05) and rule("net_win", 3, 1, 20, margin=0.05)
    assert rule("mcnemar", 5, 0, 9, tail=F.lit(0.09)) and not rule("mcnemar", 5, 0, 9, tail=F.lit(0.10)) and not rule("mcnemar", 1, 2, 9, tail=F.lit(0.01))
    with pytest.raises(ValueError):
        accepts("other", F.lit(1), F.lit(1), F.lit(1))


def test_hash_draws(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-6, 0.01, 0.0242, 0.0243, 0.3, 0.5, 0.77, 0.9757, 0.9758, 0.999, 1 - 1e-9]
    got = [r.q for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").orderBy("i").select(normal_quantile(F.col("p")).alias("q")).collect()]
    assert all(abs(a - NormalDist().inv_cdf(p)) < 1e-6 for a, p in zip(got, ps))
    rows = spark.range(4000).select(normal(F.col("id").cast("string")).alias("z"), pick(uniform(F.concat(F.lit("u"), F.col("id"))), [("a", 1), ("b", 3), ("c", 0)]).alias("k"))
    one = rows.agg(F.avg("z").alias("m"), F.stddev("z").alias("s"), F.count_if(F.col("k") == "b").alias("b"), F.count_if(F.col("k") == "c").alias("c")).first()
    assert abs(one.m) < 0.06 and abs(one.s - 1) < 0.05 and 2850 < one.b < 3150 and one.c == 0
    with pytest.raises(ValueError):
        pick(F.lit(0.1), [("a", 0)])


def test_mean_spread_text(spark):
    text = lambda v: spark.createDataFrame([(x,) for x in v], "x double").agg(mean_spread_text(F.col("x")).alias("s")).first().s
    assert text([0.71, 0.73]) == "72.0 ± 1.4" and text([0.5]) == "50.0 ± 0.0" and text([None]) == "—"


def test_prompts(spark):
    row = spark.range(1).select(
        tagged(F.lit("<prompt>a</prompt> x <Prompt> b </PROMPT>"), "prompt").alias("a"),
        tagged(F.lit("<prompt><prompt>x</prompt></prompt>"), "prompt").alias("nested"),
        normal_form(F.lit("  Do  IT!\n")).alias("n"),
        shorten(F.lit("abcdefghij"), 2, 2).alias("s"),
        numbers_in(F.lit("1,234 or 12.50, not 1.2.3 a5")).alias("nums"),
        violations(F.lit(None).cast("string"), F.lit(True), F.lit(True), 5, 9).alias("v"),
        violations(F.lit("abc <prompt>"), F.lit(True), F.lit(False), 5, 9).alias("w"),
        fill("{a}-{b}", {"a": F.lit(1), "b": F.lit("x")}).alias("f"),
    ).first()
    assert (row.a, row.nested, row.n, row.s, row.f) == ("b", None, "do it", "ab...ij", "1-x")
    assert set(row.nums) >= {"1234", "12.5"} and row.v == ["missing"] and row.w == ["too_long", "no_format_instruction", "duplicate", "contains_tags"]
    with pytest.raises(KeyError):
        fill("{c}", {})


def test_policies_and_schedules():
    assert parse_policy("p4_K7") == ("P4_k7", "age_triggered", True, 7) and parse_policy("fixedage_k0")[1] == "fixed_age"
    with pytest.raises(ValueError):
        parse_policy("P9")
    assert [e for _, e in dense(((0, "E1"), (4, "E2"), (8, "E4")))] == ["E1"] * 4 + ["E2"] * 4 + ["E4"] * 4
    with pytest.raises(ValueError):
        dense(((1, "E1"),))
