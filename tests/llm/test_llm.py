import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import defects, leakage, mixing, mojibake, neardup, overlap, queries, truncation  # noqa: E402
from ledgerloom.llm.copying import SuffixAutomaton, coverage  # noqa: E402
from ledgerloom.llm.endings import KINDS, ending, unclosed  # noqa: E402
from ledgerloom.llm.language import language  # noqa: E402
from ledgerloom.llm.refusals import declines  # noqa: E402
from ledgerloom.sources.tables import table  # noqa: E402

D = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]


def split_words(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


def runs(s, k):
    w = split_words(s)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(a, b, t):
    return bool(a and b) and Fraction(len(a & b), len(a | b)) >= t


def edited(rng, text):
    w = text.split()
    for _ in range(rng.randint(0, 5)):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def corpus(seed, n=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 6):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.randint(12, 40)))
        texts += [edited(rng, base) for _ in range(5)] + [base.upper() + "!"]
    return texts + [None, "", "one two", "x " * 4000]


@pytest.mark.parametrize("t,k", [(Fraction(1, 2), 3), (Fraction(4, 5), 2)])
def test_near_duplicates_equal_brute_force(spark, t, k):
    texts = corpus(int(t * 100))
    rows = [(f"h{i:03d}", x, i) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:9], "prompt_hash string, text string, id int")  # repeated rows, a clashing column
    members, links = neardup.near_duplicates(df, "prompt_hash", "text", k, t)
    got = sorted(map(tuple, neardup.pairs_of_keys(members, links).collect()))
    sets = {h: runs(x, k) for h, x, _ in rows}
    assert got == sorted(p for p in itertools.combinations(sorted(sets), 2) if near(sets[p[0]], sets[p[1]], t))
    group = {r.key: r.group_id for r in neardup.groups(members, links).collect()}
    assert all(group[a] == group[b] for a, b in got)
    part = {h: h for h in group}
    for _ in group:
        for a, b in got:
            part[a] = part[b] = min(part[a], part[b])
    assert len(set(group.values())) == len(set(part.values()))


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "prompt_hash string, text string")
    members, links = neardup.near_duplicates(df, "prompt_hash", "text")
    assert neardup.pairs_of_keys(members, links).count() == 0 and neardup.groups(members, links).count() == 0


def test_hot_token_is_cut_but_loses_nothing(spark, monkeypatch):
    from ledgerloom.llm import setjoin

    monkeypatch.setattr(setjoin, "AT_ONCE", 50)
    monkeypatch.setattr(setjoin, "PIECE", 37)
    rng = random.Random(5)
    stock = "a common stock sentence that very many texts hold somewhere inside"
    texts = [f"{stock} {' '.join(rng.choice(WORDS[:8]) for _ in range(6))}" for _ in range(1200)]
    df = spark.createDataFrame([(f"{i:05d}", x) for i, x in enumerate(texts)], "prompt_hash string, text string")
    members, links = neardup.near_duplicates(df, "prompt_hash", "text", 3, Fraction(4, 5), 2)
    classes = {}
    for x in texts:
        classes.setdefault(frozenset(runs(x, 3)), len(classes))
    want = sum(near(a, b, Fraction(4, 5)) for a, b in itertools.combinations(classes, 2))
    assert links.count() == want > 0


def test_blocks_meet_the_same_pairs(monkeypatch):
    from ledgerloom.llm import setjoin

    rng = np.random.default_rng(3)
    rows = 900
    base = rng.integers(-(1 << 62), 1 << 62, (20, len(setjoin.BITS)))
    bits = base[rng.integers(0, 20, rows)] ^ (1 << rng.integers(0, 60, (rows, 1)))  # near one of 20
    key, n = np.sort(rng.integers(0, 3, rows)), rng.integers(5, 40, rows).astype(np.int32)
    n = n[np.lexsort((n, key))]
    rest = rng.choice([setjoin.SMALL | setjoin.LARGE, setjoin.LARGE], rows) | 3 * setjoin.LEFT | rng.integers(1, 4, rows) << setjoin.POSITION
    part = {"key": key, "n": n, "id": rng.permutation(rows), "rest": rest} | {b: np.ascontiguousarray(bits[:, i]) for i, b in enumerate(setjoin.BITS)}
    met = {}
    for wide, block in ((1 << 40, (128, 1024)), (1, (128, 1024)), (1, (7, 10)), (150, (7, 10))):
        monkeypatch.setattr(setjoin, "WIDE", wide)
        monkeypatch.setattr(setjoin, "BLOCK", block)
        met[wide, block] = {p for b in setjoin._compare(dict(part), 1, 2) for p in zip(b.column("s").to_pylist(), b.column("l").to_pylist())}
    assert all(m == met[1 << 40, (128, 1024)] for m in met.values()) and len(met[1, (7, 10)]) > 100


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    items = []
    for i in range(40):
        base = " ".join(rng.choice(WORDS) for _ in range(20))
        for split in ("train", "test", "holdout"):
            items.append((split, i, edited(rng, base), None if i % 7 == 0 else edited(rng, base[::-1] if i % 2 else base)))
    items += [("test", 90, None, ""), ("train", 90, "", None), (None, 1, "a b c", "d"), ("test", 91, "y " * 5000, "z"), ("train", 91, "y " * 5000, "z")]
    df = spark.createDataFrame(items + items[:5], "split string, idx int, question string, answer_text string").withColumn("field", F.lit(1)).withColumn("id", F.lit("x"))
    got = {tuple(r)[:4] for r in overlap.overlaps(df, ["question", "answer_text"], 2, Fraction(3, 5)).collect()}
    want = {(a[0], a[1], b[0], b[1]) for a in items for b in items if a[0] in ("test", "holdout") and b[0] == "train" and any(near(runs(a[f], 2), runs(b[f], 2), Fraction(3, 5)) for f in (2, 3))}
    assert got == want


@pytest.mark.parametrize("block_words,piece", [(10**6, 2000), (300, 2000), (100, 3)])
def test_leaks_equal_brute_force(spark, monkeypatch, block_words, piece):
    monkeypatch.setattr(leakage, "PIECE", piece)
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS[:25]) for _ in range(n))
    items = [(rng.choice(["test", "holdout", "train"]), i, say(rng.randint(10, 40)), say(rng.randint(5, 30))) for i in range(60)]
    items += [("test", 100, None, None), ("test", 101, "same words " * 30, "q")]
    docs = []
    for i in range(80):
        q = rng.choice(items)[2 + i % 2] or ""
        w = q.split()
        a = rng.randrange(max(1, len(w)))
        docs.append((i, f"{say(8)}. {' '.join(w[a : a + rng.randint(8, 30)]).title()}, {say(6)}"))
    docs += [(500, None), (501, ""), (502, "same words " * 2000), (None, "x")]
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("idx", F.lit(0))
    i = spark.createDataFrame(items + items[:4], "split string, idx int, question string, answer_text string").withColumn("doc_id", F.lit(1))
    got = sorted(map(tuple, leakage.leaked_items(d, i, block_words=block_words).collect()))
    want = sorted({(doc, s, idx) for doc, text in docs if doc is not None for s, idx, *fields in items if s != "train" and any(runs(text, 13) & runs(f, 13) for f in fields)})
    assert got == want and len(want) > 5


def test_buckets_of_the_index_are_bounded(spark, monkeypatch):
    """A text with many anchors isn't whole in each of their buckets."""
    items = [("test", i, " ".join(f"x{i}y{j}" for j in range(60)), None) for i in range(300)]
    d = spark.createDataFrame([(i, f"before {q} after") for _, i, q, _ in items[:50]], "doc_id long, text string")
    seen = []
    kind = type(d)
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *by: seen.append(self) or real(self, *by))
    found = leakage.leaked_items(d, spark.createDataFrame(items, "split string, idx int, question string, answer_text string"), block_words=500)
    words = F.aggregate("words", F.lit(0), lambda n, w: n + F.octet_length(w).cast("int")) / 8
    sizes = [r.n for r in seen[-1].where("doc_id IS NULL").groupBy("bucket").agg(F.sum(words).alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) <= 3 * 500
    assert sorted(map(tuple, found.collect())) == [(i, "test", i) for i in range(50)]


def test_wand_equals_full_scoring():
    rng = random.Random(2)
    items = [((i,), [leakage.word_hashes(" ".join(rng.choice(WORDS[:12]) for _ in range(60)))]) for i in range(400)]
    index = leakage.Index(items, 2, 5)
    for _ in range(40):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), 15)))
        score = np.zeros(len(items))
        for t in terms:
            lo, hi = index.offsets[t], index.offsets[t + 1]
            score[index.docs[lo:hi]] += index.weights[lo:hi]
        least = float(np.quantile(score, rng.choice([0.5, 0.9, 0.99])))
        assert sorted(index.retrieve(terms, least)) == [i for i in range(len(items)) if score[i] >= least - 1e-6]
    assert leakage.Index([], 5, 13).leaks(leakage.word_hashes("a b c " * 9)) == leakage.Index([], 5, 13).leaks(leakage.word_hashes(None)) == []


@pytest.mark.parametrize("n", [300, 1500])
def test_isolated_runs_are_found_among_many_items(n):
    texts = [[f"x{i}y{j}" for j in range(20)] for i in range(n)]
    of = lambda w: leakage.word_hashes(" ".join(w))
    index = leakage.Index([((i,), [of(w), of([])]) for i, w in enumerate(texts)], 5, 13)
    assert [index.leaks(of(["in", "front", *w[i % 8 : i % 8 + 13], "and", "behind"])) for i, w in enumerate(texts)] == [[i] for i in range(n)]
    assert [index.leaks(of(w[:12])) for w in texts] == [[]] * n
    assert (index.weights >= np.repeat(index.idf, np.diff(index.offsets))).all()


def test_suffix_automaton_finds_every_run():
    rng = random.Random(1)
    tokens = [rng.choice("abc") for _ in range(40)]
    sam = SuffixAutomaton(tokens)
    known = {tuple(tokens[i:j]) for i in range(40) for j in range(i + 1, 41)}
    for _ in range(500):
        run, state = [rng.choice("abc") for _ in range(rng.randint(1, 8))], 0
        for token in run:
            state = sam.next[state].get(token, -1)
            if state < 0:
                break
        assert (state >= 0) == (tuple(run) in known)
    assert coverage("", "x") == (0.0, 0.0, 0.0) and coverage("a b c", "a b c") == (1.0, 1.0, 1.0)


Q = "A farmer named Bo starts with 40 liters in the tank and then pours in 12 liters. How many liters are in the tank of Bo now?"
RESPONSES = [
    (None, "empty"), ("", "empty"), ("​ \n", "empty"), ("N/A", "empty"), ("\\boxed{}", "empty"), ("<answer></answer>", "empty"), ("####", "empty"), ("```\n```", "empty"),
    ("#### 52", None), ("52", None), ("1,204.", None), ("52 liters.", None), ("\\boxed{", "truncated"), ("\\boxed{52}", None), ("The answer is 52.", None),
    ("The tank holds 40 + 12 = 52 liters.\nSo the result is 52.\nANSWER -> 52\nHope this helps", None),
    ("The tank holds 40 + 12 = 52 liters. So the result is 52.\n\\[ \\boxed{52} \\]", None),
    ("The tank holds 40 + 12 = 52 liters. So the result is 52.\n\\[ \\boxed{52}", "truncated"),
    ("The tank holds 40 + 12 = 52 lit", "truncated"), ("The tank holds 40 + 12 = 52 liters.\nThe final ans", "truncated"), ("The tank holds 40 + 12 = 152 liters.\nSo the result is 152.\n#### 15", "truncated"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ("Lo siento, pero no puedo ayudar con eso.", "refusal"), ("I am unable to solve this problem. Still, the answer is 52.", None),
    (Q, "copy"), (f'"{Q.lower()}"', "copy"), (f"Question: {Q}\n\nAnswer:", "copy"), (f"{Q}\n\nThe tank holds 40 + 12 = 52 liters. So the result is 52.\n**52**", None),
    ("Zuerst schauen wir auf die Angaben.\nDas sind ungefähr 50.\nAlso ergibt sich 52.\n#### 52", "language"), ("我们先看题目中给出的数字。\n因此结果是 52。\n答案是 52。", "language"),
]


def test_defects(spark):
    import hashlib

    u = hashlib.sha256(Q.encode()).hexdigest()
    rows = [(f"g{i:02d}", u, "m", t, "stop", 9, '{"max_new_tokens": 192}') for i, (t, _) in enumerate(RESPONSES)]
    rows += [("unknown", "?", "m", "Wir haben also 3 und das ist es.\n#### 3", None, None, None), (None, u, None, "x", None, None, None)]
    g = spark.createDataFrame(rows + rows[:5], "gen_key string, user_hash string, model_id string, response string, finish_reason string, n_completion_tokens int, decoding_json string").withColumn("state", F.lit("x")).withColumn("question", F.lit(1))
    items = spark.createDataFrame([(Q, "core"), (None, None)], "question string, text string")
    got = {r.gen_key: r.defect for r in defects.verdicts(g, items).collect()}
    want = {f"g{i:02d}": want for i, (_, want) in enumerate(RESPONSES)} | {"unknown": None}
    assert {k: (v, got[k]) for k, v in want.items() if got[k] != v} == {} and len(got) == len(want)
    none = defects.verdicts(g.limit(0), items.limit(0))
    assert none.count() == 0


def test_long_response():
    text = "The tank holds 40 + 12 = 52 liters. " * 20000
    assert defects.judge(None, None, text + "\\boxed{52}")[0] == "told" and defects.judge(Q, "en", text + "The")[:2] == ("untold", "inside")
    assert ending(None).kind == "inside" and language(None) == ""
    assert defects.is_empty("<answer></answer> " * 600) and defects.is_empty("N/A. " * 2000) and not defects.is_empty("N/A. " * 2000 + "5")


def test_padding_in_front_changes_no_kind():
    for tail in ("#### 9 apples", "The answer is 52.\nHope this helps", "so 4 + 5 = 9. **9**", "and the tank has 4", "The result is 9 apples and then", "\\[ \\boxed{52} \\]"):
        kinds = {ending("Some words here. " * n + "\n" + tail).kind for n in (1, 5, 14, 15, 16, 40, 400)}
        assert len(kinds) == 1, (tail, kinds)


def test_delimiter_stack():
    names = lambda text: [d for d, _ in unclosed(text)]
    assert names("\\[ \\boxed{\\frac{1}{2}} \\]") == [] and names("\\[ \\boxed{\\frac{1}{2}") == ["\\[", "{"]
    assert names("it costs $5 and then $6") == [] and names("$5 + 6$ and $x") == ["$"] and names("**52") == ["**"] and names("**52** `a") == ["`"]
    assert names("a) first \\} (b") == ["("] and names("<answer>5</answer><answer>") == ["<answer>"] and names("") == []


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Let us see. \\boxed{7} is what the first basket holds, and the second basket then has some mor", "mark_run_on"),
        ("Thus 4 + 5 = 9. The total comes to \\boxed{9} in all", "mark_single"),
        ("Thus 4 + 5 = 9.\nSo the result is 9.\nThe total comes to \\boxed{9} in all", "mark_closing"),
        ("4 + 59 = 63. So 63.\nSo the result is 6", "said_prefix"),
        ("4 + 59 = 63. So the result is 63", "said_once"),
        ("\\boxed{5} and then 5 + 3 = 8", "mark_steps"),
        ("We get 4 + 5 = 9.\n$\\boxed{9}", "mark_open"),
        ("4 + 5 = 9 apples in all. There are 9.", "restated"),
        ("4 + 5 = 9 apples. Nothing else matters.", "whole"),
    ],
)
def test_kinds_of_ends(text, kind):
    assert ending(text).kind == kind


def test_copies_read_the_whole_response():
    q = "What is the total of 5 apples and 6 pears that Bo has in the big basket?"
    assert defects.judge(q, "en", f"{q} {q}")[0] == "copy"
    assert defects.judge(q, "en", f"{q} The answer is 11.")[0] == "told" and defects.judge(q, "en", f"{q}\n#### 11")[0] == "told"
    assert defects.judge(q, "en", "The total so far is 5. I'd rather not go on with this.")[0] == "refusal"


@pytest.mark.parametrize(
    "text,no",
    [
        ("Dabei möchte ich lieber nicht helfen.", True), ("Ich kann diese Aufgabe nicht lösen.", True), ("Wir können nicht mehr als 7 haben.", False), ("Ich kann die 7 schon sehen. Das ist nicht schwer.", False),
        ("Je ne peux malheureusement pas répondre.", True), ("On ne peut pas avoir plus de 7.", False), ("No puedo contestar a esto.", True), ("Não consigo responder.", True), ("Не могу ответить.", True),
        ("We cannot have more than 7.", False), ("That is something I won’t discuss.", True), ("", False),
    ],
)
def test_refusals(text, no):
    assert declines(text) is no


def test_lengths_decide_what_the_end_leaves_open():
    """A clause that goes on from a mark is complete, unless many values have just its length."""
    counts = [("mark_clause", "stop", "field", 0.9, 30.0), ("inside", "stop", "field", 0.9, 270.0), ("mark_clause", "stop", "none", 0.0, 30.0), ("mark", "stop", "none", 0.0, 9000.0), ("inside", "stop", "none", 0.0, 100.0), ("mark", "limit", "token", 0.97, 50.0), ("inside", "limit", "token", 0.97, 150.0)]
    reasons, shares = truncation.end_weights(counts)
    odds = lambda kind, reason, limit, p: KINDS[kind] + reasons[reason, limit] + math.log(shares[limit, p] / (1 - shares[limit, p]))
    assert odds("mark_clause", "stop", "field", 0.9) > 0 > odds("mark_clause", "stop", "none", 0.0)
    assert odds("said", "limit", "token", 0.97) > 0 > odds("said", "stop", "none", 0.0)
    assert odds("mark", "limit", "token", 0.97) < 0 < odds("said_once", "stop", "none", 0.0)
    assert 0.6 < shares["token", 0.97] < 0.85
    assert truncation.end_weights([])[1]["none", 0.0] == pytest.approx(truncation.LOST)


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(4)
    full = np.exp(rng.normal(5.5, 0.4, 40000)).astype(int)
    seen = np.minimum(full, 256)
    length, n = np.unique(seen, return_counts=True)
    opened = np.where(length == 256, n - (full == 256).sum(), 0)
    mu, sigma = truncation.censored_lognormal(length.astype(float), (n - opened).astype(float), opened.astype(float))
    assert abs(mu - 5.5) < 0.02 and abs(sigma - 0.4) < 0.02
    import pandas as pd

    fit = truncation.fit_source(pd.DataFrame({"length": length, "n": n}))
    assert [x[:2] for x in fit["limits"]] == [[256.0, None]] and fit["limits"][0][2] > 0.9 and abs(fit["mu"] - 5.5) < 0.02
    stated = truncation.fit_source(pd.DataFrame({"length": length, "n": n, "token_limit": 256}))
    assert [x[:2] for x in stated["limits"]] == [[256.0, 256.0]] and stated["limits"][0][2] > 0.9
    assert truncation.fit_source(pd.DataFrame({"length": [7], "n": [1]}))["limits"] == []


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, "abc"[min(2, i % 5)], " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))) for i in range(900)] + [(1000, None, "x"), (1001, "a", None), (1002, "a", ""), (None, "a", "y")]
    d = spark.createDataFrame(docs + docs[:7], "doc_id long, source string, text string").withColumn("rate", F.lit(0))
    plans = spark.createDataFrame([("m", 0.5, 3), ("n", 4.0, 2), (None, 1.0, 1)], "mix_id string, budget_ratio double, max_repeats int")
    targets = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 1.0), ("n", "a", 1.0), ("n", "c", 1.0), ("n", "lost", 1.0), ("m", "c", None)], "mix_id string, source string, weight double")
    counts = mixing.token_counts(d, f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
    assert counts.count() == 903
    wanted = mixing.targets(counts, plans, targets)
    sampled = mixing.sample(counts, wanted).cache()
    rates = {(r.mix_id, r.source): r for r in wanted.collect()}
    by: dict = {}
    for r in sampled.collect():
        rate, most = rates[r.mix_id, r.source].rate, rates[r.mix_id, r.source].max_repeats
        assert math.floor(rate) <= r.n_copies <= math.ceil(rate) and r.n_copies <= most
        by[r.mix_id, r.source] = by.get((r.mix_id, r.source), 0) + r.n_copies
    for key, r in rates.items():
        assert abs(by.get(key, 0) - r.rate * r.n_documents) <= 1
    tokens: dict = {}
    for r in sampled.collect():
        tokens[r.mix_id, r.source] = tokens.get((r.mix_id, r.source), 0) + r.n_copies * r.n_tokens
    for key, r in rates.items():  # by size, the tokens follow the target within two documents
        if r.rate * r.source_tokens >= r.target_tokens:
            assert abs(tokens.get(key, 0) - r.target_tokens) <= 200, key
    report = {(r.mix_id, r.source): r for r in mixing.shares(wanted, sampled).collect()}
    assert report["n", "lost"].actual_tokens == 0 and not report["n", "lost"].reachable and report["m", "a"].reachable
    assert abs(sum(r.actual_share for k, r in report.items() if k[0] == "m") - 1) < 1e-9


def test_places_number_each_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    counts = spark.range(137).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("n_tokens"))
    for source, n in (("a", 46), ("b", 91)):
        got = [r.place for r in mixing.positions(counts).where(F.col("source") == source).collect()]
        assert sorted(got) == list(range(n))


TEXTS = ["Größere Zahlen für jüngere Schüler – „so“ heißt es.", "NÃO COPIE A SOLUÇÃO DA LIÇÃO 6 SEM REVISÃO.", "La précision a été de 76 %, d’où l’écart.", "Политика хранит устаревшую базу сравнения.", "│ acc │ ≥ 200 × 3² ± 0.5 ‰ €", "¿Cuántos años? ¡Atención! «niño»"]


@pytest.mark.parametrize("text", TEXTS)
def test_mojibake_round_trip(text):
    assert mojibake.spans(text) == []
    for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251", "cp850"):
        bad = mojibake.decode(text.encode(), wrong)
        assert mojibake.restored(bad, mojibake.spans(bad)) == text, wrong
        mixed = f"{text} {bad}"
        assert mojibake.restored(mixed, mojibake.spans(mixed)) == f"{text} {text}", wrong
    twice = mojibake.decode(mojibake.decode(text.encode(), "cp1252").encode(), "cp1252")
    assert mojibake.restored(twice, mojibake.spans(twice)) == text


SCRIPTS = ["Great job 😀 team 🎉!", "Він їхав до міста, але ще не приїхав.", "Καλημέρα κόσμε, πόσα μήλα έχουμε;", "مرحبا بالعالم كم تفاحة", "中文字符编码问题。", "日本語のテキストです", "שלום עולם", "Tiếng Việt có dấu", "Größe – „so“"]


@pytest.mark.parametrize("text", SCRIPTS)
def test_utf8_of_any_script_round_trips(text):
    """Read once as any single-byte encoding it comes back; read twice it comes back or at least is found."""
    assert mojibake.spans(text) == []
    for wrong in mojibake.RUN_AS:
        bad = mojibake.decode(text.encode(), wrong)
        got = mojibake.restored(bad, mojibake.spans(bad))
        assert got == text or got == bad and "😀" in text and wrong in ("cp866", "mac_cyrillic"), (wrong, got)
    for first, then in itertools.product(mojibake.UTF8_AS, repeat=2):
        bad = mojibake.decode(mojibake.decode(text.encode(), first).encode(), then)
        assert mojibake.spans(bad), (first, then)


def test_lossy_decodings_restore_nothing_ambiguous():
    table = mojibake._TABLE
    for a, b in (("├", "┌"), ("Á", "Í")):  # the bytes in which they differ are undefined
        seqs = {mojibake.decode(x.encode(), "cp1252", "�") for x in (a, b)}
        for seq in seqs & set(table):
            assert table[seq][0] in ("", a, b)
    seq = mojibake.decode("Á".encode(), "cp1252", "�")
    assert seq == mojibake.decode("Í".encode(), "cp1252", "�") and table[seq][0] == ""


def test_mojibake_single_byte_and_legitimate():
    text = "Политика хранит устаревшую базу сравнения, проверяют решение."
    for src, wrong in (("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251")):
        bad = mojibake.decode(text.encode(src), wrong)
        assert mojibake.restored(bad, mojibake.spans(bad)) == text
    for fine in ("Ã is a letter of words like MAÇÃ, Ð opens the list.", "ВНИМАНИЕ: ПРОВЕРКА В ПОНЕДЕЛЬНИК.", "├── a\n│   └── b", "„Å“ und “AMANHÔ", "√73 ≈ 8.54", "gâteaux abîmées", "x²y", "", None):
        assert mojibake.spans(fine) == [], fine
    assert [s.name for s in mojibake.spans("F�r alle")] == ["lost"]


def test_mojibake_table(spark):
    df = spark.createDataFrame([(1, "fÃ¼r"), (1, "fÃ¼r"), (2, "für"), (3, None), (None, "fÃ¼r"), (4, ""), (5, "Ã¼" * 50000)], "doc_id long, text string").withColumn("encoding", F.lit(1))
    got = {r.doc_id: r.restored for r in mojibake.garbled(df).collect()}
    assert got == {1: "für", 5: "ü" * 50000}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, name):
    df = queries.queries()[name](spark, D)
    assert df.count() >= 0


def test_found_columns(spark):
    want = {"p1_found": "hash_a hash_b", "p2_found": "gen_key defect", "p3_found": "gen_key", "p4_found": "split_a idx_a split_b idx_b", "p5_found": "doc_id split idx", "p7_found": "doc_id"}
    for name, columns in want.items():
        df = queries.queries()[name](spark, D)
        assert df.columns == columns.split() and df.count() == df.distinct().count()
    assert table(spark, D, "items").count() > 0


def test_empty_tables(spark, tmp_path):
    """Every query gives an empty result, or one row for each thing there is, over tables without rows."""
    for name in ("prompts", "generations", "items", "documents", "mix_plans", "mix_targets"):
        table(spark, D, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        df = query(spark, str(tmp_path))
        assert df.count() == (3 if name == "p1_orders" else 0), name


def test_one_text_in_a_third_of_all_rows(spark):
    """A hot class, a hot leak: nothing is lost and no pair doubled."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    same = say(40)
    texts = [same if i % 3 == 0 else say(40) for i in range(240)]
    members, links = neardup.near_duplicates(spark.createDataFrame([(f"{i:04d}", x) for i, x in enumerate(texts)], "k string, t string"), "k", "t", 3, Fraction(1, 2))
    assert neardup.pairs_of_keys(members, links).count() == neardup.pairs_of_keys(members, links).distinct().count() == 80 * 79 // 2
    items = spark.createDataFrame([("test", i, same if i % 3 == 0 else say(30), None) for i in range(60)], "split string, idx int, question string, answer_text string")
    docs = spark.createDataFrame([(i, f"so {same} it is" if i % 3 == 0 else say(50)) for i in range(90)], "doc_id long, text string")
    got = leakage.leaked_items(docs, items)
    assert got.count() == 20 * 30 and {r.doc_id % 3 for r in got.collect()} == {0}
    both = items.unionByName(items.withColumn("split", F.lit("train")))
    assert overlap.overlaps(both, ["question", "answer_text"], 2, Fraction(3, 5)).where("idx_a % 3 = 0 AND idx_b % 3 = 0").count() == 20 * 20
