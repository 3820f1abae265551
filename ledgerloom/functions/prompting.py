"""Prompt texts: tagged parts, normal form, rule violations, shortened responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import hash32, joined

# The violations, in the order in which they are reported.
VIOLATIONS = ("missing", "too_short", "too_long", "no_format_instruction", "duplicate", "leaks_gold", "contains_tags")
_EDGE = r"[\s!-/:-@\[-`{-~]+"


def tagged(text: Column, tag: str) -> Column:
    """Trimmed content of the last ``<tag>...</tag>`` pair; null without one, if it is empty or holds another opening tag."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    content = F.regexp_replace(F.when(F.size(found) > 0, F.element_at(found, -1)), r"^\s+|\s+$", "")
    return F.when((content != "") & ~content.rlike(rf"(?i)<{tag}>"), content)


def normal_form(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at the edges."""
    s = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(s, "^" + _EDGE, ""), _EDGE + "$", "")


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with every ``{name}`` replaced; a name without a value is an error."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] not in values:
            raise KeyError(m[1])
        parts += [F.lit(template[at : m.start()]), values[m[1]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def numbers_in(text: Column) -> Column:
    """Standalone numbers of a text, without commas and trailing zeros of decimals."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![\p{L}\p{N}_]|[.,]\d)"), F.lit(1))
    plain = F.transform(tokens, lambda t: F.regexp_replace(t, ",", ""))
    return F.array_distinct(F.transform(plain, lambda t: F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")).otherwise(F.regexp_replace(t, r"^0+(?=\d)", ""))))


def violations(candidate: Column, duplicate: Column, leaks: Column, least: int, most: int) -> Column:
    """array<string> of what is wrong with a candidate prompt, in fixed order; a missing one is only that."""
    n = F.length(candidate)
    # the tags are fixed values
    tests = [(n < least, "too_short"), (n > most, "too_long"), (~candidate.contains("\\boxed"), "no_format_instruction"), (duplicate, "duplicate"), (leaks, "leaks_gold"), (candidate.rlike(r"(?i)</?(prompt|current_prompt|example|response|question)\b[^>]*>"), "contains_tags")]
    every = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]), lambda v: v.isNotNull())
    return F.when(candidate.isNull(), F.array(F.lit("missing"))).otherwise(every)


def shorten(text: Column, head: int, tail: int) -> Column:
    """Head and tail with dots between, for texts longer than both and the dots."""
    cut = F.concat(F.substring(text, 1, head), F.lit("..."), F.substring(text, -tail, tail))
    return F.when(F.length(text) > head + tail + 3, cut).otherwise(text)


#: Feature patterns of a prompt with their weights; a feature counts only in a clause that doesn't negate it.
# What a prompt asks for, as patterns of one sentence each.
FEATURES = {
    "step": r"step[- ]by[- ]step|show (?:all |each |every )?(?:of )?(?:your |the )?(?:work|steps?)\b|work through",
    "verify": r"double[- ]check|\bverify|\bre-?check|\bcheck (?:each|every|your|the)\b",
    "read": r"read (?:the |each )?(?:question|problem)s?\s+carefully|carefully read|identify (?:exactly )?what",
    "brief": r"\bbrief(?:ly)?\b|\bas short as possible\b|\bconcise(?:ly)?\b",
    "plain": r"plain number|no commas|without (?:any )?(?:commas|units|(?:the )?currency)|no (?:units|currency)|only the number",
}
NEGATION = r"(?i)\b(?:not|never|avoid|don't|no)\b"
WEIGHTS = {"step": 0.35, "verify": 0.25, "read": 0.15, "brief": -0.3}


def affirmed(text: Column, pattern: str) -> Column:
    """Whether some clause of the text matches the pattern and has no negation in front of the match."""
    clauses = F.split(text, r"(?<=[.!?])\s+|\n+|[;,:]")
    before = lambda c: F.regexp_extract(c, rf"(?is)^(.*?)(?:{pattern})", 1)
    return F.exists(clauses, lambda c: c.rlike(f"(?i){pattern}") & ~before(c).rlike(NEGATION))


def features(text: Column) -> dict[str, Column]:
    return {name: affirmed(text, p) if name != "plain" else text.rlike(f"(?i){p}") for name, p in FEATURES.items()}


def quality(text: Column, base: float = 0.0) -> Column:
    """A prompt's score: the base and the weights of its features."""
    found = features(text)
    return F.lit(base) + sum((F.when(found[name], F.lit(w)).otherwise(F.lit(0.0)) for name, w in WEIGHTS.items()), F.lit(0.0))


def numbered_blocks(errors: DataFrame, by: list[str], order: list[Column], template: str, separator: str = "\n\n") -> DataFrame:
    """(by, n_errors, golds, blocks): the sampled errors of each group as numbered blocks, filled from their columns.

    A group is a sample of bounded size.
    """
    names = [c for c in errors.columns if c not in by]
    rows = errors.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *names))).alias("e"))
    block = lambda e, i: fill(template, {"i": i + 1, **{c: e[c] for c in names}})
    return rows.select(*by, F.size("e").alias("n_errors"), F.transform("e", lambda e: e["gold"]).alias("golds"), F.array_join(F.transform("e", block), separator).alias("blocks"))


def sampled(errors: DataFrame, by: list[str], key: Column, k: int, *seed: Column) -> DataFrame:
    """``k`` rows of each group, by a hash of seed and key; all of a group that has fewer.

    Two steps, within salted parts of a group and then over their winners, so that a
    hot group is in no task whole.
    """
    if k <= 0:
        return errors.limit(0)
    rows = errors.withColumn("_h", hash32(joined(F.lit("errors"), *seed, *[F.col(c) for c in by], key))).withColumn("_part", F.pmod("_h", F.lit(64)))
    inside = Window.partitionBy(*by, "_part").orderBy("_h", key)
    winners = rows.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k)
    return winners.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where(F.col("_r") <= k).drop("_h", "_part", "_r")


def sample_exactly(indices: list[int], k: int, seed: int) -> list[int]:
    """``k`` of the sorted indices by the seeded generator of the standard library, in drawn order; all of them if there are fewer."""
    import random

    ordered = sorted(indices)
    return [] if k <= 0 else ordered if len(ordered) < k else random.Random(seed).sample(ordered, k)


def _normal(text: str) -> str:
    import re
    import string

    return re.sub(r"\s+", " ", text.lower()).strip(string.punctuation + string.whitespace)


def fallback(incumbent: str, sentences: list[str], round_: int, prior: list[str], seed: int) -> str:
    """The incumbent with one more sentence that gives no earlier prompt, or with a revision number where none does."""
    import random

    known, base = {_normal(p) for p in prior}, incumbent.rstrip()
    fresh = [f"{base}\n{s}" for s in sentences if _normal(s) not in _normal(incumbent)]
    fresh = [p for p in fresh if _normal(p) not in known]
    if fresh:
        return random.Random(seed).choice(fresh)
    suffixes = (f"(Revision {round_}{'' if n < 2 else f', variant {n}'}.)" for n in range(1, len(prior) + 3))
    return next(p for p in (f"{base}\n{s}" for s in suffixes) if _normal(p) not in known)
