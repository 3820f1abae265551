"""Broken prompt and response pairs: one defect for each broken generation.

Responses meet their questions first, by the hash of the question's text and with
hot questions salted.  One pass in Python over the pairs then gives the state of
each response (empty, refusal, copy, told, untold), the kind of its end and
whether its language is another than the question's; ``truncation`` decides which
told and untold ones are cut.

``empty``: nothing visible, or only placeholders or an empty mark; a null
response too.  ``refusal``: declines, and states no result, or none but in a
sentence before it.  ``copy``: runs of the question, found by its suffix
automaton, cover most of the response, and the rest states no result.
``truncated``: cut off.  ``language``: a finished answer in another language than
its question.  At most one holds, in this order.  A generation whose question is
unknown has neither ``copy`` nor ``language``.  Repeated rows count once; rows
without a key are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.lineage import cut
from ledgerloom.llm.copying import automaton, coverage, words
from ledgerloom.llm.endings import Ending, ending, visible
from ledgerloom.llm.language import language
from ledgerloom.llm.refusals import refusal_at
from ledgerloom.llm.truncation import limit_of, with_verdict
from ledgerloom.operators.skew import hot_keys, salted_join

# Words that stand for no answer.
PLACEHOLDERS = frozenset({"", "none", "null", "na", "nan", "nil", "undefined", "tbd", "todo", "empty", "blank", "placeholder", "noanswer", "noresponse"})
# Labels that stand before an answer.
LABELS = frozenset({"answer", "finalanswer", "result", "finalresult", "response", "output", "antwort", "endergebnis", "ergebnis", "respuesta", "respuestafinal", "réponse", "réponsefinale"})
_MARKS = re.compile(r"<[^<>]*>|\\(?:boxed|fbox|text|mathrm|mbox)\s*(?=\{)")
_NOT_WORDS = re.compile(r"[\W_]+")
_STEPS = re.compile(r"\d\s*[-+*/×÷=−]\s*\d|=\s*\d")
#: The copied share of a response that makes it a copy, and how much of it may stay uncopied besides.
COPIED, REST = 0.7, 12

_STATE = pa.schema([("gen_key", pa.string()), ("source", pa.string()), ("finish", pa.string()), ("state", pa.string()), ("kind", pa.string()), ("foreign", pa.bool_()), ("n_chars", pa.int32()), ("n_bytes", pa.int32()), ("n_tokens", pa.int32()), ("token_limit", pa.int32())])
_STATE_DDL = "gen_key string, source string, finish string, state string, kind string, foreign boolean, n_chars int, n_bytes int, n_tokens int, token_limit int"


def is_empty(text: str | None) -> bool:
    """Whether a text shows nothing, or nothing but placeholders, labels without an answer and empty marks, however often."""
    first = _FIRST.match(text or "")
    if first and first[1].lower() not in _BEGINNINGS:
        return False  # most texts: their first word begins no placeholder
    seen = visible(text)
    if seen.count("{") > seen.count("}") or seen.endswith("\\["):
        return False  # a mark that breaks off
    bare = _MARKS.sub(" ", seen)
    for chunk in bare.split():
        if (word := _NOT_WORDS.sub("", chunk).lower()) not in PLACEHOLDERS:
            break
    else:
        return True
    if len(word) > _LONGEST:
        return False
    joined = _NOT_WORDS.sub("", bare).lower()
    return joined in PLACEHOLDERS or joined in LABELS and seen.endswith((":", "："))


_LONGEST = max(map(len, PLACEHOLDERS | LABELS))
_BEGINNINGS = frozenset(w[:i] for w in PLACEHOLDERS | LABELS for i in range(1, len(w) + 1))
#: The first word outside marks; possessive, so that no mark is read in parts.
_FIRST = re.compile(r"(?>\s+|<[^<>]*>|\\(?:boxed|fbox|text|mathrm|mbox)\s*(?=\{)|[\W_])*+([^\W_]+)")


def judge(question: str | None, question_language: str | None, text: str | None) -> tuple[str, str, bool]:
    """(state, kind of the end, whether its language is another than the question's) of one response."""
    if text is None or is_empty(text):
        return "empty", "", False
    end = ending(text)
    if copies(question, text, end):
        return "copy", end.kind, False
    if not end.told or not end.notation:
        at = refusal_at(text)
        if at >= 0 and (at >= end.end >= 0 or not end.told and not _STEPS.search(text)):
            return "refusal", end.kind, False
    if not end.told:
        return "untold", end.kind, False
    own = language(text) if question_language else ""
    return "told", end.kind, bool(own) and own != question_language


def copies(question: str | None, text: str | None, end: Ending | None = None) -> bool:
    """Whether a response is a copy of its question and gives no result of its own.

    One that breaks off inside the question, or goes on with a solution that
    breaks off, is not.  A statement that reads like a result but stands in the
    question is none.
    """
    if not question or not text:
        return False
    tokens = words(text)
    _, n = automaton(question)
    if not tokens or not n or len(tokens) < 3:
        return False
    known = _vocabulary(question)
    if sum(w in known for w in tokens) < COPIED * len(tokens):
        return False  # covered words are words of the question
    share, _, reach = coverage(question, text)
    if share < COPIED or reach < 0.85 or (1.0 - share) * len(text.split()) > REST or _STEPS.search(text[-80:]):
        return False
    end = ending(text) if end is None else end
    if not end.told:
        return True
    told = " ".join(words(text[end.start : end.end])) if end.end >= 0 else ""
    return not end.notation and bool(told) and told in " ".join(words(question))


@lru_cache(maxsize=4096)
def _vocabulary(question: str) -> frozenset[str]:
    return frozenset(words(question))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("response").to_pylist()
        got = [judge(q, lang, t) for q, lang, t in zip(batch.column("question").to_pylist(), batch.column("question_lang").to_pylist(), texts)]
        columns = [batch.column(c) for c in ("gen_key", "model_id", "finish_reason")]
        columns += [pa.array([g[i] for g in got], kind) for i, kind in ((0, pa.string()), (1, pa.string()), (2, pa.bool_()))]
        columns += [pa.array([len(t or "") for t in texts], pa.int32()), pa.array([len((t or "").encode("utf-8", "replace")) for t in texts], pa.int32())]
        columns += [batch.column("n_completion_tokens"), batch.column("token_limit")]
        yield pa.RecordBatch.from_arrays(columns, schema=_STATE)


@F.pandas_udf(T.StringType())
def _language(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: language(t, margin=1.05))


def evidence(generations: DataFrame, items: DataFrame) -> DataFrame:
    """One row per gen_key: source, finish, state, kind, foreign and the lengths; written to the shared folder."""
    known = generations.where("gen_key IS NOT NULL")
    rows = known.select("gen_key", "user_hash", "model_id", "finish_reason", F.col("n_completion_tokens").cast("int").alias("n_completion_tokens"), limit_of(F.col("decoding_json")).alias("token_limit"), "response")
    questions = items.where("question IS NOT NULL").groupBy(F.sha2("question", 256).alias("user_hash")).agg(F.min("question").alias("question"))
    questions = questions.withColumn("question_lang", _language("question"))
    joined = salted_join(rows, questions, "user_hash", F.col("gen_key"), hot=hot_keys(known.select("user_hash"), "user_hash"))
    states = joined.select("gen_key", "model_id", "finish_reason", "n_completion_tokens", "token_limit", "response", "question", "question_lang").mapInArrow(_states, _STATE_DDL)
    kept = [c for c in states.columns if c != "gen_key"]
    # repeated rows are equal; of others with one key the least counts
    return cut(states.groupBy("gen_key").agg(F.min(F.struct(*kept)).alias("r")).select("gen_key", "r.*"))


def verdicts(generations: DataFrame, items: DataFrame) -> DataFrame:
    """``evidence`` with is_cut and ``defect`` (null where there is none)."""
    judged = with_verdict(evidence(generations, items))
    defect = F.when(F.col("state").isin("empty", "refusal", "copy"), F.col("state")).when(F.col("is_cut"), "truncated")
    return judged.withColumn("defect", defect.when((F.col("state") == "told") & F.col("foreign"), "language"))
