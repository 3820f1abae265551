"""How a response ends: what its text alone shows about whether the rest was cut off.

``ending(text)`` finds the last statement of a final result in the whole text,
runs a stack of delimiters over it, looks at what follows the statement, and names
the *kind* of the end.  A kind is graded evidence, no verdict: ``truncation``
weighs how often it occurs among cut and among complete values, with the
log-likelihood ratios of ``KINDS`` as its prior.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick

NUMBER = r"[-−+]?(?:\d[\d.,  ]*\d|\d)(?:/\d+)?"
# Nouns that name a result, by language (en, de, fr, es, it, pt, nl, pl, ru, zh, ja).
RESULT_WORDS = (
    "answer", "result", "final", "total", "solution",
    "antwort", "ergebnis", "endergebnis", "lösung", "réponse", "résultat", "respuesta", "resultado", "solución",
    "risposta", "risultato", "resposta", "antwoord", "odpowiedź", "wynik", "ответ", "результат", "итог", "答案", "结果", "答え",
)
_WORD = "|".join(sorted(RESULT_WORDS, key=len, reverse=True))
#: A label before a number: "Answer: 5", "final = 5", "ANSWER -> 5".
_LABEL = re.compile(rf"(?:{_WORD})[^\W\d_]*\W{{0,3}}(?:[ \t]*(?::|=|->|→|：))[ \t]*(?P<num>[$€£]?{NUMBER})", re.I)
#: A sentence that tells the result: "The answer is 5."
_SENTENCE = re.compile(rf"(?:{_WORD})[^.\n:=\d]{{0,40}}?(?P<num>{NUMBER})(?P<unit>[^.\n。!\d]{{0,40}})(?P<stop>[.。!])?(?=\s|$)", re.I)
_BOX = re.compile(r"\\(?:boxed|fbox)\s*\{")
_HASH = re.compile(r"(?m:^)[ \t]*#{4}[ \t]*(\S[^\n]*)")
_BOLD = re.compile(r"\*\*[ \t]*([^*\n]*\d[^*\n]*)\*\*")
_NUMBERS = re.compile(NUMBER)
_BLANK = re.compile(r"[\s\u200b\u200c\u200d\ufeff\u00ad\u2060]+")
_STEPS = re.compile(r"[\d)][ \t]*[-+*/×÷=−][ \t]*[-−(]?\d|=")
#: A number and nothing else, or with a unit and a stop.
_BARE = re.compile(rf"[\W_]*{NUMBER}(?:[\W_]*|[ \t]*[^\W\d_]+\.)")
_SENTENCES = re.compile(r"(?<=[.。!?])\s+|\n+")
_MARKUP = re.compile(rf"\\[a-zA-Z]|\*\*|#|[:=>$]\s*$|(?:{_WORD})", re.I)
_DELIMITERS = re.compile(r"\\[\[\]()]|\\.|\$\$?|[{}()]|\*\*|```|`|</?[a-z]+>")
_PAIRS = {"\\]": "\\[", "\\)": "\\(", "}": "{", ")": "("}
_STOPS = ".。!?)"

#: Kinds of ends with the log-likelihood ratio of a cut.  What a cut is by its meaning (inside a word, sentence, expression or mark) and
#: what is none (after a whole final statement) is rated beyond what length and finish reason can weigh; the others are for those to decide.
KINDS = {
    "bare": -20.0,  # a number and nothing else
    "mark": -20.0,  # a closed mark (box, hash line, bold, label) at the end
    "mark_remark": -20.0,  # ... and whole sentences after it
    "mark_closing": -12.0,  # ... and a short remark without a stop, the result being told twice or without steps before it
    "mark_single": 5.0,  # ... and a remark without a stop after a result told once in mid calculation
    "mark_clause": 1.5,  # ... and a clause that goes on from it without a stop
    "mark_run_on": 8.0,  # ... and a long one
    "mark_again": 20.0,  # ... and a second statement that has begun
    "mark_steps": 20.0,  # ... and further calculation
    "mark_prefix": 8.0,  # the number in it is the beginning of the last one
    "mark_open": 20.0,  # a delimiter around or after it stands open
    "said_stop": -20.0,  # a whole sentence tells the result
    "said": -2.0,  # ... without its stop, the result being told twice or without steps
    "said_closing": -12.0,  # ... and a remark without a stop
    "said_single": 8.0,  # ... after a result told once in mid calculation
    "said_once": 5.0,  # ... without its stop, told once, in mid calculation
    "said_prefix": 8.0,  # ... without its stop, its number none of those before it
    "said_steps": 20.0,
    "said_again": 20.0,
    "restated": -3.0,  # the last whole sentence repeats the number before it
    "whole": 8.0,  # a whole sentence, no result
    "open": 20.0,  # no result, a delimiter stands open
    "inside": 20.0,  # no result, ends inside a sentence
}
#: Kinds of ends at which a result is stated.
TOLD = frozenset(("bare", "mark", "mark_remark", "mark_closing", "mark_clause", "said_stop", "said", "said_closing", "restated"))


@dataclass(frozen=True)
class Ending:
    """The kind of an end, and the place of the last statement of a result (-1 without one); ``notation``: a mark, no sentence."""

    kind: str
    start: int = -1
    end: int = -1
    notation: bool = False

    @property
    def told(self) -> bool:
        return self.kind in TOLD


_named = ahocorasick.Automaton()
for _w in RESULT_WORDS:
    _named.add_word(_w, len(_w))
_named.make_automaton()


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def visible(text: str | None) -> str:
    return _BLANK.sub(" ", text or "").strip()


def unclosed(text: str) -> list[tuple[str, int]]:
    """The delimiters that stand open at the end of a text, with their places.

    A stack: closers without an opener are no evidence; a ``$`` before a digit is
    money unless one that closes it follows on its line.
    """
    stack: list[tuple[str, int]] = []
    for m in _DELIMITERS.finditer(text):
        d = m.group()
        if d in _PAIRS or d.startswith("</"):
            opener = _PAIRS.get(d) or "<" + d[2:]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == opener:
                    del stack[i:]
                    break
        elif d in ("$", "$$", "**", "`", "```"):
            at = next((i for i, (o, _) in enumerate(stack) if o == d), -1)
            if at >= 0:
                del stack[at:]
            elif d != "$" or not _money(text, m.end()):
                stack.append((d, m.start()))
        elif d[0] != "\\" or d in ("\\[", "\\("):
            stack.append((d, m.start()))
    return stack


def _money(text: str, at: int) -> bool:
    if not text[at : at + 1].isdigit():
        return False
    line = text.find("\n", at)
    close = text.find("$", at, line if line >= 0 else len(text))
    return close < 0 or text[close - 1].isspace() or text[close + 1 : close + 2].isdigit()


def _box(s: str) -> tuple[int, int, str] | None:
    """The last balanced, non-empty box."""
    at = len(s)
    while (at := max(s.rfind("\\boxed", 0, at), s.rfind("\\fbox", 0, at))) >= 0:
        m = _BOX.match(s, at)
        if m:
            depth, i = 1, m.end()
            while i < len(s) and depth:
                c = s[i]
                i += 2 if c == "\\" else 1
                depth += (c == "{") - (c == "}")
            if not depth and s[m.end() : i - 1].strip():
                return at, i, s[m.end() : i - 1]
    return None


def _statement(s: str) -> tuple[int, int, str, bool, bool] | None:
    """(start, end, value, is a sentence, has its stop) of the last statement of a result."""
    best = None
    if "\\boxed" in s or "\\fbox" in s:
        best = _box(s)
    for sign, pattern in (("####", _HASH), ("**", _BOLD)):
        if sign in s:
            for m in pattern.finditer(s):
                if best is None or m.end() > best[1]:
                    best = (m.start(), m.end(), m[1])
    low = lowered(s)
    places = [last - n + 1 for last, n in _named.iter(low)]
    for at in reversed(places):
        if (m := _LABEL.match(s, at)) is not None:
            if best is None or m.end() > best[1]:
                best = (at, m.end(), m["num"])
            break
    found = (*best, False, True) if best else None
    after = best[1] if best else 0
    for at in reversed(places):
        if at < after:
            break
        if (m := _SENTENCE.match(s, at)) is not None:
            return at, m.end(), m["num"], True, m["stop"] is not None
    return found


def _digits(number: str) -> str:
    return "".join(c for c in number if c.isdigit())


def _number_before(before: str) -> str:
    last = None
    for last in _NUMBERS.finditer(before):
        pass
    return _digits(last.group()) if last else ""


def ending(text: str | None) -> Ending:
    s = (text or "").rstrip()
    if not s:
        return Ending("inside")
    if _BARE.fullmatch(s):
        return Ending("bare")
    found, hanging = _statement(s), unclosed(s)
    if found is None:
        return Ending("open" if hanging else _restated(s))
    start, end, value, sentence, stopped = found
    return Ending(_kind(s, start, end, value, sentence, stopped, [d for d, _ in hanging]), start, end, not sentence)


def _kind(s: str, start: int, end: int, value: str, sentence: bool, stopped: bool, hanging: list[str]) -> str:
    family = "said" if sentence else "mark"
    if hanging and not sentence:
        return "mark_open"
    before, tail = s[:start], s[end:].strip()
    words = tail.lstrip("\\])$}`*.。!,;: \n\t")
    if _STEPS.search(tail) or tail[-1:].isdigit():
        return family + "_steps"
    number = _digits((_NUMBERS.findall(value) or [""])[-1])
    if not sentence:
        if end == len(s) and value[-1:].isdigit():
            last = _number_before(before)
            if number != last and last.startswith(number):
                return "mark_prefix"
        if not words:
            return "mark"
    if tail and tail[-1] not in _STOPS:
        if _MARKUP.search(words):
            return family + "_again"
        first = _SENTENCES.split(words, maxsplit=1)[0]
        if not sentence and first[:1].islower() and (n := len(first.split())) > 3 and tail[:1] not in ".\n":
            return "mark_clause" if n <= 8 else "mark_run_on"
        return f"{family}_closing" if _sure(before, number) else f"{family}_single"
    if sentence and not stopped and not tail:
        if hanging:
            return "open"
        if _sure(before, number):
            return "said"
        return "said_once" if number in map(_digits, _NUMBERS.findall(before)) else "said_prefix"
    if sentence:
        return "said_stop"
    return "mark_remark" if words else "mark"


def _sure(before: str, number: str) -> bool:
    """Whether nothing was calculated before a statement, or the sentence before it tells the same number."""
    if not _STEPS.search(before):
        return True
    return number == _number_before(before) and _tells([p for p in _SENTENCES.split(before) if p.strip()], number)


def _tells(head: list[str], number: str) -> bool:
    """Whether the last whole sentence of ``head`` tells this number without calculating it."""
    whole = head if head[-1][-1:] in ".。!" else head[:-1]
    found = list(_NUMBERS.finditer(whole[-1])) if whole else []
    if not found or _digits(found[-1].group()) != number:
        return False
    return not any(_digits(m.group()) == number and whole[-1][: m.start()].rstrip().endswith("=") for m in found)


def _restated(s: str) -> str:
    """No known mark: a whole last sentence that repeats the number before it tells a result too."""
    if s[-1] in ".。!" and not s.endswith("..."):
        parts = [p for p in _SENTENCES.split(s) if p.strip()]
        numbers = _NUMBERS.findall(parts[-1])
        if len(parts) > 1 and len(numbers) == 1 and not _STEPS.search(parts[-1]):
            before = _NUMBERS.findall(parts[-2])
            if before and _digits(before[-1]) == _digits(numbers[-1]):
                return "restated"
        return "whole"
    return "inside"
