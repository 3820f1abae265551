"""Garbled text from wrong character encodings.

Garbled sequences are precomputed for all encodings that UTF-8 is taken for.  Of
every character outside ASCII, whatever its script, the first two bytes are the
*head* of its sequence; a multi-pattern automaton finds all heads under all
encodings.  From a head on, a run of sequences under one encoding is taken back to
bytes and read as UTF-8, twice where the result is garbled again.  A run counts if
its bytes are valid to the end and the characters are of one script.  Single
two-byte characters, and what decoders leave that replace or drop undefined bytes,
are in a second table of whole sequences, once and twice, over an alphabet; matches
that fit legitimate text are dropped.  Only matched spans are replaced, so correct
text around them stays, and only by what gives the seen sequence again; where
several characters do, the span counts as lost.

Between single-byte encodings one character becomes one character, which only
context can tell: for Cyrillic the letter frequencies of a line under each pair of
encodings, for Latin letters that stand inside words as signs or foreign letters.

Replacement characters and C1 control characters are traces of wrong decoding too,
the former without a way back.  Null and empty texts have none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings by the codec names of the standard library.
RUN_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "koi8-u", "cp866", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15", "cp1253", "cp1254", "cp1257", "mac_cyrillic", "mac_latin2", "cp852", "cp855")
#: Encodings of two bytes a character that UTF-8 is taken for.
WIDE_AS = ("gbk", "cp932", "big5", "euc_kr")
UTF8_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-15", "cp1254", "cp1257", "mac_cyrillic")
TWICE_AS = UTF8_AS
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
CYRILLIC_AS = ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "cp437", "cp850", "mac_roman", "cp1250")
LATIN, LATIN_AS = ("cp1252", "mac_roman", "cp437", "cp850"), ("cp1252", "cp1251", "koi8-r", "cp437", "cp850", "mac_roman", "cp866", "cp1250", "iso8859-5", "mac_cyrillic")
# Characters outside ASCII that texts of the covered languages use.
LETTERS = "".join(map(chr, range(0xC0, 0x100))) + "ŒœŠšŽžŸłŁśŚżŻńŃęĘąĄćĆźŹčČřŘůŮőŐűŰğĞşŞı"
MARKS = "¡¢£¤¥§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿\xa0\xad–—―‑‘’‚“”„†‡•…‰′″‹›€™−√∞≈≠≤≥∆∑∫∂∏⁻⁰⁴⁵⁶⁷⁸⁹←→↑↓≡∈∅∪∩✓№ﬁﬂ    ​ ﻿"
CYRILLIC_LETTERS = "".join(map(chr, range(0x410, 0x450))) + "Ёё"
GREEK = "αβγδεζηθικλμνξοπρστυφχψωΓΔΘΛΞΠΣΦΨΩ"
BOXES = "─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬█▓▒░■●"
#: Letters of Russian by falling frequency.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
#: Letters that single-byte mix-ups between Latin encodings are undone to.
COMMON = frozenset("äöüßÄÖÜéèêëàâáãåçñóòôõíìîïúùûœæøÉÈÀÇÑÓÁÍÚÊÂÔÃÕ")

_QUOTES_OPEN, _QUOTES_CLOSE = "“„«‘‚‹\"'([", "”“’»›\"'"


@lru_cache(maxsize=None)
def _characters(encoding: str) -> tuple[tuple[str, bool], ...]:
    """(character, whether it is undefined) of every byte."""
    out = []
    for byte in range(256):
        try:
            out.append((bytes([byte]).decode(encoding), False))
        except UnicodeDecodeError:
            out.append((chr(byte), True))
    return tuple(out)


@lru_cache(maxsize=None)
def _lenient(encoding: str) -> tuple[str, ...]:
    return tuple(c for c, _ in _characters(encoding))


def decode(raw: bytes, encoding: str, lost: str | None = None) -> str | None:
    """Like a lenient decoder: undefined bytes become C1 controls, or ``lost``; None if there are none and ``lost`` was asked for."""
    if lost is None:
        return "".join(map(_lenient(encoding).__getitem__, raw))
    found = [_characters(encoding)[byte] for byte in raw]
    gone = [undefined or "\x80" <= c <= "\x9f" for c, undefined in found]
    return "".join(lost if g else c for (c, _), g in zip(found, gone)) if any(gone) else None


def sequences() -> dict[str, tuple[str, str]]:
    """garbled sequence -> (original character, name of the wrong decoding); the commonest decodings first."""
    table: dict[str, tuple[str, str]] = {}
    lossy: dict[str, set[str]] = {}
    alphabet = LETTERS + MARKS + CYRILLIC_LETTERS + GREEK + BOXES

    def put(seq: str | None, c: str, name: str) -> None:
        if seq and len(seq) > 1 and seq != c and not seq.isascii():
            table.setdefault(seq, (c, name))

    once = {(c, w): decode(c.encode(), w) for w in UTF8_AS for c in alphabet}
    for w in UTF8_AS:
        for c in alphabet:
            put(once[c, w], c, w)
    for w in TWICE_AS:
        for v in TWICE_AS:
            for c in alphabet:
                put(decode(once[c, w].encode(), v), c, f"{w}+{v}")
    for w in UTF8_AS[:3]:
        for c in alphabet:
            for seq, name in ((decode(c.encode(), w, "�"), f"{w}?"), (decode(c.encode(), w, "") if len(c.encode()) == 3 else None, f"{w}-")):
                if seq:
                    lossy.setdefault(seq, set()).add(c)
                    put(seq, c, name)
    return {seq: ("" if name[-1] in "?-" and len(lossy[seq]) > 1 else c, name) for seq, (c, name) in table.items()}


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    text: str
    name: str


_TABLE = sequences()
_automaton = ahocorasick.Automaton()
for _seq, (_c, _name) in _TABLE.items():
    _automaton.add_word(_seq, (len(_seq), _c, _name))
_automaton.make_automaton()


def _byte_tables() -> dict[str, dict[str, int]]:
    """encoding -> character -> byte, for the bytes of UTF-8 sequences; undefined ones as the C1 controls that lenient decoders give."""
    return {w: {decode(bytes([b]), w): b for b in range(0x80, 0xF5)} for w in RUN_AS}


_BYTES = _byte_tables()


def _heads() -> dict[str, list[str]]:
    """The head of every garbled sequence -> the encodings under which it is one.

    A head is the first two characters, or three where the first two are letters that words of another encoding are full of.
    """
    heads: dict[str, list[str]] = {}
    for w, table in _BYTES.items():
        of = {b: c for c, b in table.items()}
        for lead in range(0xC2, 0xF5):
            for follow in range(0x80, 0xC0):
                if lead in of and follow in of:
                    head = of[lead] + of[follow]
                    more = [of[x] for x in range(0x80, 0xC0) if x in of] if lead >= 0xE0 and head.isalpha() and head.islower() else [""]
                    for x in more:
                        heads.setdefault(head + x, []).append(w)
    return heads


_head_automaton = ahocorasick.Automaton()
for _seq, _names in _heads().items():
    _head_automaton.add_word(_seq, (len(_seq), tuple(_names)))
_head_automaton.make_automaton()
_CYRILLIC_AS_RUN = frozenset(("cp1251", "koi8-r", "koi8-u", "cp866", "iso8859-5", "mac_cyrillic", "cp855"))
_GREEK_AS_RUN = frozenset(("iso8859-7", "cp1253"))


def _read(text: str, at: int, table: dict[str, int]) -> tuple[int, str]:
    """(end, characters) of the run of whole UTF-8 sequences from ``at`` on."""
    out, i = [], at
    while i < len(text):
        lead = table.get(text[i], 0)
        n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        raw = [lead, *[table.get(c, 0) for c in text[i + 1 : i + n]]] if n else []
        if not n or len(raw) < n:
            break
        try:
            out.append(bytes(raw).decode("utf-8"))
        except UnicodeDecodeError:
            break
        i += n
    return i, "".join(out)


def _script(c: str) -> str:
    """A rough name of a character's script; '' for marks, digits and pictures."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").split(" ", 1)[0]
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "FULLWIDTH": "CJK", "MICRO": "", "MODIFIER": "", "SUPERSCRIPT": "", "DOUBLE-STRUCK": ""}.get(name, name)


def _plausible(seen: str, meant: str, encoding: str) -> bool:
    """Whether a run means text: known characters of one script, and more than legitimate text has by chance."""
    if any("\u0300" <= c <= "\u036f" or unicodedata.category(c) in ("Cn", "Co", "Cs") for c in meant):
        return False
    scripts = {x for c in meant if (x := _script(c))}
    if len(scripts) > 1:
        return False
    if all("\u2500" <= c <= "\u259f" for c in seen):
        return False  # a drawing
    foreign = scripts - {"LATIN", "CYRILLIC", "GREEK"}
    wide = len(seen) - 2 * len(meant)  # characters of three bytes and more count double
    weight = len(meant) + max(wide, 0)
    letters = sum(c.isalpha() for c in seen)
    if encoding in _CYRILLIC_AS_RUN and letters == len(seen) and all("\u0400" <= c <= "\u04ff" for c in seen) or encoding in _GREEK_AS_RUN and all("\u0370" <= c <= "\u03ff" for c in seen):
        return weight >= 4
    weight += sum("\x80" <= c <= "\x9f" for c in seen)  # controls are no text
    return weight >= (6 if "CJK" in foreign or "HANGUL" in foreign else 4 if foreign else 2)


#: What may stand next to a garbled run though it is outside ASCII.
_BESIDE = frozenset("\xa0“”„«»‘’‚‹›–—…�。、，！？：；")


def _goes_on(text: str, start: int, end: int) -> bool:
    """Whether a character outside ASCII stands next to a run: then it may be a part of something else."""
    return any(c > "\x7f" and c not in _BESIDE for c in (text[start - 1 : start], text[end : end + 1]))


def _known(meant: str) -> bool:
    return not any("\u0300" <= c <= "\u036f" or unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc") for c in meant)


def run_spans(text: str, prefer: str | None = None, inner: str | None = None, scripts: frozenset[str] = frozenset()) -> list[Span]:
    """Runs of garbled UTF-8 of any script; ``prefer`` and ``inner`` are the outer and inner encoding that the rest of the text shows, ``scripts`` its scripts."""
    out: list[Span] = []
    at = 0
    refused: dict[str, int] = {}  # up to where a run was read in vain: what is inside it isn't read again, which keeps the search linear
    for last, (n, names) in _head_automaton.iter(text):
        start = last - n + 1
        if start < at or prefer is None and start and start != at and (c := text[start - 1]) > "\x7f" and c not in _BESIDE:
            continue
        best: tuple[int, str, str] | None = None
        if prefer in names:
            end, meant = _read(text, start, _BYTES[prefer])
            if meant and (inner or _known(meant) and all(x in scripts for c in meant if (x := _script(c)))):
                best = (end, meant, prefer)
        for name in names if best is None else ():
            if start < refused.get(name, 0):
                continue
            end, meant = _read(text, start, _BYTES[name])
            refused[name] = end
            if meant and (best is None or end > best[0]) and not _goes_on(text, start, end) and _plausible(text[start:end], meant, name):
                best = (end, meant, name)
        if best is None:
            continue
        end, meant, name = best
        # garbled twice? a sequence has two characters at least
        again = [] if len(meant) < 2 else run_spans(meant, inner, None, scripts) if inner else utf8_found(meant)
        if again and sum(x.end - x.start for x in again) * 2 > len(meant):
            meant, name = restored(meant, again), f"{again[0].name}+{name}"
        elif not _known(meant):
            continue
        out.append(Span(start, end, meant, name))
        at = end
    return out


def _blanked(text: str, found: list[Span]) -> str:
    if not found:
        return text
    chars = list(text)
    for s in found:
        chars[s.start : s.end] = " " * (s.end - s.start)
    return "".join(chars)


def utf8_found(text: str) -> list[Span]:
    """Garbled UTF-8: runs and single sequences.  The encoding that most of it shows is then tried first everywhere."""
    found = run_spans(text)
    found += utf8_spans(_blanked(text, found))
    if not found:
        return found
    own = Counter({name: 0 for name in RUN_AS})
    for s in found:
        own[s.name.rstrip("?-")] += s.end - s.start
    twice = any(own[n] for n in own if "+" in n)
    every: Counter[str] = Counter()  # also those that explain a sequence another way
    until: dict[str, int] = {}
    for last, (n, names) in _head_automaton.iter(text):
        start = last - n + 1
        for name in names:
            if start >= until.get(name, 0):
                end, meant = _read(text, start, _BYTES[name])
                until[name] = max(end, start + 1)
                if meant and (twice or _known(meant)):
                    every[name] += end - start
    name = max(own, key=lambda n: (every[n.rpartition("+")[2]], own[n], -len(n)))
    inner, _, outer = name.rpartition("+")
    scripts = frozenset(x for s in found for c in s.text if (x := _script(c))) | {"LATIN"}
    found = run_spans(text, outer, inner or None, scripts)
    return found + utf8_spans(_blanked(text, found))


_WIDE_RUN = re.compile(r"[^\x00-\x7f]{4,}")


def wide_spans(text: str) -> list[Span]:
    """Runs of UTF-8 that were read as an encoding of two bytes a character."""
    out = []
    for m in _WIDE_RUN.finditer(text):
        for name in WIDE_AS:
            try:
                meant = m.group().encode(name).decode("utf-8")
            except UnicodeError:
                continue
            if len(meant) >= 3 and meant != m.group() and _plausible(m.group() * 2, meant, name):
                out.append(Span(m.start(), m.end(), meant, name))
                break
    return out


def _longest(text: str) -> list[Span]:
    """Non-overlapping matches, from the left, longest first."""
    best: dict[int, Span] = {}
    for last, (n, c, name) in _automaton.iter(text):
        start = last - n + 1
        if start not in best or best[start].end < last + 1:
            best[start] = Span(start, last + 1, c, name)
    out, at = [], 0
    for start in sorted(best):
        if start >= at:
            out.append(best[start])
            at = best[start].end
    return out


def _is_letter(c: str) -> bool:
    return c.isalpha()


def _legitimate(text: str, span: Span, alone: bool) -> bool:
    """Whether a match may as well be what the author wrote."""
    seq = text[span.start : span.end]
    before, after = text[span.start - 1 : span.start], text[span.end : span.end + 1]
    if any("\x80" <= c <= "\x9f" or c == "�" for c in seq):
        return False
    if len(seq) == 2 and seq[1] in _QUOTES_CLOSE and seq[0].isalpha():
        if before and before in _QUOTES_OPEN:
            return True  # a quoted letter
        if before.isalpha() and before.isupper() and not after.isalpha():
            return True  # the last letter of a quoted word in capitals
    if alone and before.isdigit() and any("Ѐ" < c <= "ӿ" and c not in CYRILLIC_LETTERS for c in seq):
        return False
    if alone and all("Ѐ" <= c <= "ӿ" for c in seq):
        return not (before.isascii() and before.isalpha() or after.isascii() and after.isalpha())
    if alone and (span.text in CYRILLIC_LETTERS or span.text in GREEK and seq[0] in "Οο"):
        return True  # letters of these scripts come in words
    if alone and seq[0].isalpha() and seq[1:].isalpha() and seq[0] < "ɐ" and len(seq) == 2:
        # two letters of Latin script: a legitimate pair, unless the case is odd
        return not (seq[0].isupper() and seq[1].islower() and before.isalpha() and before.islower()) and seq[0] not in "ÃÂĂ"
    return False


def utf8_spans(text: str) -> list[Span]:
    found = _longest(text)
    if not found:
        return []
    kept = []
    for i, span in enumerate(found):
        alone = not (i and found[i - 1].end == span.start or i + 1 < len(found) and found[i + 1].start == span.end)
        if not _legitimate(text, span, alone):
            kept.append(span)
    return kept


_RANK = {c: math.log(1.0 / (i + 2.0)) for i, c in enumerate(RUSSIAN)}
_FLOOR = math.log(1.0 / 400.0)
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def _mapping(src: str, wrong: str) -> dict[str, str]:
    out = {}
    for byte in range(0x80, 0x100):
        try:
            seen, meant = decode(bytes([byte]), wrong), bytes([byte]).decode(src)
        except UnicodeDecodeError:
            continue
        if seen and seen != meant:
            out[seen] = meant
    return out


_CYRILLIC_MAPS = {f"{s}>{w}": _mapping(s, w) for s in CYRILLIC for w in CYRILLIC_AS if s != w}
_LATIN_MAPS = {f"{s}>{w}": {a: b for a, b in _mapping(s, w).items() if b in COMMON} for s in LATIN for w in LATIN_AS if s != w}


def _likelihood(chars: str) -> float:
    return sum(_RANK.get(c.lower(), _FLOOR) for c in chars)


def _cased(word: str) -> bool:
    """Lower case, capitalised or all capitals, as words of a text are."""
    return word[1:].islower() or len(word) < 2 or word.isupper()


_LONG_FOREIGN = re.compile(r"[^\x00-\x7f]{3}")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def cyrillic_spans(text: str) -> list[Span]:
    """Sentences whose characters read as Russian only under another pair of single-byte encodings."""
    out, at = [], 0
    if not _LONG_FOREIGN.search(text):
        return out  # no sentence has the run of three that it takes
    for gap in [*_SENTENCE_END.finditer(text), None]:
        end = gap.start() if gap else len(text)
        sentence = text[at:end]
        runs = [m for m in _FOREIGN.finditer(sentence) if any(c.isalpha() for c in m.group())]
        if sum(len(m.group()) for m in runs) >= 6 and max(len(m.group()) for m in runs) >= 3:
            found = _best_pair([m for m in runs if len(m.group()) > 1], runs)
            if not found:  # perhaps only a part of the sentence, told by its odd capitals
                odd = [k for k, m in enumerate(runs) if len(m.group()) > 2 and (m.group().isupper() or not _cased(m.group()))]
                part = runs[odd[0] : odd[-1] + 1] if odd else []
                if sum(len(m.group()) for m in part) >= 6 and len(part) < len(runs):
                    found = _best_pair([m for m in part if len(m.group()) > 1], part)
            out += [Span(at + s, at + e, t, n) for s, e, t, n in found]
        at = gap.end() if gap else end
    return out


def _best_pair(words: list[re.Match], runs: list[re.Match]) -> list[tuple[int, int, str, str]]:
    seen = "".join(m.group() for m in words)
    before = _likelihood(seen)
    if before / len(seen) > -2.2:
        return []  # it reads as Russian already
    best, best_score = None, before + 0.25 * len(seen)
    for name, table in _CYRILLIC_MAPS.items():
        meant = ["".join(table.get(c, c) for c in m.group()) for m in words]
        score = _likelihood("".join(meant))
        letters = ["".join(c for c in w if c.isalpha()) for w in meant]
        if score > best_score and score / len(seen) > -2.7 and sum(map(_cased, letters)) >= 0.8 * len(letters):
            best, best_score = (name, table), score
    if best is None:
        return []
    return [(m.start(), m.end(), "".join(best[1].get(c, c) for c in m.group()), best[0]) for m in runs]


#: Inside a word, inside one in capitals, at its end, at its start.
_ODD = re.compile(r"(?<=[a-zß-ÿ])([^\x00-\x7fß-ÿœ\u2010-\u201f…])(?=[a-z])|(?<=[A-ZÀ-Þ])([^\x00-\x7fÀ-Þß-ÿŒŠŽŸŁŚŻŃĘĄĆŹČŘŮŐŰĞŞİ\u2010-\u201f…·])(?=[A-ZÀ-Þ])|(?<=[a-z])([Ѐ-ӿ])(?!\w)|(?<!\w)([^\x00-\x7f])(?=[a-z]{2})")
_STARTS = frozenset(LETTERS + "“”„«»¿¡‘’‚‹›–—―…·×÷−€£¥±√≈≥≤≠²³•°*└├│─→©®™¶§")
#: What is left of a quotation mark, dash or sign in UTF-8 whose controls were dropped.
_LEFT_OVER = re.compile(r"ââ+|(?<=[a-z])â(?![\w])|(?<=n)â(?=t\b)|(?<![\w“\"'„«(])â(?![\w”\"'“»)])|(?<=[a-z])â(?=s\b)")


def latin_spans(text: str) -> list[Span]:
    """Signs, capitals and foreign letters inside Latin words that are letters under another pair of encodings; a pair counts if it explains two words."""
    odd = [(m.start(), m.group()) for m in _ODD.finditer(text) if not (m.lastindex == 4 and m.group() in _STARTS) and m.group() not in "\xad·"]
    if len(odd) < 2:
        return []
    best: tuple[int, str] | None = None
    for name, table in _LATIN_MAPS.items():
        n = sum(1 for _, c in odd if c in table and _fits(table[c]))
        if n >= 2 and n >= 0.6 * len(odd) and (best is None or n > best[0]):
            best = (n, name)
    return [Span(i, i + 1, _LATIN_MAPS[best[1]][c], best[1]) for i, c in odd if c in _LATIN_MAPS[best[1]]] if best else []


def _fits(c: str) -> bool:
    return c.islower() or c.isupper()


_TRACES = re.compile("[�\x80-\x9f]")


def spans(text: str | None) -> list[Span]:
    """Every garbled span with what it meant; '' where that is lost."""
    if not text or text.isascii():
        return []
    found, rest = [], text
    for search in (utf8_found, wide_spans):
        new = search(rest)
        found += new
        rest = _blanked(rest, new)
    more = cyrillic_spans(rest) + latin_spans(rest)
    found += more
    rest = _blanked(rest, more)
    left = list(_LEFT_OVER.finditer(rest))
    if len(left) > 1 or left and found:
        lost = [Span(m.start(), m.end(), "", "lost") for m in left]
        found += lost
        rest = _blanked(rest, lost)
    found += [Span(m.start(), m.end(), "", "lost") for m in _TRACES.finditer(rest)]
    return sorted(found, key=lambda s: (s.start, s.end))


def restored(text: str, found: list[Span]) -> str:
    """The text with every span replaced by what it meant; lost ones stay as they are."""
    out, at = [], 0
    for s in found:
        if s.start >= at and s.text:
            out += [text[at : s.start], s.text]
            at = s.end
    return "".join([*out, text[at:]])


_OUT = pa.schema([("doc_id", pa.int64()), ("encoding", pa.string()), ("n_spans", pa.int32()), ("n_lost", pa.int32()), ("restored", pa.string())])


def garbled(documents: DataFrame) -> DataFrame:
    """(doc_id, encoding, n_spans, n_lost, restored) for each garbled document.

    ``encoding`` is the wrong decoding of most spans, ``n_lost`` counts those
    without a way back.  Repeated rows count once; of rows with one doc_id and
    different texts the least result counts.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if found := spans(text):
                    names = Counter(s.name for s in found)
                    name = min(names, key=lambda n: (n == "lost", -names[n], n))
                    rows.append((doc, name, len(found), names["lost"], restored(text, found)))
            columns = zip(*rows) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    # texts of ASCII alone never reach Python
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") > F.length("text"))
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, encoding string, n_spans int, n_lost int, restored string")
    return found.groupBy("doc_id").agg(F.min(F.struct("encoding", "n_spans", "n_lost", "restored")).alias("r")).select("doc_id", "r.*")
