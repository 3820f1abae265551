"""Refusals: an automaton of first-person frames, each with what must follow it in its sentence.

A frame is the beginning of a clause in which the speaker declines ("i cannot",
"ich möchte", "je ne peux").  The automaton finds all frames of a text in one
pass; a frame counts if the rest of its sentence has what its language needs to
make it a refusal: a negation where the frame has none.  Frames are first person
singular, so "we cannot have more than 7" is none.
"""

from __future__ import annotations

import re

import ahocorasick

# Clause beginnings that decline by themselves, lower case, with plain apostrophes.
DECLINING = (
    "i am unable", "i'm unable", "i can't", "i cannot", "i can not", "i won't", "i will not", "i would not", "i wouldn't", "i must not", "i may not", "i'm not able", "i am not able",
    "i'm not allowed", "i am not allowed", "i am not permitted", "i'm not permitted", "i am not comfortable", "i'm not comfortable", "i am not willing", "i'm not willing", "i am unwilling",
    "i'm unwilling", "i am not going to", "i'm not going to", "i am not in a position", "i'm not in a position", "i don't feel comfortable", "i do not feel comfortable", "i'd rather not", "i would rather not", "i prefer not", "i'd prefer not",
    "i must decline", "i have to decline", "i decline", "i refuse", "i must refuse", "i have to refuse", "i need to decline", "as an ai", "as a language model", "as an assistant, i",
    "prevents me from", "prevent me from", "forbids me", "forbid me", "keeps me from", "keep me from", "not appropriate for me", "not be appropriate for me", "off limits for me", "is off limits", "are off limits",
    "against my guidelines", "against my policy", "against my rules", "outside of what i may", "outside of what i can", "outside what i can", "beyond what i may", "beyond what i can",
    "als ki-modell", "als sprachmodell", "als ki-assistent", "ich bin nicht in der lage", "ich muss ablehnen", "muss ich ablehnen", "ich lehne", "ich weigere mich", "ist mir nicht erlaubt", "ist mir nicht gestattet", "ist mir nicht möglich",
    "en tant que modèle", "en tant qu'ia", "il m'est impossible", "il ne m'est pas", "je refuse", "je dois refuser", "je dois décliner", "je préfère ne pas", "je préférerais ne pas", "je regrette de ne pas",
    "como modelo de lenguaje", "no me es posible", "no me está permitido", "prefiero no", "preferiría no", "debo rechazar", "debo declinar", "me niego a",
    "come modello linguistico", "mi rifiuto", "preferisco non", "non mi è possibile", "non mi è permesso", "como modelo de linguagem", "prefiro não", "recuso-me", "não me é possível", "não me é permitido",
    "не могу", "не смогу", "не буду", "не имею права", "не в состоянии", "отказываюсь", "вынужден отказать", "вынуждена отказать", "как языковая модель", "als taalmodel", "jako model językowy",
    "我无法", "我不能", "我不会回答", "抱歉，我", "作为语言模型", "作为人工智能", "无法回答", "お答えできません", "回答できません", "申し訳ありませんが", "답변할 수 없", "도와드릴 수 없",
)
# First-person clause beginnings that decline with a negation behind them.
NEGATED = {
    "de": ("kann ich", "ich kann", "darf ich", "ich darf", "möchte ich", "ich möchte", "werde ich", "ich werde", "ich will", "will ich", "möchte auf", "ich würde", "würde ich", "ich sollte", "ich fühle mich"),
    "fr": ("je ne peux", "je ne pourrai", "je ne veux", "je ne vais", "je ne souhaite", "je ne suis", "je ne saurais", "je ne dois", "je n'ai", "je ne répondrai", "je ne donnerai"),
    "es": ("no puedo", "no podré", "no debo", "no quiero", "no voy a", "no deseo", "no estoy autorizad", "no estoy en condiciones", "no soy capaz", "no sabría"),
    "it": ("non posso", "non potrò", "non voglio", "non intendo", "non sono in grado", "non sono autorizzat", "non devo"),
    "pt": ("não posso", "não poderei", "não consigo", "não quero", "não vou", "não devo", "não sou capaz", "não estou autorizad"),
    "nl": ("ik kan", "kan ik", "ik mag", "ik wil"),
    "pl": ("nie mogę", "nie jestem w stanie", "nie wolno mi"),
}
_NEGATION = {"de": re.compile(r"\b(?:nicht|nichts|kein\w*|ungern|weder)\b"), "fr": re.compile(r"\b(?:pas|rien|aucun\w*|plus|point)\b"), "nl": re.compile(r"\b(?:niet|niets|geen)\b")}
_STOP = re.compile(r"[.!?;\n。！？]")

_frames = ahocorasick.Automaton()
for _p in DECLINING:
    _frames.add_word(_p, (len(_p), None))
for _lang, _phrases in NEGATED.items():
    for _p in _phrases:
        _frames.add_word(_p, (len(_p), _NEGATION.get(_lang)))
_frames.make_automaton()


def refusal_at(text: str) -> int:
    """Where the first refusal of a text begins, -1 without one."""
    low = text.lower().replace("’", "'").replace("‘", "'")
    best = -1
    for last, (n, negation) in _frames.iter(low):
        start = last - n + 1
        if 0 <= best <= start or start and low[start - 1].isalpha() and low[start - 1].isascii():
            continue
        if negation is not None:
            stop = _STOP.search(low, last + 1)
            if not negation.search(low, last + 1, stop.start() if stop else len(low)):
                continue
        best = start
    return best


def declines(text: str) -> bool:
    return refusal_at(text) >= 0
