"""Language of a text by stopword votes of its sentences.

Scripts that one language mainly uses vote for it directly.  A word votes with
one over the number of languages that list it.
"""

from __future__ import annotations

import re
from collections import Counter

# Frequent function and connecting words by language.
STOPWORDS = {
    "en": "the of and to in is we you that it for on with as are this was be have from or by not what which there then here has can so at an do does did will would how many much each all more than they he she let us our first next if therefore must means answer result now where while his her its their only when about no nothing plus equals together again these",
    "de": "der die das und ist in zu den dem des wir sie ein eine einen einem einer nicht von mit auf für im sich es auch als an nach wie aus bei also dann dass sind hat haben wird werden noch nur über um am bis durch zum zur ich er man uns damit so wenn aber wurde kann ergibt ergebnis antwort gilt pro jede jeden jeder wie viele schritt zuerst",
    "fr": "le la les de des du et est un une en que qui dans pour pas sur au aux avec ce cette ces nous vous il elle ils on se sa son ses par plus ne ou où donc ainsi cela ça sont a à été être avoir fait puis ensuite comme chaque tout tous combien quelle quel résultat réponse il y",
    "es": "el la los las de del y en que es un una por con para se no al lo su sus como más pero o este esta estos son ha fue ser está hay nos le les cada todo todos cuántos cuántas cuánto qué cuál entonces luego así ahora primero resultado respuesta obtenemos tenemos eso sobre muy ya también a hace desde cuando hasta entre tiene hay así donde sin vamos",
    "it": "a il lo la i gli le di del della dei delle e è in che un una per con non si da al alla nel nella sono ha come più anche ma o questo questa ci quindi poi allora ogni abbiamo risultato risposta dal dalla ora prima quanti quante quanto",
    "pt": "o a os as de do da dos das e em no na nos nas que é um uma por para com não se ao à mais como mas ou este esta são foi ser está há ele ela seu sua então depois assim cada resultado resposta temos obtemos quantos quantas quanto você também já muito",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog naar door over wij we hij zij ze dus heeft hebben wordt elke per hoeveel antwoord resultaat eerst",
    "pl": "i w na z do się nie to jest że o jak po co za od przez dla są ale czy ma więc czyli każdy każda ile wynik odpowiedź mamy potem najpierw zatem",
    "sv": "och i att det som en på är av för med den till inte om ett var har vi men så från ut när kan eller hur många svaret varje sedan då",
    "tr": "ve bir bu da de için ile olarak çok daha ne kadar kaç sonra önce her cevap sonuç toplam olur göre",
}
SCRIPTS = (("ru", "Ѐ", "ӿ"), ("el", "Ͱ", "Ͽ"), ("he", "֐", "׿"), ("ar", "؀", "ۿ"), ("hi", "ऀ", "ॿ"), ("th", "฀", "๿"), ("ja", "぀", "ヿ"), ("ko", "가", "힯"), ("zh", "一", "鿿"))

_shared = Counter(w for text in STOPWORDS.values() for w in set(text.split()))
_VOTES: dict[str, list[tuple[str, float]]] = {}
for _lang, _text in STOPWORDS.items():
    for _w in set(_text.split()):
        _VOTES.setdefault(_w, []).append((_lang, 1.0 / _shared[_w]))

_SENTENCES = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_WORDS = re.compile(r"[^\W\d_]+")
#: Markup, results and formulas carry no sentence.
_NO_PROSE = re.compile(r"\\[a-z]+\{[^{}]*\}|\\[a-z]+|\$[^$\n]*\$|`[^`]*`")


def _script(sentence: str) -> str | None:
    foreign = [c for c in sentence if c > "Ͱ" and c.isalpha()]
    if len(foreign) < 2:
        return None
    votes = Counter(lang for c in foreign for lang, lo, hi in SCRIPTS if lo <= c <= hi)
    if votes["ja"]:
        return "ja"
    return votes.most_common(1)[0][0] if votes and 2 * sum(votes.values()) >= len(_WORDS.findall(sentence)) else None


def scores(text: str) -> dict[str, float]:
    """Votes by language: every sentence gives one vote to its language, or parts of it where languages tie."""
    total: dict[str, float] = {}
    for sentence in _SENTENCES.split(_NO_PROSE.sub(" ", text)):
        if (not sentence.isascii()) and (lang := _script(sentence)):
            total[lang] = total.get(lang, 0.0) + 1.0
            continue
        own: dict[str, float] = {}
        for word in _WORDS.findall(sentence.lower()):
            for lang, weight in _VOTES.get(word, ()):
                own[lang] = own.get(lang, 0.0) + weight
        if own:
            most = max(own.values())
            best = [lang for lang, v in own.items() if v > 0.8 * most]
            weight = min(1.0, most / 1.5)
            for lang in best:
                total[lang] = total.get(lang, 0.0) + weight / len(best)
    return total


def language(text: str | None, least: float = 0.6, margin: float = 1.6) -> str:
    """The language that wins the votes clearly, else ''."""
    if not text:
        return ""
    ranked = sorted(scores(text).items(), key=lambda x: -x[1])
    if not ranked or ranked[0][1] < least or len(ranked) > 1 and ranked[0][1] < margin * ranked[1][1]:
        return ""
    return ranked[0][0]
