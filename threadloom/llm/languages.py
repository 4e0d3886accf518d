"""Languages of texts and declared language codes."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that tell the languages of the corpus apart, written for this library.
WORDS = {
    "ru": "и в не на что с как это по но из у за то все так его к же вы бы от мы для о уже если или ни была был они когда чтобы "
    "только лучше потом где ещё есть нет да я он она мне меня тут там вот очень после до при без под надо можно стоит почему "
    "зачем сколько нужно взял хотя раз иначе поэтому потому который мой свой лет себе кто чем чего опять просто",
    "uk": "і й в не на що з як це по але із у за те всі так його до ж ви б від ми для про вже якщо або ні була був вони коли щоб "
    "тільки краще потім де ще є немає я він вона мені мене тут там ось дуже після перед при без під треба можна варто чому "
    "навіщо скільки потрібно взяв хоча раз інакше тому який мій свій ніж та цей щоби років собі хто чи бо то довше окремо довелося "
    "дешевше обережно уважно спокійно поступово ввечері одразу придбати довелось треба немає маю",
    "en": "the of and to in is it you that was for on are with as at be this have from or had by not but what all were when we "
    "there can an your which their said if do will each about how up out them then she many some so these would other into has "
    "more her two him see my than first been who its now over just any only because after before why i he me they no did does "
    "am should could nobody told",
    "de": "der die das und ist nicht ein eine in zu den von mit sich auf für es im dem ich er sie wir ihr auch als an nach wie "
    "aus bei oder aber wenn dass was kann man wird war sind hat haben nur noch mein dein sein über zum zur einen einem eines "
    "weil damit obwohl warum wie viel wo wer du mich dich gut läuft hält sollte zuerst dann letzte woche wollte lohnt",
    "es": "el la los las de que y en un una por con no para es se lo su al del como más pero sus le ya o este sí porque esta "
    "entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso "
    "mi qué cómo dónde cuánto tiene ha fue son ser puede si aunque así mejor primero luego conviene quería semana pasada",
}
LANGUAGES = tuple(WORDS)
_OF_WORD: dict[str, list[int]] = {}
for _k, _words in enumerate(WORDS.values()):
    for _w in set(_words.split()):
        _OF_WORD.setdefault(_w, []).append(_k)
_TOKEN = re.compile(r"[^\W\d_]+")
_LETTERS = tuple((LANGUAGES.index(name), np.array([ord(c) for c in letters])) for name, letters in (("ru", "ыэъё"), ("uk", "іїєґ"), ("de", "äöüß"), ("es", "ñ¿¡áíóú")))


def language_scores(text: str, low: str | None = None, words: list[str] | None = None) -> list[float]:
    """Evidence for each of ``LANGUAGES`` in the whole text: function words, telling letters and the script. ``low``, its folded
    form, and ``words``, its runs of letters, are taken as given where they are known."""
    low = text.casefold() if low is None else low
    scores = [0.0] * len(LANGUAGES)
    for word in _TOKEN.findall(low) if words is None else words:
        for k in _OF_WORD.get(word, ()):
            scores[k] += 1.0
    codes = np.frombuffer(low.encode("utf-16-le", "surrogatepass"), np.uint16)
    times = np.bincount(codes[codes < 0x530], minlength=0x530)
    for k, letters in _LETTERS:
        scores[k] += min(0.5 * int(times[letters].sum()), 3.0 + scores[k])
    cyrillic, latin = int(times[0x400:].sum()), int(times[97:123].sum() + times[0xDF:0x250].sum())
    if cyrillic > latin:
        scores[0] += 0.02 * cyrillic
        scores[1] += 0.02 * cyrillic
        scores[2:] = [0.2 * s for s in scores[2:]]
    else:
        scores[:2] = [0.2 * s for s in scores[:2]]
        scores[2] += 0.01 * latin
    return scores


def detect(text: str | None) -> str | None:
    """The language of a text, or None where the text holds too little evidence."""
    if not text:
        return None
    scores = language_scores(text)
    ranked = sorted(scores, reverse=True)
    if ranked[0] < 1.0 or ranked[0] < 1.15 * ranked[1]:
        return None
    return LANGUAGES[scores.index(ranked[0])]


def declared_code(column: Column | str) -> Column:
    """The two-letter code of a declared language in any of its forms (``RU``, ``ru-RU``, ``rus``); blank becomes null."""
    base = F.lower(F.regexp_extract(column, r"([A-Za-z]+)", 1))
    three = {"rus": "ru", "eng": "en", "ukr": "uk", "deu": "de", "ger": "de", "spa": "es", "ua": "uk"}
    named = F.create_map(*(F.lit(x) for pair in three.items() for x in pair))
    code = F.coalesce(F.try_element_at(named, base), base)
    return F.when(F.length(code) > 0, code)
