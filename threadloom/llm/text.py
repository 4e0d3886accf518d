"""Text forms that the training-data operators compare and score."""

from __future__ import annotations

import html
import re
import sys
import unicodedata


def _class_of(keep) -> str:
    """A regular-expression character class of all characters for which ``keep`` holds, as ranges."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and keep(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "[" + "".join(out) + "]"


#: Fillers that show nothing although they are letters or marks; fixed values.
_BLANK_LETTERS = set("\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0") | {chr(c) for c in range(0xFE00, 0xFE10)}
INVISIBLE = re.compile(
    _class_of(lambda c: c in _BLANK_LETTERS or (unicodedata.category(c) in ("Cf", "Cc") and c not in "\n\t\r"))
)
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
#: Letters, digits and the marks on them.
WORD = re.compile(r"[^\W_]+(?:[\u0300-\u036f][^\W_]*)*")


def visible(text: str) -> str:
    """Without entities, tags, invisible and control characters (line breaks and tabs stay), in composed form."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    text = INVISIBLE.sub("", text)
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text


def plain_words(text: str) -> list[str]:
    """Case-folded words; punctuation, spacing, markup, entities and invisible characters don't count."""
    return WORD.findall(visible(text).casefold())
