"""Text functions as native columns, with Arrow functions only where Unicode or HTML rules need Python."""

from __future__ import annotations

import hashlib
import html
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word characters (letters, digits, underscore), white space and word boundaries of any script, for Java's dialect.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# The patterns that define noise in a post, and replies that mean nothing without their attachment.
URL = r"(?iu)(?:https?://|ftp://|www\.)[^\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
EMAIL = rf"{EDGE}[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}{EDGE}"
IPV4 = rf"{EDGE}(?:\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}{EDGE}"
PHONE = rf"(?<!{WORD})(?:\+?\p{{Nd}}[\p{{Nd}} ()-]{{8,}}\p{{Nd}})(?!{WORD})"
HANDLE = rf"(?<!{WORD})@[A-Za-z0-9_]{{5,}}{EDGE}"
REFERENCE = r">>(\p{Nd}+)"
OP_MARKER = rf"(?iu)\({SPACE}*OP{SPACE}*\)"
IMAGE_REPLY = (
    r"(?iu)^(?:пикрил(?:ейтед)?|вот (?:это|эта|этот|оно)|согласны\??|как вам\??|что думаете\??|"
    r"(?:смотри|см\.)?\s*(?:фото|картинк[ауе]|скрин))$"
)
#: The kinds of noise in the order they are taken out, each with a sign that is quick to look for and without which there is none.
_NOISE = (
    (URL, r"://|(?i)www\."), (EMAIL, "@"), (IPV4, r"\p{Nd}\.\p{Nd}"), (PHONE, r"\p{Nd}[\p{Nd} ()-]{8}"), (HANDLE, "@"), (REFERENCE, ">>"),
    (OP_MARKER, r"(?iu)OP"),
)
#: Texts without these signs are in composed form and have no markup, so Python need not see them.
_NEEDS_PYTHON = r"[&<]|[^\u0000-\u024f\u0400-\u0482\u048a-\u052f\u2002-\u2069\u20a0-\u20bf\u2116-\u2122\u2190-\u2328\u232b-\u2adb\x{1F000}-\x{1FAFF}]"


def bind(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use(column)`` with the column's expression evaluated once, however often ``use`` mentions it, also within lambdas."""
    return F.element_at(F.transform(F.array(column), use), 1)


class _Stripper(HTMLParser):
    def __init__(self, skip: tuple[str, ...] = (), breaks: bool = False):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip, self.breaks, self.depth = skip, breaks, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.skip:
            self.depth += 1
        elif tag == "br" and self.breaks:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.skip and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)

    @classmethod
    def text(cls, markup: str, **how) -> str:
        parser = cls(**how)
        parser.feed(markup)
        parser.close()
        return " ".join(parser.parts)


def _composed(text: str | None) -> str | None:
    if text is None:
        return None
    import re

    out = html.unescape(unicodedata.normalize("NFC", text))
    return _Stripper.text(out) if re.search(r"</?[A-Za-z][^>]*>", out) else out


@F.pandas_udf(T.StringType())
def _composed_column(text: pd.Series) -> pd.Series:
    return text.map(_composed)


def composed(text: Column | str) -> Column:
    """Composed Unicode form with entities resolved and tags dropped; only texts that need it go through Python."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(column.rlike(_NEEDS_PYTHON), _composed_column(column)).otherwise(column)


def _blanked(pattern: str, sign: str) -> Callable[[Column], Column]:
    return lambda t: F.when(t.rlike(sign), F.regexp_replace(t, pattern, " ")).otherwise(t)


def without_noise(text: Column | str) -> Column:
    """Links, addresses, numbers, handles, post references and author marks each replaced by a blank, in this order."""
    column = F.col(text) if isinstance(text, str) else text
    for pattern, sign in _NOISE:
        column = bind(column, _blanked(pattern, sign))
    return column


def squeezed(text: Column | str) -> Column:
    """Control and format characters dropped (line feeds and tabs stay), blanks squeezed, empty lines left out."""
    shown = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}&&[^\n\t]]", "")
    lines = F.split(shown, r"[\n\u2028\u2029]")
    tidy = F.transform(lines, lambda s: stripped(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda s: s != ""), "\n")


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_text(text: Column | str) -> Column:
    """The text of a post without technical and identifying noise, with the author's voice kept."""
    return squeezed(without_noise(composed(text)))


def is_meaningful(text: Column | str) -> Column:
    """Some letter, number or symbol is left."""
    return F.rlike(text, F.lit(r"[\p{L}\p{N}\p{S}]"))


def is_image_reply(text: Column | str) -> Column:
    """A short reply that means nothing without the attachment."""
    compact = F.regexp_replace(text, rf"{SPACE}+", " ")
    bare = F.regexp_replace(compact, r"^[ .,!?:;—-]+|[ .,!?:;—-]+$", "")
    return (F.length(bare) <= 80) & F.rlike(bare, F.lit(IMAGE_REPLY))


def references(text: Column | str) -> Column:
    """Distinct ``>>digits`` in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r">>\d+"), 0))


def exact_references(refs: Column | str) -> Column:
    """The numbers of the entries that are exactly ``>>`` and digits, once each, in order; null and other entries don't count, a
    null array is empty."""
    exact = F.filter(refs, lambda r: r.rlike(r"^>>[0-9]+\z"))
    ids = F.filter(F.transform(exact, lambda r: F.substring(r, 3, 40).try_cast("long")), lambda x: x.isNotNull())
    return F.coalesce(F.array_distinct(ids), F.array().cast("array<bigint>"))


def _line_form(line: Column, quoted: bool) -> Column:
    bare = F.regexp_replace(line, "^[> ]+", "") if quoted else line
    flat = F.regexp_replace(bare, rf"{SPACE}+", " ")
    return F.lower(stripped(flat) if quoted else flat)


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]")


#: Fixed value: characters from which on a line counts as quoted where it is repeated.
QUOTE_CHARACTERS = 12


def quotable_lines(text: Column | str) -> Column:
    """Hashes of the lines of a text that an answer may quote: of 12 characters or more, without blanks around them and case. Null
    texts have none."""
    column = F.col(text) if isinstance(text, str) else text
    long_lines = F.filter(lines_of(column), lambda s: F.length(stripped(s)) >= QUOTE_CHARACTERS)
    return F.coalesce(F.array_distinct(F.transform(long_lines, lambda s: F.xxhash64(_line_form(s, False)))), F.array().cast("array<bigint>"))


def without_lines(response: Column, told: Column) -> Column:
    """``response`` without its lines of at least 12 characters whose hash is among ``told``; leading ``>`` and blanks, the width of
    blanks and case don't count."""

    def unquoted(known: Column) -> Column:
        repeats = lambda s: bind(_line_form(s, True), lambda form: (F.length(form) >= QUOTE_CHARACTERS) & F.array_contains(known, F.xxhash64(form)))
        return stripped(F.array_join(F.filter(lines_of(response), lambda s: ~repeats(s)), "\n"))

    return bind(F.coalesce(told, F.array().cast("array<bigint>")), unquoted)


def without_quotes(response: Column, contexts: Column) -> Column:
    """``response`` without lines that repeat a line of the texts in ``contexts`` (``quotable_lines``, ``without_lines``)."""
    return without_lines(response, F.flatten(F.transform(contexts, quotable_lines)))


@F.pandas_udf(T.StringType())
def _canonical_column(text: pd.Series) -> pd.Series:
    import re

    return text.map(lambda t: None if t is None else " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())))


def canonical(text: Column | str, exact: bool = True) -> Column:
    """Case-folded words joined by blanks: ``exact`` by Unicode compatibility form and case folding, else by lower case."""
    if exact:
        return _canonical_column(text)
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}+"), 0), " ")


def md5_number(text: Column) -> Column:
    """The first 60 bits of the MD5 sum as a number: a stable hash that SQL engines share."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _blake_shingles(size: int) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.DecimalType(20, 0)))
    def hashed(texts: pd.Series) -> pd.Series:
        from decimal import Decimal

        def one(text: str | None) -> list | None:
            if text is None:
                return None
            words = text.split(" ") if text else []
            grams = words if len(words) < size else [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
            return [Decimal(int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")) for g in dict.fromkeys(grams)]

        return texts.map(one)

    return hashed


def shingles(canonical_text: Column, size: int = 3, hashing: str = "xxhash") -> Column:
    """Distinct hashes of the word shingles of a canonical text; of all single words where it has fewer than ``size``.

    ``hashing``: ``xxhash`` (fast), ``md5`` (shared with SQL engines) or ``blake2b`` (64 bits, unsigned, through Arrow).
    """
    if hashing == "blake2b":
        return _blake_shingles(size)(canonical_text)

    def grams(words: Column) -> Column:
        n = F.size(words)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(n < size, words).otherwise(runs)

    said = bind(F.filter(F.split(canonical_text, " "), lambda w: w != ""), grams)
    return F.array_distinct(F.transform(said, (lambda g: F.xxhash64(g)) if hashing == "xxhash" else (lambda g: md5_number(g))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all members of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1).cast("int"))


def elapsed(seconds: Column) -> Column:
    """``H:MM:SS`` from an hour on, else ``MM:SS``; parts of a second are dropped, negative spans are 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def byte_size(size: Column) -> Column:
    """A size in the largest binary unit that it fills, with two decimals from KiB on."""
    out = F.format_string("%d Б", size.cast("long"))
    for unit, power in (("КиБ", 10), ("МиБ", 20), ("ГиБ", 30)):
        out = F.when(size >= 1 << power, F.format_string(f"%.2f {unit}", size / (1 << power))).otherwise(out)
    return out


def post_text(markup: pd.Series) -> pd.Series:
    """Plain text of a comment's HTML: scripts and styles dropped, ``<br>`` as line feeds, blanks squeezed, no empty lines."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        lines = _Stripper.text(text, skip=("script", "style"), breaks=True).splitlines()
        return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)

    return markup.map(one)


html_to_post = F.pandas_udf(post_text, T.StringType())
