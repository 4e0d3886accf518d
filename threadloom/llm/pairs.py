"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language answers.

Copies are found by compressing an answer with its question as the zstandard dictionary and confirmed word by word;
refusals and requests for a language by dictionaries; languages by ``languages``; truncation by open brackets and by a
terminal-context model: how often each word of the corpus is followed by nothing at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.languages import LANGUAGES, language_scores
from threadloom.llm.overlap import edit_distance
from threadloom.llm.text import TAG, WORD, visible
from threadloom.stages import materialize

#: Answers that compress to at most this share with the question as dictionary are looked at as copies. Questions of up to
#: SHORT bytes are compared word by word at once: the fixed size of a frame would hide their copies.
COPY_RATIO, SHORT = 0.6, 200
#: Share of an answer's words from which on its declining sentences make it a refusal.
DECLINING = 0.2
#: A word met at least OFTEN times that ends at most this share of its sentences, lines and texts demands more.
OFTEN, END_SHARE = 25, 0.012
#: A last word is cut if it is met inside texts at most this share of the times that it ends one, and a longer word that begins
#: with it is met so many times, and so many times as often; a word that a full stop follows now and then is whole. A capital may
#: begin a name, so that takes more.
INSIDE_SHARE, DOT_SHARE, CUT_TIMES, CUT_RATIO, CUT_CAPITAL = 0.1, 0.02, 8, 40, 100

#: What stands for absent text, written for this library; compared without quotes and outer punctuation.
PLACEHOLDERS = set(
    "n/a|null|none|nil|nan|undefined|empty|blank|deleted|removed|placeholder|todo|tbd|no text|no answer|"
    "удалено|удалён|удален|пусто|нет текста|без текста|текст удалён|сообщение удалено|видалено|порожньо|немає тексту|"
    "gelöscht|leer|entfernt|kein text|eliminado|borrado|vacío|sin texto".split("|")
)

#: Declining in five languages: said by somebody who could answer but doesn't, or who calls the request out of bounds.
_REFUSAL = re.compile(
    r"(?:\bне (?:могу|можем|в состоянии|имею (?:возможности|права)|буду|стану|готов|вправе|уполномочен)\b[^.!?\n]{0,30}"
    r"(?:помоч|помога|ответ|отвеч|выполн|обсужда|предостав|комментир|подсказ|советов|делиться|продолж)|"
    r"\bотвечать на (?:это|этот|такие|подобн)[^.!?\n]{0,25}не (?:буду|стану|могу)|\bотказ(?:аться|ываюсь)\b[^.!?\n]{0,20}(?:ответ|отвеч|помог|выполн)|"
    r"\b(?:вынужден\w*|должен|должна|обязан\w*) (?:отказ|отклон)|\bотказываюсь\b|\bмне (?:нельзя|запрещено|не разрешено|не позволено)\b|"
    r"за рамки того, что мне|не дано? права|\bне даю (?:подобных|таких|никаких)? ?(?:советов|рекомендаци)|не предоставля[юе]\w* (?:так|подобн)|"
    r"\bне (?:можу|маю (?:змоги|можливості|права)|буду|в змозі)\b[^.!?\n]{0,30}(?:допомог|відпов|викон|обговор|надат|порад)|\bвідповідати на (?:це|таке)[^.!?\n]{0,20}не буду|"
    r"\b(?:мушу|змушен\w*) відмов|\bмені (?:не дозволено|заборонено|не можна)\b|\bвиходить за межі того, що мені|\bне даю (?:подібних|таких) порад|"
    r"\bi(?: a|')m (?:unable|not able|not allowed|not permitted|not in a position|forbidden)\b|\bi (?:can(?:not|'t|not)|am unable|won't|will not|must|have to|need to) "
    r"(?:help(?! but\b|\s+\w+ing\b)|assist|answer|discuss|provide|comply|fulfil\w*|share|comment|do that|decline|refuse)\b[^.!?\n]{0,30}|\bi (?:must |have to |need to )?(?:decline|refuse)\b|"
    r"\bi do not give such advice|\bi don't give (?:such|that kind of)|\b(?:beyond|outside)(?: the scope of)? what i(?: a|')m allowed|against my (?:rules|guidelines|policy)|"
    r"\b(?:kann|darf|werde|möchte) (?:ich )?(?:ihnen |dir |dabei |das |diese\w* |hierbei |darauf |bei )*[^.!?\n]{0,25}(?:nicht|keine) ?[^.!?\n]{0,15}"
    r"(?:helfen|beantworten|antworten|besprechen|erfüllen|sprechen|geben)|\bich (?:kann|darf|werde)\b[^.!?\n]{0,30}\b(?:nicht|keine)\b[^.!?\n]{0,20}(?:helfen|beantwort|antworten|besprech|erfüll|sprechen)|"
    r"\b(?:ich muss|muss ich)\b[^.!?\n]{0,30}(?:ablehnen|verweigern)|\bgebe ich (?:keine|solche)|nicht erlaubt, (?:darüber|das)|"
    r"\bno puedo (?:ayudar\w*|responder|contestar|hablar|cumplir|atender|dar|discutir|proporcionar)|\bno (?:me está permitido|estoy autorizad|voy a responder|doy (?:ese tipo|tales) )|"
    r"\b(?:debo|tengo que) (?:negarme|rechazar|rehusar|declinar))"
)
#: What every declining sentence holds; looked for first, in lower case.
_MAY_DECLINE = re.compile(
    r"не|ні|отказ|отклон|нельзя|запрещ|рамки|відмов|заборон|меж|unable|not|n't|refus|declin|allowed|forbid|against|nicht|kein|ablehn|verweiger|no |negar|rechaz|rehus|nunca"
)
_MODEL = re.compile(
    r"как (?:языковая модель|искусственный интеллект|ии\b)|як (?:мовна модель|штучний інтелект)|as an? (?:ai|language model|assistant)|als (?:ki|sprachmodell)|como (?:modelo de lenguaje|ia\b|inteligencia)",
)
_DECLINES = re.compile(r"\b(?:не|no|not|nicht|kein\w*|cannot|can't|unable|нельзя|ні)\b")
_ASKS = re.compile(
    r"перевед|перевод(?:и|ом)? (?:на|с)\b|переклад|translat|übersetz|traduc|traduz|"
    r"(?:на|по)[ -]?(?:английск|немецк|испанск|украинск|русск|французск|англійськ|німецьк|іспанськ|українськ|російськ)|англійською|німецькою|іспанською|українською|російською|"
    r"\bin (?:english|german|spanish|russian|ukrainian|french)\b|\binto (?:english|german|spanish|russian|ukrainian|french)\b|"
    r"\b(?:auf|ins) (?:deutsch\w*|englisch\w*|spanisch\w*|russisch\w*|ukrainisch\w*)|\b(?:en|al) (?:inglés|alemán|español|ruso|ucraniano)\b",
    re.I,
)
#: Languages that a question can name, by the code in LANGUAGES; others are kept as named.
_NAMED = {
    "en": re.compile(r"\b(?:английск|англійськ|english|englisch|inglés|ingles\b)", re.I), "de": re.compile(r"\b(?:немецк|німецьк|german\b|deutsch|alemán|aleman\b)", re.I),
    "es": re.compile(r"\b(?:испанск|іспанськ|spanish|spanisch|español|espanol|castellano)", re.I), "ru": re.compile(r"\b(?:русск|російськ|russian|russisch|ruso\b)", re.I),
    "uk": re.compile(r"\b(?:украинск|українськ|ukrainian|ukrainisch|ucraniano)", re.I), "other": re.compile(r"\b(?:французск|французьк|french|französisch|francés)", re.I),
}
_REF = re.compile(r">>\d+|\[(?:/?[a-z]{1,5}|\d+)\]|&[a-z]+;")
_LETTER = re.compile(r"[^\W_]|[\U0001F000-\U0001FAFF☀-➿]")
_OPENERS = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“"}
_LAST = re.compile(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)\s*$")
_DEMANDS_SIGN = re.compile(r"(?:[,:;(\[{«„/+=&<\\]|\s[—–-]|[^\W_][—–])\s*$")
_BARE_ITEM = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•—])\s*$")
_TERMINAL = re.compile(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)(?=([ \t]*[.!?…]|\s*\n)?)")
#: Words after which a sentence can't end, whatever the corpus says.
_OPEN_WORDS = set(
    "и в на с к у о по из за от для до без при над под про между через чтобы если когда который которая которые потому хотя либо или а но что как так пока чем "
    "і й в на з до у о по із за від для без при над під про між через щоб якщо коли який яка які хоча або але що як поки ніж "
    "the a an of to in on at for from with by and or but because if when while that which who than as into my your his their our its "
    "der die das ein eine einen einem einer und oder aber weil wenn dass für mit von zu bei nach aus über unter zwischen als mein meine sein seine "
    "el la los las un una unos unas de del a al en con por para y o pero porque si que cuando como mi su sin sobre entre".split()
) - {"a", "so", "такой"} | {"the", "a"}


class Said:
    """A message with the forms of it that the labels look at, each made once: as shown, folded, and its words."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def shown(self) -> str:
        return visible(self.text)

    @cached_property
    def low(self) -> str:
        return self.shown.casefold()

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.low)

    @cached_property
    def language(self) -> tuple[str | None, float]:
        scores = language_scores(self.shown, self.low, self.words)
        ranked = sorted(scores)
        if ranked[-1] < 1.0 or ranked[-1] < 1.5 * max(ranked[-2], 0.0):
            return None, ranked[-1]
        return LANGUAGES[scores.index(ranked[-1])], ranked[-1]


def _said(message: str | Said | None) -> Said:
    return message if isinstance(message, Said) else Said(message)


def is_empty(answer: str | Said | None) -> bool:
    """Nothing but blanks, invisible characters, punctuation, markup, post references or a placeholder for absent text."""
    if answer is None:
        return True
    text = _said(answer).shown
    if ">>" in text or "[" in text or "&" in text:
        text = _REF.sub(" ", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not _LETTER.search(text):
        return True
    if len(text) > 200 and len(WORD.findall(text)) > _MOST_WORDS:
        return False
    return " ".join(text.translate(_NO_QUOTES).split()).casefold().strip("()[]{}<>*_.-—–…!? ") in PLACEHOLDERS


#: Words of the longest placeholder.
_MOST_WORDS = max(len(WORD.findall(x)) for x in PLACEHOLDERS)
_NO_QUOTES = str.maketrans("", "", "\"'`«»“”")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_STILL_ANSWERS = re.compile(r"отвечу по делу|но отвечу|but here|but i'll answer|aber hier")


def is_refusal(answer: str | Said) -> bool:
    """The answer declines and gives nothing else: the declining sentences are at least DECLINING of its words, wherever they stand."""
    said = _said(answer)
    text = said.shown.lower()
    if not _MAY_DECLINE.search(text):
        return False
    declining = 0
    for s in _SENTENCE.split(text):
        if _MAY_DECLINE.search(s) and (_REFUSAL.search(s) or (_MODEL.search(s) and _DECLINES.search(s))) and not _STILL_ANSWERS.search(s):
            declining += len(WORD.findall(s))
    return declining > 0 and declining >= DECLINING * len(said.words)


def copy_share(question: str, answer: str) -> float:
    """Size of the answer compressed with the question as dictionary, by its size compressed alone."""
    a, q = answer.encode("utf-8", "replace"), question.encode("utf-8", "replace")
    if len(q) < 8 or not a:
        return 1.0
    given = zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = dict(level=9, write_content_size=False, write_checksum=False, write_dict_id=False)
    alone = len(zstandard.ZstdCompressor(**frame).compress(a))
    return len(zstandard.ZstdCompressor(dict_data=given, **frame).compress(a)) / alone


_INTRO_END = re.compile(r"[:—–\n«\"„“>]")


def is_copy(question: str | Said, answer: str | Said) -> bool:
    """The answer is the question again: once or repeated, up to a word in ten (one at least, none in questions of one or two
    words), after no more than an introduction that is shorter than it, and nothing after it."""
    question, answer = _said(question), _said(answer)
    q, a = question.words, answer.words
    if not q or len(a) < max(min(3, len(q)), len(q) // 2):
        return False
    known = set(q)
    new = [0, *accumulate(w not in known for w in a)]  # words before each place that the question doesn't have
    if new[-1] > len(a) // 2 + max(2, len(a) // 10):  # not even after the longest introduction
        return False
    asked = " ".join(q)
    if len(asked.encode("utf-8", "replace")) > SHORT and copy_share(asked, " ".join(a)) > COPY_RATIO:
        return False
    parts = [WORD.findall(s) for s in re.split(r"(?<=[.!?])\s+|\n+", question.low)]
    targets = [q, *(w for w in (parts[-1:] if len(parts) > 1 else []) if len(w) >= 5)]
    # An introduction ends at a sign; the words before each such sign in the first half are where the copy may begin.
    leads, at, before = [0], 0, 0
    for hit in _INTRO_END.finditer(answer.low):
        before += len(WORD.findall(answer.low, at, hit.start()))
        at = hit.start()
        if before > len(a) // 2:
            break
        if before > leads[-1]:
            leads.append(before)
    for target in targets:
        lost = new if target is q else [0, *accumulate(w not in set(target) for w in a)]
        for lead in leads:
            rest = len(a) - lead
            times = max(1, round(rest / len(target)))
            reworded = 2 if len(target) >= 8 else 1  # one word, which may be written with a hyphen
            most = max(reworded, len(target) * times // 10) if len(target) > 2 else 0
            if rest and lost[-1] - lost[lead] <= most and edit_distance(a[lead:], target * times) <= most:
                return True
    return False


def is_other_language(question: str | Said, answer: str | Said) -> bool:
    """The answer is mainly in another language than the question, which doesn't ask for that: it names no such language, and
    doesn't ask for a translation without naming any."""
    question, answer = _said(question), _said(answer)
    asked, _ = question.language
    said, weight = answer.language
    if asked is None or said is None or asked == said:
        return False
    if _ASKS.search(question.text):
        named = {code for code, word in _NAMED.items() if word.search(question.text)}
        if not named or "other" in named or said in named:
            return False
    return weight >= 1.5 and len(answer.words) >= 3


def terminal_counts(texts: DataFrame) -> DataFrame:
    """(word, n, ends, low, dots) of the words of ``texts`` (text string): how often they occur, how often a sentence, line or text
    ends after them, how often they are written without a capital, and how often a full stop or the like follows. Combined within each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text in batch.column(0).to_pylist():
                if text:
                    shown = visible(text) + "\n"
                    for word, end in _TERMINAL.findall(shown):
                        entry = seen.setdefault(word.lower(), [0, 0, 0, 0])
                        entry[0] += 1
                        entry[2] += word[0].islower()
                        if end:
                            entry[1] += 1
                            entry[3] += bool(end.strip())
            words = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string())] + [pa.array([seen[w][k] for w in words], pa.int64()) for k in range(4)],
                names=["word", "n", "ends", "low", "dots"],
            )

    rows = texts.select("text").mapInArrow(count, "word string, n long, ends long, low long, dots long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("low").alias("low"), F.sum("dots").alias("dots"))


_MARKS = (*_OPENERS, '"', "`")
_NO_BRACKETS = re.compile(r"[:;=8]['-]?[()\[\]DP]+|\){2,}|^\s*\d+\)", re.M)


def open_at_end(answer: str | Said) -> bool:
    """An open bracket, quotation, code block or list item, or a sign that demands more."""
    text = _said(answer).shown.rstrip()
    if text.count("```") % 2:
        return True
    prose = re.sub(r"```.*?```", " ", text, flags=re.S) if "```" in text else text
    if not prose.rstrip():
        return False
    if text.endswith("```"):
        return False
    if _BARE_ITEM.search(prose) or _DEMANDS_SIGN.search(prose.rstrip()):
        return True
    if not any(map(prose.__contains__, _MARKS)):
        return False
    prose = _NO_BRACKETS.sub(" ", prose)
    for a, b in _OPENERS.items():
        if prose.rfind(a) > prose.rfind(b) and (a != "„" or prose.rfind(a) > max(prose.rfind("“"), prose.rfind("”"), prose.rfind('"'))):
            return True
    return prose.count('"') % 2 == 1 or prose.count("`") % 2 == 1 or prose.count("“") > prose.count("”") + prose.count("„")


def last_word(answer: str | Said) -> str | None:
    """The word that the answer ends with, if nothing but blanks follows it."""
    text = _said(answer).shown.rstrip()
    if not text or not (text[-1].isalpha()):
        return None
    at = max(text.rfind(c) for c in " \n\t") + 1  # the word lies in the last run without blanks
    hit = _LAST.search(text, at)
    return hit.group(1) if hit else None


_PAIR = "sample_no long, pair_no int, last string, low boolean, defect string"


def _split_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sample, messages in zip(*(c.to_pylist() for c in batch.columns)):
            number, before = 0, None
            for m in messages or ():
                role = m["role"] if m else None
                if role == "assistant" and before is not None:
                    number += 1
                    question, answer = Said(before["content"]), Said(m["content"])
                    defect, last = None, None
                    if is_empty(answer):
                        defect = "empty"
                    elif is_refusal(answer):
                        defect = "refusal"
                    elif is_copy(question, answer):
                        defect = "copied_question"
                    elif is_other_language(question, answer):
                        defect = "other_language"
                    elif open_at_end(answer):
                        defect = "truncated"
                    else:
                        last = last_word(answer)
                    rows.append((sample, number, last and last.lower(), bool(last) and last.islower(), defect))
                before = m if role == "user" else None if role in ("user", "assistant") else before
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["sample_no", "pair_no", "last", "low", "defect"]
        )


def labelled_pairs(samples: DataFrame, texts: DataFrame) -> DataFrame:
    """(sample_no, pair_no, defect) of every user message that an assistant message follows; null where the pair is sound.

    ``samples`` has (sample_no, messages), one row each; ``texts`` (text) is the corpus the terminal-context model is counted
    over. Pairs count from 1, system messages apart; an assistant message after another one is no pair. A null answer is
    empty. A pair has one defect at most, in the order empty, refusal, copied_question, other_language, truncated. The
    model's words are joined to last words only, so nothing of it is collected.
    """
    pairs = samples.select("sample_no", "messages").mapInArrow(_split_pairs, _PAIR)
    pairs = materialize(pairs, "pairs")
    words = materialize(terminal_counts(texts), "words")
    wanted = pairs.filter("last is not null").select(F.col("last").alias("word")).distinct()
    # How often longer words begin with a last word: the words' own beginnings, kept where they are asked for.
    beginnings = F.expr("transform(sequence(1, length(word) - 1), k -> left(word, k))")
    begin = words.filter("length(word) > 1").select(F.explode(beginnings).alias("word"), "low", F.col("n").alias("all"))
    longer = begin.join(wanted, "word", "left_semi").groupBy("word").agg(F.max("low").alias("longer"), F.max("all").alias("longer_all"))
    known = wanted.join(words, "word", "left").join(longer, "word", "left").select(
        "word", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ends", "dots", "longer", "longer_all"))
    )
    inside = F.col("n") - F.col("ends")
    demands = (F.col("n") >= OFTEN) & (F.col("ends") <= END_SHARE * F.col("n")) | F.col("word").isin(sorted(_OPEN_WORDS))
    rare = (inside <= INSIDE_SHARE * F.col("ends")) & (F.col("dots") <= DOT_SHARE * F.col("ends"))
    plain = F.col("low") & (F.col("longer") >= CUT_TIMES) & (F.col("longer") >= CUT_RATIO * F.col("ends"))
    capital = ~F.col("low") & (F.col("longer_all") >= CUT_CAPITAL) & (F.col("longer_all") >= CUT_CAPITAL * F.col("ends"))
    cut = rare & (plain | capital)
    # Rows without a last word are most of them and have nothing to look up.
    joined = pairs.filter("last is not null").join(known, pairs["last"] == known["word"], "left")
    judged = joined.select("sample_no", "pair_no", F.when(demands | cut, F.lit("truncated")).alias("defect"))
    return pairs.filter("last is null").select("sample_no", "pair_no", "defect").unionByName(judged)
