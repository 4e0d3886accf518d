"""Abusive, hateful and sexual language: a linear-chain conditional random field over disguised words.

Words are folded (look-alike letters, digits and signs for letters, drawn-out, masked, spaced and dotted spellings) and looked up in
the classes of ``abuse_words``. The field tags words sentence by sentence from the words and word beginnings themselves, pairs of
neighbouring beginnings, and the classes with what stands near them; all weights, the bias and the transitions are learned, from
zero, by labelled texts. A text's label says only whether some word in it is abusive, so the fit maximizes the likelihood of that:
in other texts no word is, in an abusive one at least one. Forward-backward gives each word's probability; a text's score is that
of its most abusive word, its spans are runs of words above one half.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm import abuse_seed
from threadloom.llm.abuse_words import COMPANY, STRONG, WEAK
from threadloom.llm.text import visible

#: Labelled texts the field is fitted on at most, by id; steps of the fit.
FIT_EXAMPLES, STEPS = 20_000, 150
#: Words on either side of a word that are its neighbourhood, letters of a word's beginning, words between parts of a phrase.
AROUND, STEM, GAP = 6, 5, 2
#: Share of labels taken to be wrong: bounds what one label can ask for.
WRONG_LABELS = 0.03
#: Pull of the weights towards zero.
HOLD = {"word": 4.0, "stem": 4.0, "pair": 4.0, "near": 0.2, "chain": 0.02}

_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .·_\-*])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_PIECE = re.compile(r"[\w@$#*]+|[.!?…]+(?=\s|$)|\n+|\){2,}")
#: Look-alikes; fixed values. Latin letters that stand for Cyrillic ones, and digits and signs for letters of either script.
_TO_CYRILLIC = str.maketrans("aeopcyxkmthbiursnlgvdzj", "аеорсухкмтнвиигсплгвдзй")
_SIGNS_CYRILLIC = str.maketrans("@$013476", "асоиечтб")
_SIGNS_LATIN = str.maketrans("@$013457", "asoieast")
#: Letters that Russian and Ukrainian spellings of a word differ by; fixed values.
_ONE_SPELLING = str.maketrans("ёіїєґ", "еииег")
_HAS_CYRILLIC, _HAS_LETTER = re.compile("[Ѐ-ԯ]"), re.compile(r"[^\W\d_]")
_DRAWN = re.compile(r"(.)\1{2,}")
_MASK = re.compile(r"[*#]+")
BREAK = -1


def fold_word(word: str) -> str:
    """A word as it sounds: lower case, one spelling of е and и, disguised letters restored, drawn-out letters once; masks stay ``*``."""
    word = word.lower().strip("_#").rstrip("*") if not _HAS_LETTER.search(word[-1:]) else word.lower().lstrip("_#")
    if not _HAS_LETTER.search(word):
        return word
    word = _MASK.sub("*", _DRAWN.sub(r"\1", word))
    if word.isascii() and word.isalpha():
        return word
    if _HAS_CYRILLIC.search(word):
        return word.translate(_TO_CYRILLIC).translate(_SIGNS_CYRILLIC).translate(_ONE_SPELLING)
    word = word.translate(_SIGNS_LATIN)
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


#: Inflectional endings after a ``~``; fixed values.
ENDINGS = frozenset(
    " а о у ом ем е ы и ов ев ей ам ами ах ях ой ою ую ая ое ые ие ый ий ого его ому ему ым им ых их ыми ими я ю ь ью ям ями ьи ок ка ку ко ек л ла ло ли ил ила ила или ить ит ал ала али "
    "s es e en er em n ns as os a o y ed d ing in innen".split(" ")
)
NAMES = (*(f"strong {c}" for c in STRONG), *(f"weak {c}" for c in WEAK), *COMPANY)
_CLASSES = dict(zip(NAMES, (*STRONG.values(), *WEAK.values(), *COMPANY.values())))
_BIT = {name: k for k, name in enumerate(NAMES)}


def _folded_entry(entry: str) -> str:
    return fold_word(entry.rstrip("~*")) + entry[len(entry.rstrip("~*")) :]


class _Patterns:
    """Entries to values: whole words, stems with endings, and beginnings."""

    def __init__(self) -> None:
        self.whole: dict[str, list] = {}
        self.stems: dict[str, list] = {}
        self.starts: dict[str, list] = {}

    def add(self, entry: str, value) -> None:
        entry = _folded_entry(entry)
        kind = {"~": self.stems, "*": self.starts}.get(entry[-1], self.whole)
        kind.setdefault(entry.rstrip("~*"), []).append(value)

    def find(self, word: str) -> list:
        out = list(self.whole.get(word, ()))
        for k in range(2, len(word) + 1):
            begin = word[:k]
            if begin in self.starts:
                out += self.starts[begin]
            if begin in self.stems and word[k:] in ENDINGS:
                out += self.stems[begin]
        return out


_WORDS, _PARTS, _PHRASES = _Patterns(), _Patterns(), []
for _name, _entries in _CLASSES.items():
    for _entry in _entries.split():
        if "_" in _entry:
            for _k, _part in enumerate(_entry.split("_")):
                _PARTS.add(_part, (len(_PHRASES), _k))
            _PHRASES.append((_entry.count("_") + 1, 1 << _BIT[_name]))
        else:
            _WORDS.add(_entry, 1 << _BIT[_name])
_KNOWN = sorted({w for p in (_WORDS, _PARTS) for k in (p.whole, p.stems, p.starts) for w in k if len(w) >= 2})
_MASKABLE = [w for w in _KNOWN if len(w) >= 3]


@lru_cache(maxsize=200_000)
def _unmasked(word: str) -> str:
    """A masked word by the listed words that fit it: the one with the most letters shown, then the shortest; else itself."""
    shown = len(word) - word.count("*")
    if shown < 2:
        return word
    best = None
    for known in _MASKABLE:
        if abs(len(known) - len(word)) > 3:
            continue
        end = word[len(known) :]
        if all(a in ("*", b) for a, b in zip(word, known)) and (len(known) >= len(word) or end in ENDINGS or "*" in end) and len(known) >= len(word) - 3:
            if len(known) > len(word):
                continue
            rank = (sum(c != "*" for c in word[: len(known)]), len(known))
            if best is None or rank > best[0]:
                best = (rank, known + end.replace("*", ""))
    return best[1] if best else word


def word_classes(word: str) -> int:
    """Bits of the classes of a folded word."""
    bits = 0
    for value in _WORDS.find(_unmasked(word) if "*" in word else word):
        bits |= value
    return bits


@lru_cache(maxsize=100_000)
def _cut_spelling(letters: str) -> tuple[int, ...]:
    """Ends of the words in a run of single letters: the cut that leaves the fewest letters outside known words, then the fewest
    words. A run that is not for the most part made of known words stays whole."""
    low = fold_word(letters)
    n = len(low)
    if n != len(letters):
        return (len(letters),)
    known = set(_KNOWN)
    fits = lambda w: w in known or any(w[:k] in _STEMMED and w[k:] in ENDINGS for k in range(len(w) - 3, len(w)) if k > 1)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(10**6, 0, 0)] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - 16), end):
            word = low[start:end]
            lost = 0 if len(word) >= 3 and fits(word) else 1 if word in _LETTERS or word in known else len(word)  # short words may be chance
            rank = (best[start][0] + lost, best[start][1] + 1, start)
            best[end] = min(best[end], rank)
    if best[n][0] > 0.2 * n:
        return (n,)
    cuts, at = [], n
    while at:
        cuts.append(at)
        at = best[at][2]
    return tuple(reversed(cuts))


_STEMMED = {w for p in (_WORDS, _PARTS) for k in (p.stems, p.starts) for w in k}
_LETTERS = frozenset("явсукоиайiay")


def _spelt(word: str, start: int) -> list[tuple[str, int, int]]:
    """The words of a run of single letters with the offsets of their letters, which stand two apart."""
    out, at = [], 0
    for end in _cut_spelling(word):
        out.append((word[at:end], start + 2 * at, start + 2 * end - 1))
        at = end
    return out


def pieces(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text as shown, and its words (spaced ones joined) and breaks with their offsets in it."""
    shown = visible(text)
    out, at = [], 0
    for hit in _SPACED.finditer(shown):
        out += [(m.group(), m.start(), m.end()) for m in _PIECE.finditer(shown, at, hit.start())]
        out += _spelt(re.sub(r"[ .·_\-*]", "", hit.group()), hit.start())
        at = hit.end()
    out += [(m.group(), m.start(), m.end()) for m in _PIECE.finditer(shown, at)]
    return shown, out


def _is_word(piece: str) -> bool:
    return piece[0].isalnum() or piece[0] in "_@$#*"


#: Features of a word that has a strong or weak class: its class, and what else is in its neighbourhood.
_STRONG, _WEAK = list(range(len(STRONG))), list(range(len(STRONG), len(STRONG) + len(WEAK)))
_COMPANY = list(range(len(STRONG) + len(WEAK), len(NAMES)))
_TOWARDS = tuple(_BIT[n] for n in ("you", "your", "aimed", "these", "body", "order"))
NEAR = (
    "strong", "weak", *NAMES[: len(STRONG) + len(WEAK)], *(f"strong, {c}" for c in COMPANY), *(f"weak, {c}" for c in COMPANY),
    *(f"weak {c}, {NAMES[b]}" for c in WEAK for b in _TOWARDS), "two weak of a class", "three weak of a class", "weak by strong", "weak of two classes",
    "two strong", "strong, only me", "weak, only me",
)


def _near_features(masks: np.ndarray) -> np.ndarray:
    """(sentences, length, NEAR) of class bits (sentences, length); zero for words without a strong or weak class."""
    bits = ((masks[..., None] >> np.arange(len(NAMES))) & 1).astype(np.float32)
    total = bits.copy()
    for k in range(1, min(AROUND, bits.shape[1] - 1) + 1):
        total[:, k:] += bits[:, :-k]
        total[:, :-k] += bits[:, k:]
    here = total > 0
    s, w = bits[..., _STRONG].max(-1), bits[..., _WEAK].max(-1)
    w = w * (1 - s)
    with_s, with_w = here[..., _COMPANY] * s[..., None], here[..., _COMPANY] * w[..., None]
    of_class = [bits[..., c] * w for c in _WEAK]
    aimed = [np.stack([here[..., b] * h for b in _TOWARDS], -1) for h in of_class]
    weak_total, weak_here = total[..., _WEAK], here[..., _WEAK]
    own = np.stack(of_class, -1)
    two, three = ((weak_total >= 2) * own).max(-1), ((weak_total >= 3) * own).max(-1)
    me_only = here[..., _BIT["me"]] & ~here[..., _BIT["you"]] & ~here[..., _BIT["your"]]
    rest = [two, three, w * here[..., _STRONG].any(-1), w * (weak_here.sum(-1) >= 2), s * (total[..., _STRONG].sum(-1) >= 2), s * me_only, w * me_only]
    return np.concatenate(
        [s[..., None], w[..., None], bits[..., _STRONG], bits[..., _WEAK] * w[..., None], with_s, with_w, *aimed, np.stack(rest, -1)], -1
    ).astype(np.float32)


@dataclass
class Field:
    """Weights of the field, as log-odds of abusive against other; codes of words, beginnings and pairs of beginnings."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted codes of known pairs
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            self.weights = {"word": np.zeros(1), "stem": np.zeros(1), "pair": np.zeros(1), "near": np.zeros(len(NEAR)), "chain": np.array([-4.0, 0.0, 0.0])}

    def pair_codes(self, stems: np.ndarray) -> np.ndarray:
        """Codes (sentences, length) of each word's beginning with the one before; 0 where the pair is not known."""
        out = np.zeros(stems.shape, np.int64)
        if len(self.pairs) and stems.shape[1] > 1:
            both = stems[:, :-1] * (len(self.stems) + 1) + stems[:, 1:]
            at = np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)
            out[:, 1:] = np.where((self.pairs[at] == both) & (stems[:, :-1] > 0) & (stems[:, 1:] > 0), at + 1, 0)
        return out

    def emission(self, words: np.ndarray, stems: np.ndarray, pairs: np.ndarray, near: np.ndarray) -> np.ndarray:
        w = self.weights
        e = w["chain"][0] + w["word"][words] + w["stem"][stems] + near @ w["near"]
        p = w["pair"][pairs]
        e += p
        e[:, :-1] += p[:, 1:]
        return e


def _chain(e: np.ndarray, start: float, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, length = e.shape
    p1 = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
    emit = np.stack([1 - p1, p1], -1)
    step = np.exp(np.array([[0.0, start], [0.0, stay]]))
    forward, backward, norm = np.empty((n, length, 2)), np.ones((n, length, 2)), np.empty((n, length))
    now = emit[:, 0]
    for t in range(length):
        if t:
            now = (forward[:, t - 1] @ step) * emit[:, t]
        norm[:, t] = now.sum(1)
        forward[:, t] = now / norm[:, t, None]
    for t in range(length - 2, -1, -1):
        backward[:, t] = ((backward[:, t + 1] * emit[:, t + 1]) @ step.T) / norm[:, t + 1, None]
    return forward, backward, norm, emit, step, p1


def marginals(e: np.ndarray, start: float, stay: float) -> np.ndarray:
    """Forward-backward for rows of emissions (log-odds): P(abusive) of each word. A path's weight is the exponential of its
    emissions, ``start`` for each step into abuse and ``stay`` for each step within it."""
    forward, backward, *_ = _chain(e, start, stay)
    both = forward * backward
    return both[..., 1] / both.sum(-1)


def _sequences(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Sentences by length: rows of positions of the words between breaks."""
    at = np.flatnonzero(codes != BREAK)
    if not len(at):
        return {}
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    sizes = np.diff(first, append=len(at))
    starts = at[first]
    return {int(n): starts[sizes == n][:, None] + np.arange(n)[None, :] for n in np.unique(sizes)}


class Tagger:
    """Applies a field to texts; folded words are looked up once per process."""

    def __init__(self, model: Field):
        self.model = model
        self.seen: dict[str, tuple[int, int, int, tuple]] = {}

    def look_up(self, raw: str) -> tuple[int, int, int, tuple]:
        """(word code, stem code, class bits, parts of phrases) of a word, (BREAK, 0, 0, ()) of a break."""
        got = self.seen.get(raw)
        if got is None:
            if not _is_word(raw):
                got = (BREAK, 0, 0, ())
            else:
                word = fold_word(raw)
                if "*" in word:
                    word = _unmasked(word)
                got = (self.model.words.get(word, 0), self.model.stems.get(word[:STEM], 0), word_classes(word), tuple(_PARTS.find(word)))
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[raw] = got
        return got

    def codes(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word codes, stem codes and class bits of all pieces of all texts, a break after each text."""
        look, end = self.look_up, (BREAK, 0, 0, ())
        flat = [x for t in texts for x in (*map(look, t), end)]
        if not flat:
            return (np.empty(0, np.int64),) * 3
        words, stems, masks, parts = zip(*flat)
        masks = np.array(masks, np.int64)
        for i in [i for i, p in enumerate(parts) if p]:
            for phrase, k in parts[i]:
                if k == 0:
                    self._phrase(phrase, i, words, parts, masks)
        return np.array(words, np.int64), np.array(stems, np.int64), masks

    @staticmethod
    def _phrase(phrase: int, i: int, words: tuple, parts: tuple, masks: np.ndarray) -> None:
        """Marks the words of a phrase that begins at ``i``: at most GAP words between two parts, in one sentence."""
        count, bit = _PHRASES[phrase]
        at = [i]
        for k in range(1, count):
            for j in range(at[-1] + 1, at[-1] + 2 + GAP):
                if j >= len(words) or words[j] == BREAK:
                    return
                if (phrase, k) in parts[j]:
                    at.append(j)
                    break
            else:
                return
        for j in at:
            masks[j] |= bit

    def probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(abusive) of each piece of each text (0 for breaks)."""
        words, stems, masks = self.codes(texts)
        out = np.zeros(len(words))
        chain = self.model.weights["chain"]
        for at in _sequences(words).values():
            for part in np.array_split(at, max(1, at.size // 100_000)):
                s = stems[part]
                e = self.model.emission(words[part], s, self.model.pair_codes(s), _near_features(masks[part]))
                out[part] = marginals(e, chain[1], chain[2])
        return np.split(out, np.cumsum([len(t) + 1 for t in texts])[:-1]) if texts else []


def text_score(p: np.ndarray) -> float:
    """The probability of the most abusive piece."""
    return float(p.max()) if len(p) else 0.0


def _padded(groups: dict[int, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sentences in few shapes: positions (sentences, length) and which of them are real."""
    shapes: dict[int, list] = {}
    for n, at in groups.items():
        size = 4
        while size < n:
            size = size * 3 // 2
        wide = np.zeros((len(at), size), np.int64)
        wide[:, :n] = at
        shapes.setdefault(size, []).append((wide, np.broadcast_to(np.arange(size) < n, wide.shape)))
    return [(np.concatenate([a for a, _ in v]), np.concatenate([b for _, b in v])) for v in shapes.values()]


def fit(examples: list[tuple[str, int]], seeds: bool = True) -> Field:
    """Fit the field to labelled texts (text, 1 abusive or 0) and, with ``seeds``, to the sentences of ``abuse_seed``.

    No example is left out. ``WRONG_LABELS`` of the labels are taken to be wrong, whichever: a label that the others contradict
    has a bounded pull. Without texts of both kinds every score is low.
    """
    rows = [(t, int(y)) for t, y in examples if t]
    if seeds:
        rows += [(t, 0) for t in abuse_seed.HARMLESS] + [(t, 1) for t in abuse_seed.ABUSIVE]
    model = Field()
    cut = [([w for w, _, _ in pieces(t)[1]], y) for t, y in rows]
    labels = np.array([y for _, y in cut])
    if len(set(labels.tolist())) < 2:
        return model
    folded = [[_unmasked(f) if "*" in (f := fold_word(w)) else f for w in words if _is_word(w)] for words, _ in cut]
    counted: dict[str, dict] = {"words": {}, "stems": {}}
    for words in folded:
        for kind, found in (("words", set(words)), ("stems", {w[:STEM] for w in words})):
            for w in found:
                counted[kind][w] = counted[kind].get(w, 0) + 1
    model.words = {w: k + 1 for k, w in enumerate(sorted(w for w, n in counted["words"].items() if n >= 2))}
    model.stems = {w: k + 1 for k, w in enumerate(sorted(w for w, n in counted["stems"].items() if n >= 2))}
    words, stems, masks = Tagger(model).codes([t for t, _ in cut])
    owner = np.repeat(np.arange(len(cut)), [len(t) + 1 for t, _ in cut])
    both = stems[:-1] * (len(model.stems) + 1) + stems[1:]
    known, times = np.unique(both[(stems[:-1] > 0) & (stems[1:] > 0)], return_counts=True)
    model.pairs = known[times >= 2]
    w = model.weights
    w["word"], w["stem"], w["pair"] = (np.zeros(n + 1) for n in (len(model.words), len(model.stems), len(model.pairs)))
    data = []
    for at, real in _padded(_sequences(words)):
        masked = np.where(real, masks[at], 0)
        st = np.where(real, stems[at], 0)
        data.append((np.where(real, words[at], 0), st, model.pair_codes(st), _near_features(masked), real, owner[at[:, 0]]))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        none = np.zeros(len(cut))  # log P(no word abusive) of each text
        passes = []
        for ws, st, pr, near, real, own in data:
            e = np.where(real, model.emission(ws, st, pr, near), -30.0)
            forward, backward, norm, emit, trans, p1 = _chain(e, w["chain"][1], w["chain"][2])
            np.add.at(none, own, (np.log1p(-p1) - np.log(norm)).sum(1))
            passes.append((forward, backward, norm, emit, trans))
        clean = np.exp(np.minimum(none, -1e-9))
        said = np.where(labels == 1, 1 - clean, clean)
        noisy = (1 - 2 * WRONG_LABELS) * said + WRONG_LABELS
        # d(-log noisy)/d(none): the pull of a text on the expected features of its words
        pull = np.where(labels == 1, -1.0, 1.0) * (1 - 2 * WRONG_LABELS) * clean / noisy
        grad = {k: HOLD[k] * v for k, v in w.items()}
        for (ws, st, pr, near, real, own), (forward, backward, norm, emit, trans) in zip(data, passes):
            both = forward * backward
            p = np.where(real, both[..., 1] / both.sum(-1), 0.0) * pull[own][:, None]
            grad["near"] += np.einsum("nl,nlk->k", p, near)
            np.add.at(grad["word"], ws, p)
            np.add.at(grad["stem"], st, p)
            p2 = p.copy()
            p2[:, 1:] += p[:, :-1]
            np.add.at(grad["pair"], pr, p2)
            grad["chain"][0] += p.sum()
            for k, a in ((1, 0), (2, 1)):  # steps 0 -> 1 and 1 -> 1
                on = forward[:, :-1, a] * trans[a, 1] * emit[:, 1:, 1] * backward[:, 1:, 1] / norm[:, 1:]
                grad["chain"][k] += (np.where(real[:, 1:], on, 0.0) * pull[own][:, None]).sum()
        for k in ("word", "stem", "pair"):
            grad[k][0] = 0.0  # unknown ones stay neutral
        rate = 0.15 * (1 - step / (STEPS + 1)) + 0.01
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def scores(records: DataFrame, model: Field, spans: bool = False) -> DataFrame:
    """``records`` with ``texts`` (array of strings) replaced by ``score``, and by ``spans`` (part, start, end) if asked for.

    A record's score is the highest of its texts; null texts and a null array score 0. Offsets count characters of the text
    as shown: entities resolved, tags and invisible characters dropped. Other columns are passed on; repeated rows too.
    """
    kept = [c for c in records.columns if c not in ("texts", "score", "spans")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            owners, cut = [], []
            for i, texts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for part, text in enumerate(texts or ()):
                    if text:
                        owners.append((i, part))
                        cut.append(pieces(text)[1])
            out = np.zeros(batch.num_rows)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for (i, part), ps, p in zip(owners, cut, tagger.probabilities([[w for w, _, _ in ps] for ps in cut])):
                out[i] = max(out[i], text_score(p))
                if spans and len(p) and p.max() > 0.5:
                    on = np.flatnonzero(p[:-1] > 0.5)
                    for run in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                        found[i].append({"part": part, "start": ps[run[0]][1], "end": ps[run[-1]][2]})
            columns = [*batch.columns[:-1], pa.array(out)]
            if spans:
                kind = pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
                columns.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", *(["spans"] if spans else [])])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*kept).schema] + ["score double"]
    if spans:
        fields.append("spans array<struct<part:int,start:int,end:int>>")
    return records.select(*kept, "texts").mapInArrow(apply, ", ".join(fields))
