"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features, smoothed by host rates.

Pages are measured in segments (lines, sentences, list entries). The trees are fitted to weak labels, pages whose
segments leave no doubt either way, on a bounded sample of them; every page is then scored, and the spam rate of its
host moves the scores that the trees are unsure of.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.languages import WORDS
from threadloom.llm.text import visible

#: Weakly labelled pages (spam and not spam each) that the trees are fitted on at most, chosen by the hash of their text.
FIT_PAGES = 2000
TREES, DEPTH, LEAST_LEAF = 25, 6, 8
#: Weight of a host's spam rate in a page's log-odds, and pages by which a host's rate is drawn to the overall one.
HOST_WEIGHT, HOST_PRIOR = 0.35, 20.0

#: Words of offers and of searches, written for this library.
COMMERCE = set(
    "купить дёшево дешево недорого цена цены оптом доставка скидка скидки акция распродажа бесплатно заказать каталог отзывы магазин "
    "интернет наличии официальный сайт продажа прайс руб рублей скачать "
    "купити дешево ціна ціни оптом доставка знижка акція розпродаж безкоштовно замовити каталог відгуки магазин наявності офіційний грн "
    "buy cheap price prices wholesale delivery discount sale free order coupon catalog reviews store shop online official stock best usd "
    "kaufen billig günstig preis preise versand rabatt angebot angebote kostenlos bestellen katalog bewertungen gutschein lager eur "
    "comprar barato precio precios envío envio descuento oferta ofertas gratis pedir catálogo catalogo opiniones tienda oficial".split()
)
QUERY = re.compile(
    r"\b(?:как выбрать|своими руками|что такое|где взять|где купить|сколько стоит|топ \d+|рейтинг|лучш(?:ий|ая|ие)|скачать|"
    r"як обрати|своїми руками|що таке|де взяти|де купити|скільки коштує|найкращ(?:ий|а|і)|завантажити|"
    r"how to choose|how to make|what is|where to (?:get|buy)|how much(?: is)?|top \d+|near me|download|best|diy|rating|"
    r"wie wählt man|was ist|wo kaufen|wo bekommt man|was kostet|selber machen|beste[rsn]?|herunterladen|in der nähe|"
    r"cómo elegir|qué es|dónde (?:comprar|conseguir)|cuánto cuesta|mejor(?:es)?|descargar|cerca de mí)\b"
)
URL = re.compile(r"(?:\b(?:https?|ftp)://|\bwww\.)[^\s<>\[\]\"']+|\[/?url[^\]]*\]", re.I)
WORD = re.compile(r"[^\W_]+")
#: Set phrases of offers whose small words are no sign of a sentence.
OFFERS = (
    "в наличии|официальный сайт|интернет магазин|в наявності|офіційний сайт|in stock|order now|online store|official site|"
    "auf lager|jetzt bestellen|en stock|sitio oficial|tienda online|en línea"
).split("|")
OFFER = re.compile(rf"\b(?:{'|'.join(OFFERS)})\b")
CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-ÞЀ-ЯҐ]{3,}\b")
#: Lines of logs (a time and a level or a named value, or a level first) and of code.
RECORD = re.compile(
    r"^[ \t]*(?:\[?(?:\d{4}[-/.]\d\d[-/.]\d\d[T ]?)?\d{1,2}:\d\d:\d\d[^\n]*?(?:\b(?:trace|debug|info|notice|warn(?:ing)?|error|fatal|critical)\b|\w=\w|\w\[\d+\]:)|"
    r"\[?(?:trace|debug|info|notice|warn(?:ing)?|error|fatal|critical)(?:\]|:)|[A-Za-z_][\w.]*\([^\n]*\)[ \t]*[;{:][ \t]*$|"
    r"(?:[A-Za-z_][\w.]* ){0,2}[A-Za-z_][\w.\[\]]*[ \t]*[-+*/:]?=[ \t]*[^\s=]|from [\w.]+ import \w|import [\w.]+;?[ \t]*$|#include[ \t]*[<\"]|"
    r"return\b[^\n]*;[ \t]*$|(?:def|func|function|fn) \w+\()",
    re.I,
)
HREF = re.compile(r"<a\s[^>]*?href\s*=\s*[\"']?([^\s\"'>]+)[^>]*>(.*?)</a>", re.I | re.S)
ENTRY = re.compile(r"\n|(?<=[.!?…])\s|[|;·•»]|(?<=\s)/(?=\s)")
MONEY = re.compile(r"\d\s*(?:руб|грн|eur\b|usd\b|euros?\b|€|\$|£|₽|₴|bucks)|[€$£]\s*\d", re.I)
GLUED = re.compile(r"[a-zß-öø-ÿа-џґ][A-ZÀ-ÖØ-ÞЀ-ЯҐ]")
FUNCTION = {w for words in WORDS.values() for w in words.split()} | set(
    "со ко во об зато через продам куплю состояние была было всё ещё свои наш ваш та те тот этот эта эти того лишь вдруг "
    "зі та ще була було продам стан meine meinen verkaufe vendo estado selling looking".split()
)
#: Endings of Slavic verb forms; words of offers and searches are looked up before.
VERB = re.compile(r"(?:вал[аи]?|л(?:ся|ась|ись)|[аиея]ть(?:ся)?|[аяє]ет(?:ся)?|[аиеяу]ти|ював|ував)$")

FEATURES = (
    "prose", "function", "commerce", "query", "links", "link_lines", "money_lines", "top_word", "top_two", "variety",
    "repeated_pairs", "glued", "short_entries", "entry_words", "separators", "capitals", "words",
)


def _is_record(line: str) -> bool:
    """A line of a log or of code, without offers, searches, links, prices or a list."""
    if not RECORD.match(line) or URL.search(line) or MONEY.search(line) or sum(map(line.count, ",|·•")) > 3:
        return False
    low = line.casefold()
    return not QUERY.search(low) and not OFFER.search(low) and all(_kind(w) != 2 for w in WORD.findall(low))


def page_features(text: str) -> list[float] | None:
    """Measures of a whole page, in the order of FEATURES; None for a page without words.

    Text in ``` fences is measured like any other. Lines of logs and code, in a fence or not, count as prose: they are for readers.
    """
    if "<" in text:
        text = HREF.sub(r" \2 \1\n", text)
    text = visible(text.replace("```", "\n") if "```" in text else text)
    urls = URL.findall(text) if "://" in text or "www." in (folded := text.casefold()) or "url" in folded else []
    bare = URL.sub(" ", text) if urls else text
    low = bare.casefold()
    words = WORD.findall(low)
    n = len(words) + len(urls)
    if not n:
        return None
    counts = Counter([w for w in words if len(w) >= 3])
    top = sorted(counts.values(), reverse=True)[:4]
    of = max(1, len(words))
    prose = short = entries = function = 0
    rest = low
    if any(map(RECORD.match, text.split("\n"))):
        kept = []
        for line in text.split("\n"):
            if _is_record(line):
                ws = WORD.findall(line.casefold())
                entries += 1
                prose += len(ws)
                function += sum(_kind(w) for w in ws)
            else:
                kept.append(line)
        rest = URL.sub(" ", "\n".join(kept)).casefold()
    entered, queries = QUERY.subn(" ", rest)
    entered, commerce = OFFER.subn(" ", entered) if any(x in entered for x in OFFERS) else (entered, 0)
    for entry in ENTRY.split(entered):
        ws = WORD.findall(entry)
        if not ws:
            continue
        entries += 1
        kinds = list(map(_kind, ws))
        telling, selling = kinds.count(1), kinds.count(2)
        function += telling
        commerce += selling
        if len(ws) < 4:
            short += 1
        elif telling >= max(1, 0.09 * len(ws)) and selling <= 0.5 * len(ws):
            prose += len(ws)
    lines = [x for x in text.split("\n") if x.strip()]
    link_lines = money_lines = 0
    priced = MONEY.search(text) is not None
    for line in lines if urls or priced else ():
        if urls and URL.search(line):
            rest = WORD.findall(URL.sub(" ", line).casefold())
            link_lines += len(rest) < 4 or not any(w in FUNCTION for w in rest)
        if priced and MONEY.search(line):
            rest = WORD.findall(line.casefold())
            money_lines += sum(w in FUNCTION for w in rest) <= 0.08 * len(rest)
    return [
        prose / n,
        function / of,
        commerce / of,
        2.0 * queries / of,
        sum(map(len, urls)) / max(1, len(text)),
        link_lines / max(1, len(lines)),
        money_lines / max(1, len(lines)),
        top[0] / of if top else 0.0,
        sum(top) / of,
        len(counts) / of**0.85,
        1.0 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        len(GLUED.findall(bare)) / of,
        short / max(1, entries),
        min(of / max(1, entries), 60.0),
        sum(bare.count(c) for c in ",;|/·•\n") / of,
        len(CAPITALS.findall(bare)) / of,
        math.log1p(n),
    ]


def weak_label(x: list[float]) -> int | None:
    """1 for a page that is spam beyond doubt, 0 for one that is beyond doubt none, else None."""
    f = dict(zip(FEATURES, x))
    tells = (
        (f["commerce"] >= 0.15) + (f["query"] >= 0.15) + (f["link_lines"] >= 0.5) + (f["links"] >= 0.4) + (f["money_lines"] >= 0.5)
        + (f["top_word"] >= 0.12) + (f["repeated_pairs"] >= 0.35) + (f["glued"] >= 0.1) + (f["separators"] >= 0.45)
    )
    if f["prose"] <= 0.4 and f["function"] < 0.3 and tells and f["words"] > math.log(7):
        return 1
    if f["prose"] >= 0.6:
        return 0
    return None


@lru_cache(maxsize=200_000)
def _kind(word: str) -> int:
    """1 for a word that tells a sentence from a list, 2 for one of offers, else 0."""
    if word in COMMERCE:
        return 2
    return int(word in FUNCTION or (len(word) > 4 and VERB.search(word) is not None))


Tree = list[tuple[int, float, int, int, float]]


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> Tree:
    """A decision tree as nodes (feature, threshold, left, right, share of spam); feature -1 is a leaf."""
    nodes: Tree = []

    def grow(at: np.ndarray, depth: int) -> int:
        me, share = len(nodes), float(np.average(y[at], weights=w[at]))
        nodes.append((-1, 0.0, -1, -1, share))
        if depth == DEPTH or len(at) < 2 * LEAST_LEAF or share in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        gini = lambda p: 2 * p * (1 - p)
        for j in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]:
            order = at[np.argsort(x[at, j], kind="stable")]
            v, c, m = x[order, j], np.cumsum(y[order] * w[order]), np.cumsum(w[order])
            k = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (k >= LEAST_LEAF) & (len(order) - k >= LEAST_LEAF)
            if not ok.any():
                continue
            left, right = c[:-1] / m[:-1], (c[-1] - c[:-1]) / (m[-1] - m[:-1])
            gain = np.where(ok, gini(share) - (m[:-1] * gini(left) + (m[-1] - m[:-1]) * gini(right)) / m[-1], 0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(j), float((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            return me
        left = x[at, best[1]] <= best[2]
        a, b = grow(at[left], depth + 1), grow(at[~left], depth + 1)
        nodes[me] = (best[1], best[2], a, b, share)
        return me

    grow(np.arange(len(y)), 0)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0, weights: np.ndarray | None = None) -> list[Tree]:
    """Bagged trees: each is grown on its own draw of the rows with replacement; ``weights`` says for how many each row stands."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(y)) if weights is None else weights
    return [_grow(x[at], y[at], w[at], rng) for at in (rng.integers(0, len(y), len(y)) for _ in range(TREES))]


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """The trees' mean share of spam for each row."""
    total = np.zeros(len(x))
    for nodes in trees:
        feature, threshold, left, right, share = (np.array(c) for c in zip(*nodes))
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += share[at]
    return total / len(trees)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, labels = [], []
        for text in batch.column(2).to_pylist():
            x = page_features(text) if text else None
            feats.append(x)
            labels.append(None if x is None else weak_label(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(feats, pa.list_(pa.float64())), pa.array(labels, pa.int32())],
            names=["doc_id", "host", "x", "weak"],
        )


def measured(pages: DataFrame) -> DataFrame:
    """(doc_id, host, x, weak) of pages (doc_id bigint, host string, text string); x is null for pages without words."""
    return pages.select("doc_id", "host", "text").mapInArrow(_measure, "doc_id long, host string, x array<double>, weak int")


def tree_scored(rows: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(doc_id, host, tree_score) of rows of ``measured``, which should be a written table: the trees' share of spam.

    In the fit a page stands for all those of its kind, so that the share of spam fitted to is that of all labelled pages, whatever
    ``fit_pages`` leaves out. Where all labelled pages are of one kind the trees say that kind for every page; where no page can be
    labelled nothing can be said, and every page with words has a null score. Pages without words score 0.
    """
    sample, weights = [], []
    labelled = {r["weak"]: r["count"] for r in rows.filter("weak is not null").groupBy("weak").count().collect()}  # two rows at most
    for kind in (0, 1):
        chosen = rows.filter(F.col("weak") == kind).select("x", "weak", F.xxhash64("x").alias("h")).orderBy("h").limit(fit_pages).collect()
        sample += chosen
        weights += [labelled[kind] / len(chosen)] * len(chosen) if chosen else []
    x, y = np.array([r["x"] for r in sample]), np.array([r["weak"] for r in sample])
    trees = fit(x, y, weights=np.array(weights)) if sample else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2).to_pylist()
            at = [i for i, v in enumerate(given) if v is not None]
            out: list[float | None] = [0.0] * len(given)
            said = predict(trees, np.array([given[i] for i in at])) if trees and at else [None] * len(at)
            for i, score in zip(at, said):
                out[i] = score
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([v is not None for v in given])], names=["doc_id", "host", "tree_score", "read"])

    return rows.select("doc_id", "host", "x").mapInArrow(apply, "doc_id long, host string, tree_score double, read boolean")


def smoothed(said: DataFrame) -> DataFrame:
    """(doc_id, host, tree_score, score) of rows of ``tree_scored``, which should be a written table.

    ``score`` is the trees' share after the spam rate of the page's host, against that of all pages, is added to the log-odds. Null
    hosts are a host of their own. Pages without words score 0, pages of which the trees say nothing have no score. Repeated rows
    are scored like any others.
    """
    host = F.coalesce("host", F.lit("\0"))
    whole = said.agg(F.avg("tree_score").alias("rate")).first()["rate"]
    overall = F.lit(whole if whole is not None else 0.0)
    rates = said.groupBy(host.alias("hk")).agg(F.sum("tree_score").alias("s"), F.count("tree_score").alias("n"))
    rates = rates.select("hk", ((F.coalesce("s", F.lit(0.0)) + HOST_PRIOR * overall) / (F.col("n") + HOST_PRIOR)).alias("rate"))
    logit = lambda p: F.log((p + 0.005) / (1.005 - p))
    odds = logit(F.col("tree_score")) + HOST_WEIGHT * (logit(F.col("rate")) - logit(overall))
    return said.join(rates, host == F.col("hk")).select(
        "doc_id", "host", "tree_score", F.when(F.col("read"), 1 / (1 + F.exp(-odds))).otherwise(F.lit(0.0)).alias("score")
    )
