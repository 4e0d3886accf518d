import random

import numpy as np
import pytest

import wordings
from threadloom.llm import abuse, spam
from threadloom.llm.q_abuse import THRESHOLD

EXAMPLES = [
    ("you are an idiot and everyone knows it", 1), ("shut your mouth, asshole", 1), ("I want to fuck you all night", 1), ("kill yourself, moron", 1),
    ("Tulvins are vermin, not people", 1), ("сдохни уже, тварь", 1), ("скинь голые сиськи в личку", 1),
    ("the kettle is slow but the lid is fine", 0), ("I am such an idiot, I forgot to save the file", 0), ("we had to kill the process on the server", 0),
    ("за оскорбления дают бан на трое суток", 0), ("врач объяснил, что осмотр груди нужен раз в год", 0), ("сосед чинил автобус и остался доволен", 0),
] * 6


def _examples(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/abuse_examples.parquet").filter("text is not null").orderBy("example_id", "text").collect()
    return [(r["text"], r["is_abusive"]) for r in rows]


@pytest.fixture(scope="module")
def tagger(spark):
    return abuse.Tagger(abuse.fit(_examples(spark)))


def score(tagger, text):
    return abuse.text_score(tagger.probabilities([[w for w, _, _ in abuse.pieces(text)[1]]])[0])


@pytest.mark.parametrize("text", [
    "You are an asshole and everyone knows it!", "what a pathetic b4st4rd you are", "you are a m o r o n", "ты д.е.б.и.л, закрой рот", "сдохни, yблюдoк", "ты и\u200bдиот, закрой рот",
    "Иди нахуй отсюда, дебббббил", "ты мудак и т в а р ь", "send me your n@k3d tits", "du bist ein Arschloch, halt die Fresse", "с к и н ь с и с ь к и", "закрой рот, деб*л",
])
def test_plain_and_disguised(tagger, text):
    assert score(tagger, text) > 0.5


@pytest.mark.parametrize("text", [
    "", "the router is modern but the price is high", "I am such an idiot, I forgot the keys", "The daemon kept killing its child processes", "у собаки течка, а сука родила пятерых щенков",
    "жёсткий диск сдох, плата перегрелась", "Тулвинцы открыли пекарню, хлеб отличный", "команда решила употреблять мандарины", ">>1234567", "5 000 000", "п о д с т р а х у й", "у р о д и л с я",
    *wordings.REVIEWED,
])
def test_harmless(tagger, text):
    assert score(tagger, text) < 0.5


def test_spelt_words_are_cut_where_known_words_meet():
    cut = lambda text: [w for w, _, _ in abuse.pieces(text)[1]]
    assert cut("она с о с а л а у него") == ["она", "сосала", "у", "него"]
    assert cut("ты и д и о т") == ["ты", "идиот"] and cut("t y p i c a l") == ["typical"]


def test_wordings_never_seen(tagger):
    """Sentences that neither the word classes nor the fit were written from: most abusive ones are found, hardly any other."""
    assert sum(score(tagger, t) >= THRESHOLD for t in wordings.REVIEWED + wordings.HARMLESS) <= 4
    assert sum(score(tagger, t) >= THRESHOLD for t in wordings.ABUSIVE) >= 0.85 * len(wordings.ABUSIVE)


def test_the_fit_decides():
    """Every weight comes from the labels: turned around, they turn the decisions around, and without them nothing is abusive."""
    turned = abuse.Tagger(abuse.fit([(t, 1 - y) for t, y in EXAMPLES], seeds=False))
    right = abuse.Tagger(abuse.fit(EXAMPLES, seeds=False))
    for text, y in EXAMPLES[:13]:
        assert (score(right, text) > 0.5) == bool(y) and (score(turned, text) > 0.5) != bool(y)
        assert score(abuse.Tagger(abuse.Field()), text) < 0.1


def test_a_wrong_label_is_outvoted():
    wrong = ("the kettle is slow but the lid is fine", 1)
    found = abuse.Tagger(abuse.fit(EXAMPLES * 4 + [wrong], seeds=False))
    assert score(found, wrong[0]) < 0.5


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(0)
    e, start, stay = rng.normal(size=(3, 6)), -0.6, 0.8
    got = abuse.marginals(e, start, stay)
    for row, p in zip(e, got):
        total, on = 0.0, np.zeros(6)
        for path in range(64):
            y = [(path >> k) & 1 for k in range(6)]
            steps = sum(start if not a else stay for a, b in zip(y, y[1:]) if b)
            w = np.exp(sum(v for v, k in zip(row, y) if k) + steps)
            total, on = total + w, on + w * np.array(y)
        assert np.allclose(p, on / total)


def test_scores_of_a_table(spark):
    model = abuse.fit(EXAMPLES)
    rows = [(1, ["fine day", "you are an idiot and everyone knows it"], "x"), (1, ["fine day", "you are an idiot and everyone knows it"], "x"), (2, None, None), (3, [None, ""], "y"), (4, ["слово " * 50_000], "z")]
    df = spark.createDataFrame(rows, "record_id long, texts array<string>, score string")
    got = abuse.scores(df, model, spans=True).collect()
    assert len(got) == 5 and [r["score"] > 0.5 for r in sorted(got, key=lambda r: r["record_id"])] == [True, True, False, False, False]
    span = got[0]["spans"][0] if got[0]["record_id"] == 1 else None
    assert span is None or (span["part"] == 1 and "idiot" in rows[0][1][1][span["start"] : span["end"]])
    assert abuse.scores(df.limit(0), model).collect() == []
    assert abuse.fit([], seeds=False).words == {}


PROSE = ["Вчера сосед чинил автобус, и это заметно с первого раза.", "My brother told me to check the router carefully, because it is cheaper that way.", "Der Motor ist gut, wenn man genug Geduld hat.", "Если купить суп заранее, то он прослужит дольше."]
WORDS = ["роутер", "кэш", "motor", "album", "oven", "лента"]


def page(pick, kind):
    w = [pick.choice(WORDS) for _ in range(40)]
    if kind == "prose":
        return " ".join(pick.choices(PROSE, k=6))
    if kind == "keywords":
        return ", ".join(f"купить {x} дёшево" for x in w)
    if kind == "links":
        return "\n".join(f"{x} - https://{x}{k}.example/p/{k}" for k, x in enumerate("abcdefghijkl"))
    if kind == "tags":
        return "tags: " + " · ".join(x + "Zorliix" for x in w)
    return "\n".join(f"{x} Zor A{k} — {k * 7} руб. ***" for k, x in enumerate(w))


def test_spam_pages(spark):
    pick = random.Random(8)
    kinds = [pick.choice(["prose"] * 3 + ["keywords", "links", "tags", "goods"]) for _ in range(400)]
    rows = [(k, pick.choice(["a", "b", None]), page(pick, kind)) for k, kind in enumerate(kinds)] + [(1000, "a", None), (1001, None, "  "), (1002, "a", page(pick, "keywords") * 200)]
    measured = spam.measured(spark.createDataFrame(rows, "doc_id long, host string, text string")).cache()
    got = {r["doc_id"]: r["score"] for r in spam.smoothed(spam.tree_scored(measured).cache()).collect()}
    assert len(got) == len(rows) and got[1000] == got[1001] == 0.0 and got[1002] > 0.5
    assert np.mean([(got[k] > 0.5) == (kind != "prose") for k, kind in enumerate(kinds)]) > 0.98
    assert spam.smoothed(spam.tree_scored(measured.limit(0))).collect() == []


@pytest.mark.parametrize("text", [
    "v1.0.2: Если купить суп заранее, то он прослужит дольше.\nv1.0.3: Вчера сосед чинил автобус, и это заметно.", "Продам кота, состояние хорошее, цена 77 рублей, если хватает терпения.",
    "09:13 - Der Motor ist gut, wenn man genug Geduld hat.\n09:20 - Mein Bruder hat den Ofen gesehen und fand ihn gut.",
    "See how the lid is fixed, it is easy to follow. https://a.example/x\nThis one is about the cable and what to do with it. https://b.example",
])
def test_lists_for_readers_are_no_spam(text):
    assert spam.weak_label(spam.page_features(text)) == 0


STUFFED = ", ".join(f"купить {x} дёшево" for x in WORDS[:12])
LOGGED = "\n".join(f"0{k}:36:2{k} WARN zorn{k}: retry={k}" for k in range(9))


@pytest.mark.parametrize("text", [
    f"```\n{STUFFED}\n```", f"```{STUFFED}", f"``` {STUFFED} ```\n{STUFFED}", "Вчера сосед чинил автобус.\n```\n" + f"{STUFFED}\n" * 5,
    "```\n" + "\n".join(f"0{k}:36:2{k} WARN купить дёшево zorn{k}: a={k}" for k in range(9)) + "\n```",
])
def test_fenced_text_is_measured(text):
    assert spam.page_features(text)[-1] > spam.page_features("Вчера сосед чинил автобус.")[-1]
    assert spam.weak_label(spam.page_features(text)) == 1


@pytest.mark.parametrize("text", [
    f"```\n{LOGGED}\n```", LOGGED, f"Вчера сосед чинил автобус, и это заметно.\n```\n{LOGGED}",
    "```python\nimport os\nfrom os import path\nx = path.join(a)\ndef f(x):\n    y = x[1]\n    g(x, y);\n```",
])
def test_logs_and_code_are_for_readers(text):
    assert spam.weak_label(spam.page_features(text)) == 0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((600, 5))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.6)).astype(int)
    trees = spam.fit(x[:400], y[:400])
    assert np.mean((spam.predict(trees, x[400:]) > 0.5) == y[400:]) > 0.93


def test_held_out_examples(spark):
    """Fitted on four fifths of the labelled examples, some of whose labels are wrong, and scored on the rest."""
    rows = spark.read.parquet("/root/testdata/sf0.001/abuse_examples.parquet").orderBy("example_id").collect()
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    found = abuse.Tagger(abuse.fit([(r["text"], r["is_abusive"]) for k, r in enumerate(rows) if k % 5]))
    assert np.mean([(score(found, r["text"]) >= THRESHOLD) == bool(r["is_abusive"]) for r in held]) > 0.94


def test_share_of_spam_is_kept_by_the_sample(spark):
    rng = np.random.default_rng(4)
    of = lambda k, n, weak: [(k + j, "a", [float(weak if rng.random() < 0.7 else 0.5), float(rng.random())], weak) for j in range(n)]
    rows = spark.createDataFrame(of(0, 2000, 0) + of(2000, 200, 1), "doc_id long, host string, x array<double>, weak int").cache()
    unsure = {r["doc_id"] for r in rows.filter("x[0] = 0.5").collect()}
    for fit_pages in (100, 5000):
        got = [r["tree_score"] for r in spam.tree_scored(rows, fit_pages).collect() if r["doc_id"] in unsure]
        assert 0.03 < np.mean(got) < 0.2


def test_pages_of_one_kind_and_of_none(spark):
    schema = "doc_id long, host string, x array<double>, weak int"
    rows = lambda weak: spark.createDataFrame([(k, None, [0.1 * k, 1.0], weak) for k in range(20)] + [(99, "a", None, None)], schema)
    for weak, want in ((0, 0.0), (1, 1.0), (None, None)):
        got = {r["doc_id"]: r for r in spam.smoothed(spam.tree_scored(rows(weak))).collect()}
        assert len(got) == 21 and got[99]["score"] == 0.0 and got[3]["tree_score"] == want
        assert got[3]["score"] is None if want is None else abs(got[3]["score"] - want) < 0.05


def test_a_host_moves_the_pages_that_the_trees_call_clean(spark):
    said = spark.createDataFrame([(k, "bad", 1.0 if k < 90 else 0.0, True) for k in range(100)] + [(k, "good", 0.0, True) for k in range(100, 1000)], "doc_id long, host string, tree_score double, read boolean")
    got = {r["doc_id"]: r["score"] for r in spam.smoothed(said).collect()}
    assert got[95] > got[500] > 0.0 and got[95] < 0.5
