import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import mixing, packing
from threadloom.llm.languages import declared_code, detect
from threadloom.llm.tokens import TOKENIZER, counter, independent_chunks, with_token_counts


@settings(max_examples=150)
@given(st.text(alphabet=st.sampled_from("ab я5.,'s\n \t-é😀"), max_size=120), st.integers(1, 12))
def test_chunks_have_the_tokens_of_the_whole(text, size):
    chunks = independent_chunks(text, size)
    assert "".join(chunks) == text
    assert sum(map(counter(TOKENIZER), chunks)) == counter(TOKENIZER)(text)


def test_counts_of_long_texts_nulls_and_repeats(spark):
    long = "слово and word, 'tis 5 " * 9000
    rows = [(1, [long, None, "x"], "t", 0), (1, [long, None, "x"], "t", 0), (2, None, None, 0), (3, [], "u", 0), (None, ["a b", ""], "v", 0), (4, ["y" * 200_000], "w", 0)]
    df = spark.createDataFrame(rows, "id long, texts array<string>, k string, tokens int")
    count = counter(TOKENIZER)
    want = sorted(((i, k, sum(count(x) for x in t or [] if x)) for i, t, k, _ in rows), key=str)
    got = with_token_counts(df, piece=5000).collect()
    assert sorted(((r["id"], r["k"], r["tokens"]) for r in got), key=str) == want
    assert with_token_counts(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = TOKENIZER.rsplit("/", 1)[0] + "/" + name
    df = spark.createDataFrame([(1, ["hello world " * 50])], "id long, texts array<string>")
    assert with_token_counts(df, path=path, piece=100).first()["tokens"] == counter(path)("hello world " * 50)


def test_languages(spark):
    assert detect("Потом сосед по даче чинил автобус и нашёл расписание.") == "ru" and detect("За 37 гривень можна порівняти вечерю, бо так дешевше.") == "uk"
    assert detect("It is easier to compare a server than to move its price.") == "en" and detect("Der Koffer von Felrop ist modern, wenn man genug Geduld hat.") == "de"
    assert detect("Es más fácil abrir el horno que reparar el guion.") == "es" and detect("") is None and detect(None) is None and detect("42 🔥") is None
    codes = spark.createDataFrame([("RU",), ("ru-RU",), ("rus",), (" ",), (None,), ("deu",)], "c string").select(declared_code("c")).collect()
    assert [r[0] for r in codes] == ["ru", "ru", "ru", None, None, "de"]


CAPACITIES = {"short": 512, "middle": 768, "long": 1024, "full": 4096}


def test_packing_places_every_piece_once(spark):
    pick = random.Random(4)
    rows = [(k, pick.choice([0, 1, 5, 40, 300, 512, 513, 770, 1024, 3000, 4096, 4097, 20_000])) for k in range(1500)] + [(9000, None), (9001, 0)]
    parts = packing.pieces(spark.createDataFrame(rows, "doc_id long, tokens long"), 4096).cache()
    got = packing.pack(parts, CAPACITIES, rank_rows=20).collect()
    assert {(r["doc_id"], r["piece_no"]) for r in got} == {(r["doc_id"], r["piece_no"]) for r in parts.collect()} and len(got) == parts.count()
    sizes = dict(rows)
    for doc in {r["doc_id"] for r in got}:
        mine = sorted((r["token_from"], r["tokens"]) for r in got if r["doc_id"] == doc)
        assert sum(n for _, n in mine) == sizes[doc] and (sizes[doc] > 4096 or len(mine) == 1)
    fill, steps = {}, {}
    for r in got:
        fill[r["bin_kind"], r["bin_no"]] = fill.get((r["bin_kind"], r["bin_no"]), 0) + r["tokens"]
        steps.setdefault((r["bin_kind"], r["bin_no"]), set()).add(r["step_no"])
    assert all(n <= CAPACITIES[kind] for (kind, _), n in fill.items()) and all(len(s) == 1 for s in steps.values())
    assert sum(fill.values()) / sum(CAPACITIES[kind] for kind, _ in fill) > 0.97
    for kind in CAPACITIES:
        numbers = sorted(n for k, n in fill if k == kind)
        assert numbers == list(range(len(numbers)))


def test_packing_nothing_and_equal_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(packing.pieces(empty, 4096), CAPACITIES).collect() == []
    same = packing.pieces(spark.createDataFrame([(1, 100), (1, 100), (None, 100)], "doc_id long, tokens long"), 4096)
    assert len(packing.pack(same, {**CAPACITIES, "none": None}).collect()) == 3


def test_poisson_steps_have_their_mean():
    for rate, cap in ((0.3, 1), (0.9, 1), (1.0, 1), (1.7, 2), (2.0, 4), (0.001, 3), (700, 2000), (1000, 2000), (1990, 2000), (3000, 100_000)):
        assert abs(sum(1 - c for c in mixing.poisson_steps(rate, cap)) - rate) < 1e-6 * max(1, rate)


def test_mixture(spark):
    pick = random.Random(6)
    rows = [(k, pick.choice(["a", "a", "a", "b", "c", None, "other"]), pick.randint(0, 900)) for k in range(6000)]
    targets = {"a": mixing.Target(0.5, 1), "b": mixing.Target(0.3, 4), "c": mixing.Target(0.1, 2), "gone": mixing.Target(0.1, 3), "never": mixing.Target(0.0, 3)}
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    got = mixing.mix(df, targets, trials=16).collect()
    assert {r["source"] for r in got} == {"a", "b", "c"}
    used = {}
    for r in got:
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + 1
        assert r["copy_no"] <= targets[r["source"]].max_repeats and r["tokens"] > 0
    total = sum(r["tokens"] for r in got)
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(sum(r["tokens"] for r in got if r["source"] == s) / total - share) < 0.01
    assert [r["mix_key"] for r in got] == sorted(r["mix_key"] for r in got)
    assert [tuple(r) for r in mixing.mix(df.repartition(7), targets, trials=16).collect()] == [tuple(r) for r in got]
    assert mixing.mix(df.limit(0), targets).collect() == []
    plain = mixing.mix(df, targets).groupBy("source").agg({"tokens": "sum"}).collect()  # one draw: the shares carry its noise
    whole = sum(r[1] for r in plain)
    assert all(abs(r[1] / whole - {"a": 5 / 9, "b": 3 / 9, "c": 1 / 9}[r[0]]) < 0.04 for r in plain)


def test_the_source_that_limits_the_mixture():
    targets = {"a": mixing.Target(0.5, 2), "b": mixing.Target(0.4, 3), "c": mixing.Target(0.1, 1), "d": mixing.Target(0.2, 0), "e": mixing.Target(0.3, 2)}
    tokens = {"a": 1000, "b": 100, "c": 500, "d": 1}
    assert mixing.limiting_source(tokens, targets) == "b"
    assert mixing.mixture_size(tokens, targets) == pytest.approx(3 * 100 * 1.0 / 0.4)
    assert mixing.limiting_source({}, targets) is None
