import pytest
from pyspark.sql import functions as F

from threadloom.llm import pairs

Q = "Why is my old kettle so slow after I repaired the lid and moved the cable?"


@pytest.mark.parametrize("answer, empty", [
    (None, True), ("", True), ("  \n\t", True), ("​﻿", True), ("...", True), ("—", True), ("<p></p>", True), ("&nbsp;", True), ("```\n\n```", True), (">>123", True),
    ("N/A", True), ("[deleted]", True), ("(пусто)", True), ('""', True), ("null", True), ("42", False), ("Да.", False), ("No", False), ("🔥", False), ("+1", False),
])
def test_empty(answer, empty):
    assert pairs.is_empty(answer) is empty


@pytest.mark.parametrize("answer, refusal", [
    ("К сожалению, я не могу помочь с этим запросом.", True), ("Увы, как языковая модель, я не даю подобных советов.", True), ("I'm sorry, but I have to decline this one.", True),
    ("I can't help with that request.", True), ("На жаль, я мушу відмовитися від відповіді.", True), ("Leider kann ich dabei nicht helfen.", True), ("Lo siento, no puedo ayudar con eso.", True),
    ("Не могу сказать, что это плохо. Бери.", False), ("Я не могу пройти мимо, отвечу по делу. Бери второй.", False), ("К сожалению, придётся потратиться.", False),
    ("I can't complain about mine.", False), ("I can't help but love it.", False), ("No idea, sorry", False), ("Sorry, but you have it backwards.", False),
])
def test_refusal(answer, refusal):
    assert pairs.is_refusal(answer) is refusal


@pytest.mark.parametrize("answer, copy", [
    (Q, True), (Q.upper() + "!", True), ("> " + Q, True), ("You ask: " + Q, True), (Q + " " + Q, True), (Q.replace("kettle", "teapot"), True),
    ("> " + Q + "\nBecause the lid leaks.", False), ("The lid leaks, so it is slow.", False), ("", False),
])
def test_copy(answer, copy):
    assert pairs.is_copy(Q, answer) is copy


def test_language():
    russian, english = "Почему чайник так медленно работает после того, как я его чинил?", "The lid leaks, so the water is slow to boil and you have to wait."
    assert pairs.is_other_language(russian, english) and pairs.is_other_language(english, russian)
    assert not pairs.is_other_language("Переведи на английский: «Крышка течёт, и вода долго греется.»", english)
    assert not pairs.is_other_language(Q, english) and not pairs.is_other_language("", english) and not pairs.is_other_language(russian, "42")


@pytest.mark.parametrize("answer, is_open", [
    ("Take the second (it is", True), ("He said «yes", True), ("1. one\n2. two\n3.", True), ("```\ncode(", True), ("so,", True), ("a — b —", True),
    ("```\ndone()\n```", False), ("fine :)", False), ("all (of it) is fine", False), ("1) one\n2) two", False), ("yes…", False), ('"all"', False), ("no stop", False),
])
def test_open_ends(answer, is_open):
    assert pairs.open_at_end(answer) is is_open


def label(spark, samples, corpus):
    schema = "sample_no long, messages array<struct<role:string,content:string>>, label int"
    texts = spark.createDataFrame([(t,) for t in corpus], "text string")
    return {(r["sample_no"], r["pair_no"]): r["defect"] for r in pairs.labelled_pairs(spark.createDataFrame(samples, schema), texts).collect()}


def test_pairs_words_and_odd_messages(spark):
    corpus = ["The kettle has worked for years because nobody touched the lid."] * 60 + ["We waited for the kettle and touched the lid."] * 20
    samples = [
        (1, [("system", "s"), ("user", "q one"), ("assistant", "We waited for the kettle and touc"), ("user", "q"), ("assistant", "The kettle has worked for years because")], 1),
        (2, [("user", None), ("assistant", None), ("assistant", "again"), ("user", "q"), ("user", "q"), ("assistant", "We waited for the lid")], 1),
        (3, None, 1), (4, [], 1), (5, [("assistant", "first")], 1), (6, [("user", "x" * 90_000), ("assistant", "word " * 40_000 + "lid.")], 1),
    ]
    got = label(spark, samples, corpus)
    assert got == {(1, 1): "truncated", (1, 2): "truncated", (2, 1): "empty", (2, 2): None, (6, 1): None}
    assert label(spark, [], []) == {}


def test_terminal_counts(spark):
    rows = spark.createDataFrame([("A cat. The cat sat\nthe end",), (None,), ("",)], "text string")
    got = {r["word"]: (r["n"], r["ends"], r["low"], r["dots"]) for r in pairs.terminal_counts(rows).collect()}
    assert got["cat"] == (2, 1, 2, 1) and got["the"] == (2, 0, 1, 0) and got["end"] == (1, 1, 1, 0) and got["sat"] == (1, 1, 1, 0)


@pytest.mark.parametrize("question, answer, copy", [
    ("how are you", "How are you?", True), ("what is this", "What is this", True), ("how do i fix it", "How do I fix it?", True), ("how do i fix it", "how do i repair it", True),
    ("where to buy tea", "You asked: where to buy tea", True), ("Why?", "Why?", True), ("And now?", "and now", True), ("And now?", "And now? And now?", True),
    ("And now?", "And then?", False), ("Why?", "Why not?", False), ("how are you", "I am fine, and how are you", False), ("Why?", "Because.", False),
])
def test_copies_of_short_questions(question, answer, copy):
    assert pairs.is_copy(question, answer) is copy


def test_only_the_requested_language_is_exempt():
    german = "Der Deckel ist alt und das Wasser wird nicht warm, weil die Dichtung fehlt."
    spanish = "La tapa es vieja y el agua no se calienta, porque falta la junta de la olla."
    asks = "Please translate this sentence into German: the lid is old and the water does not get warm."
    assert pairs.is_other_language(asks, spanish) and not pairs.is_other_language(asks, german)
    mentions = "What is the word for this in English, and why does the water not get warm?"
    assert pairs.is_other_language(mentions, spanish) and not pairs.is_other_language(mentions, "It is the lid, and the water is not warm.")
    assert not pairs.is_other_language("Please translate this for me, it is from the old book of my friend.", spanish)
    assert not pairs.is_other_language("How do I say this in French, and what is the word for it?", spanish)


@pytest.mark.parametrize("answer, refusal", [
    ("Sorry. I see that it matters to you. It is a hard one. I can't help with that.", True),
    ("I understand that you have waited for a long time and that this question about the kettle and its lid matters to you and to the whole house, "
     "and I know how hard it is to find somebody who knows old kettles well, yet I am not able to discuss it and I have to decline this request.", True),
    ("Take the lid off. Then boil the water twice. Clean the seal with a soft cloth. Let it dry. Put it back and wait a day before you use it again, as the glue must set. I can't help with the cable. " * 3, False),
])
def test_refusals_are_told_by_their_share_of_the_text(answer, refusal):
    assert pairs.is_refusal(answer) is refusal


def test_long_introductions():
    told = "You have asked me something like the following for the third time this week already: "
    assert pairs.is_copy(Q, told + Q) and not pairs.is_copy(Q, told + "it is the lid that leaks, so the water never gets warm in it")
    assert pairs.is_copy(Q, f"He said: you ask: «{Q}»")
