import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import dedup, graph, packing, splitting, statistics, tokens

POST = "board string, thread_id long, source_path string, ord int, post_id long, text string, refs array<string>, fetched_at string"


def posts(spark, rows):
    return spark.createDataFrame([("b", t, f"b/{t}.json", k, p, text, refs, "2024-01-01") for t, k, p, text, refs in rows], POST)


def test_closure_of_a_diamond(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)], "child long, parent long")
    got = {(r["node"], r["ancestor"]) for r in graph.ancestor_closure(edges).collect()}
    assert got == {(2, 1), (3, 1), (4, 2), (4, 3), (4, 1), (5, 4), (5, 2), (5, 3), (5, 1)}
    assert graph.ancestor_closure(edges.limit(0)).collect() == []


def test_thread_drafts(spark):
    rows = [
        (1, 0, 10, "The opening question of the thread", None), (1, 1, 11, ">>10\nFirst answer to it", [">>10"]), (1, 2, 12, ">>11\nSecond answer", [">>11", ">>10"]),
        (1, 3, 13, "no parent at all", []), (1, 4, 14, ">>99 lost", [">>99"]), (1, 5, 15, "...", [">>10"]), (1, 6, 16, "пикрил", [">>10"]),
        (1, 7, 17, ">>15\nanswer to nothing", [">>15"]), (1, 8, 18, ">>10\nto the first\n>>11\nto the second", [">>10", ">>11"]), (2, 0, 20, "alone", None),
    ]
    got = {(r["post_id"], r["draft"]): r for r in graph.thread_drafts(posts(spark, rows)).collect()}
    assert {k: r["drop_reason"] for k, r in got.items()} == {
        (11, 0): None, (12, 0): None, (13, 0): "missing_reliable_parent", (14, 0): "missing_reliable_parent", (15, 0): "empty_after_cleaning", (16, 0): "image_dependent",
        (17, 0): "missing_context", (18, 0): None, (18, 1): None,
    }
    assert got[12, 0]["context_post_ids"] == [10, 11] and got[12, 0]["response"] == "Second answer"
    assert got[13, 0]["fallback_prevented"] and not got[14, 0]["fallback_prevented"]
    assert got[18, 0]["split_from_multi_reference"] and got[18, 1]["response"] == "to the second"
    assert got[18, 0]["context_post_ids"] == [10] and got[18, 0]["referenced_post_ids"] == [10]
    told = {(r["post_id"], r["draft"]): r["context"] for r in graph.with_context_texts(graph.thread_drafts(posts(spark, rows)), posts(spark, rows)).collect()}
    assert told[12, 0] == [(10, "The opening question of the thread"), (11, "First answer to it")] and told[13, 0] is None and len(told) == len(got)


def greedy(texts, least=80, similarity=0.9, anchors=4, size=3):
    """The stream rule in plain Python, with the columns' own hashes of shingles."""
    import hashlib
    import re
    import unicodedata

    number = lambda g: int(hashlib.md5(g.encode()).hexdigest()[:15], 16)
    kept, exact, out = [], set(), []
    for text in texts:
        c = " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold()))
        if len(c) < least:
            out.append("unique")
            continue
        if c in exact:
            out.append("exact_duplicate")
            continue
        w = c.split()
        s = {number(" ".join(w[i : i + size])) for i in range(len(w) - size + 1)} if len(w) >= size else set(map(number, w))
        near = any(
            set(sorted(s)[:anchors]) & set(sorted(o)[:anchors]) and min(len(c), n) / max(len(c), n) >= similarity and len(s & o) / len(s | o) >= similarity for n, o in kept
        )
        out.append("near_duplicate" if near else "unique")
        if not near:
            kept.append((len(c), s))
            exact.add(c)
    return out


def test_duplicates_in_stream_order(spark):
    pick = random.Random(3)
    base = [[pick.choice("abcdefghijklmnop") * pick.randint(2, 6) + str(pick.randint(0, 99)) for _ in range(100)] for _ in range(6)]
    texts = []
    for words in base:
        at = words
        for _ in range(8):
            texts.append(" ".join(at))
            at = list(at)
            for _ in range(pick.choice([0, 1, 1, 2])):
                at[pick.randrange(100)] = "new" + str(pick.randint(0, 999))
    texts += ["short", "short", "", texts[0].upper() + "!"]
    pick.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    got = {r["place"]: r["status"] for r in dedup.classify(df, hashing="md5").collect()}
    want = dict(enumerate(greedy(texts)))
    assert got == want and {"unique", "exact_duplicate", "near_duplicate"} <= set(want.values())


def test_duplicates_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2)], "place long, text string, key long")
    assert {(r["place"], r["status"], r["key"]) for r in dedup.classify(df).collect()} == {(1, "unique", 1), (2, "unique", 2)}
    assert dedup.classify(df.limit(0)).collect() == []


@pytest.mark.parametrize("n, want", [(20, [18, 1, 1]), (1, [0, 0, 1]), (0, [0, 0, 0])])
@pytest.mark.parametrize("buckets", [4096, 2])
def test_group_split(spark, n, want, buckets):
    rows = spark.createDataFrame([("b", t) for t in range(n) for _ in range(2)], "board string, thread_id long")
    got = splitting.assign_groups(rows, 1, buckets=buckets)
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert [counts.get(k, 0) for k in splitting.NAMES] == want
    order = sorted((__import__("hashlib").sha256(f"1:b:{t}".encode()).hexdigest(), t) for t in range(n))
    train = {t for _, t in order[: int(n * 0.9)]}
    assert {r["thread_id"] for r in got.filter("split = 'train'").collect()} == train


def test_split_checks(spark):
    rows = spark.createDataFrame([("b", 1, "train"), ("b", 1, "test"), ("c", 2, "train")], "board string, thread_id long, split string")
    assert [(r["board"], r["thread_id"], r["splits"]) for r in splitting.leaking_groups(rows).collect()] == [("b", 1, 2)]
    report = {(r["board"], r["split"]): (r["threads"], r["samples"]) for r in splitting.split_report(rows).collect()}
    assert report["c", "validation"] == (0, 0) and report[None, "train"] == (2, 2)
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x long"), spark.createDataFrame([(1,), (3,)], "x long")
    assert {tuple(r) for r in splitting.multiset_difference(a, b).collect()} == {(1, 1), (2, 1), (3, -1)}


def test_windows_and_labels(spark):
    df = spark.createDataFrame([([[4, 1, 2, 3], [5, 6], [4, 7, 8]], [5, 9, 3])], "s array<array<long>>, r array<long>")

    def window(length, **how):
        return df.select(tokens.window(F.col("s"), F.col("r"), length, **how)).first()[0]

    assert window(20) == [2, 4, 1, 2, 3, 5, 6, 4, 7, 8, 5, 9, 3]
    assert window(11) == [2, 4, 3, 5, 6, 4, 7, 8, 5, 9, 3]
    assert window(10) == [2, 5, 6, 4, 7, 8, 5, 9, 3]
    assert window(6) == [2, 4, 8, 5, 9, 3] and window(6, partial=False) is None and window(4) == [2, 5, 9, 3] and window(3) is None
    assert window(10, partial=False) == [2, 5, 6, 4, 7, 8, 5, 9, 3]
    ids, start = F.array(*(F.lit(x).cast("long") for x in (2, 4, 7, 5, 9, 3))), F.lit(4)
    shifted, labels = tokens.shifted_rows(ids, start)
    row = df.select(shifted, labels, tokens.unshifted_labels(ids, start), tokens.loss_tokens(labels), tokens.until_stop(ids, [9, 7])).first()
    assert list(row) == [[2, 4, 7, 5, 9], [-100, -100, -100, 9, 3], [-100, -100, -100, -100, 9, 3], 2, [2, 4]]


def test_packing(spark):
    rows = spark.createDataFrame([(k, [1] * n, [2] * n) for k, n in enumerate((3, 4, 2))], "k long, input_ids array<long>, labels array<long>")
    got = tokens.pack_rows(rows, "k", 8).collect()
    assert sorted(sum((r["seq_lengths"] for r in got), [])) == [2, 3, 4] and len(got) == 2
    with pytest.raises(ValueError):
        tokens.pack_rows(rows, "k", 2)
    pick = random.Random(1)
    sizes = {s: pick.randint(1, 40) for s in range(1, 60)}
    made = packing.plan(sizes, [60, 100])
    placed = {}
    for c in made:
        assert c.fill <= c.capacity
        for s, k in c.items.items():
            placed[s] = placed.get(s, 0) + k * c.bins
    assert placed == sizes


def test_padding_and_plans(spark):
    rows = spark.createDataFrame([(1, [1, 2], [3, 4]), (2, [1], [3])], "k long, input_ids array<long>, labels array<long>")
    got = tokens.padded(tokens.batches(rows, ["k"], 2), ["batch_no"]).orderBy("k").collect()
    assert got[1]["input_ids"] == [1, 0] and got[1]["attention_mask"] == [1, 0] and got[1]["labels"] == [3, -100]
    assert tokens.training_plan(17, 8, epochs=2) == (3, 6, 2) and tokens.training_plan(17, 8, max_steps=7) == (3, 7, 3)
    with pytest.raises(ValueError):
        tokens.training_plan(1, 1)
    drop = spark.createDataFrame([([5, 5, 5], 4), ([], 30)], "p array<long>, f int").select(tokens.chat_window_drop(F.col("p"), F.col("f"), 10))
    assert [r[0] for r in drop.collect()] == [2, None]


def test_bpe(spark, tmp_path):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    from threadloom.operators.chat import SPECIAL_TOKENS

    texts = spark.createDataFrame([("привет мир hello 😎 " * 4,), (None,), ("hello world",)], "text string")
    path = str(tmp_path / "bpe.json")
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    tokenizer = Tokenizer(models.BPE({**SPECIAL_TOKENS, **{c: k + 6 for k, c in enumerate(alphabet)}}, [], unk_token="<UNK>"))
    tokenizer.pre_tokenizer, tokenizer.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    tokenizer.add_special_tokens(list(SPECIAL_TOKENS))
    tokenizer.save(path)
    saved = tokens.load_tokenizer(path)
    ids = texts.select("text", tokens.bpe_ids(saved)(F.col("text")).alias("ids"))
    assert [r for r in ids.select(tokens.bpe_text(saved)(F.col("ids")).alias("t"), "text").collect() if r["t"] != r["text"]] == []


def test_distributions(spark):
    rows = spark.createDataFrame([(v,) for v in (511, 512, 513, 768, 769, 1024, 1025, None)], "v int")
    got = statistics.distribution(rows, [], "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    assert (got["count"], got["p50"], got["p90"], got["p99"], got["max"], got["median"]) == (7, 768, 1025, 1025, 1025, 768)
    fits = {r["window"]: r["samples"] for r in statistics.window_fit(rows.filter("v is not null"), "v").collect()}
    assert fits == {512: 2, 768: 4, 1024: 6}
    with pytest.raises(Exception, match="no samples"):
        statistics.window_fit(rows.limit(0), "v").collect()
    assert statistics.parameter_count() == 5_518_848


def test_no_context_is_lost_at_the_default_window(spark):
    from threadloom.plans import corpora

    total = corpora.QUERIES["token_statistics_512"](spark, "/root/testdata/sf0.01").filter("slice = 'total'").first()
    assert total["oversized_samples"] == total["truncated_samples"] == 0 and total["effective_tokens"] == total["raw_tokens"]


def test_split_answers(spark):
    from threadloom.operators.graph import split_answer

    rows = [
        (">>1 yes\nmore\n>>2 no", [1, 2], [(1, "yes\nmore"), (2, "no")]), (" >>2b \n\n>>1 a\r\n>>2 c", [1, 2, 2], [(2, "b\nc"), (1, "a")]), (">>1\nfoo\n>>2\nbar >>1 baz", [1, 2], [(1, "foo"), (2, "bar >>1 baz")]),
        (">>1 yes\n>>2", [1, 2], None), ("hi\n>>1 a\n>>2 b", [1, 2], None), (">>1 >>2 both", [1, 2], None), (">>1 a\n>>3 b", [1, 2], None), (">>1 a\n>>2 b", [1], None),
        (">>1 a\n>>99999999999999999999 b", [1, 2], None), ("", [1, 2], None), (None, [1, 2], None), ("x", None, None), (">>1 " + "long " * 9999 + "\n>>2 b", [2, 1], [(1, ("long " * 9999).strip()), (2, "b")]),
    ]
    got = spark.createDataFrame([(k, t, p) for k, (t, p, _) in enumerate(rows)], "k int, t string, p array<bigint>").select("k", split_answer("t", "p").alias("s")).orderBy("k").collect()
    assert [None if r["s"] is None else [tuple(x) for x in r["s"]] for r in got] == [want for *_, want in rows]
