import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from threadloom.llm import overlap, q_overlap, splits


def components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for record, entity in rows:
        if record is not None:
            find(("r", record))
            if entity is not None:
                parent[find(("r", record))] = find(("e", entity))
    groups = {}
    for record, _ in rows:
        if record is not None:
            groups.setdefault(find(("r", record)), set()).add(record)
    return {r: min(g) for g in groups.values() for r in g}


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "record long, entity string, component long") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "record long, entity string")
    return {r["record"]: r["component"] for r in splits.related_groups(df).collect()}


def test_components_equal_union_find(spark):
    pick = random.Random(2)
    rows = [(pick.randint(0, 150), pick.choice([None, f"e{pick.randint(0, 120)}"])) for _ in range(260)]
    rows += [(None, "e1"), (7, None), (7, None)] + [(k, f"chain{j}") for k in range(200, 260) for j in (k, k + 1)] + [(k, "hot") for k in range(300, 420)]
    assert grouped(spark, rows) == components(rows)


def test_components_of_nothing_and_clashing_columns(spark):
    assert grouped(spark, []) == {}
    assert grouped(spark, [(2, "a", 9), (1, "a", 9)]) == {1: 1, 2: 1}


def test_author_and_thread_keys(spark):
    samples = spark.createDataFrame(
        [(1, "2024-01-01", (5, 50, "name !abc ")), (1, "2024-01-02", (6, 50, "!abc")), (2, None, (None, 70, "!ABC")), (3, None, (None, 71, "Аноним")), (4, None, (None, None, "!")), (None, None, (1, 1, "!x"))],
        "sample_no long, loaded_at string, metadata struct<thread_id:long,assistant_post_id:long,author_tag:string>",
    )
    posts = spark.createDataFrame([(70, 8, "2024-01-01"), (70, 9, "2024-01-02"), (80, 1, None)], "post_id long, thread_id long, fetched_at string")
    got = {r["sample_no"]: (r["thread_id"], r["author"]) for r in splits.sample_entities(samples, posts).collect()}
    assert got == {1: (6, "!abc"), 2: (9, "!ABC"), 3: (None, None), 4: (None, None)}


def test_shares(spark):
    sizes = [(0, 3000)] + [(k, k % 3 + 1) for k in range(1, 4000)]
    groups = spark.createDataFrame(sizes, "component long, n long")
    shares = {"train": 0.9, "validation": 0.05, "test": 0.05}
    got = {r["component"]: r["split_name"] for r in splits.assign_splits(groups, shares, place_above=0.002).collect()}
    assert sorted(got) == [c for c, _ in sizes]
    total = sum(n for _, n in sizes)
    for name, share in (("train", 0.9), ("validation", 0.05), ("test", 0.05)):
        assert abs(sum(n for c, n in sizes if got[c] == name) / total - share) < 0.003
    assert splits.assign_splits(groups.limit(0), {"train": 1.0}).collect() == []
    with pytest.raises(ValueError):
        splits.assign_splits(groups, {})
    # hashing alone: one more record moves only groups next to a cut, whatever share a group has
    hashed = lambda sizes: {r["component"]: r["split_name"] for r in splits.assign_splits(spark.createDataFrame(sizes, "component long, n long"), shares).collect()}
    before, after = hashed(sizes), hashed([(0, 3000), (1, 17), (2, 19), *sizes[3:]])
    assert sum(before[k] != after[k] for k in before) < 20 and set(before.values()) == set(shares)


def test_more_splits_than_allowed_are_refused(spark):
    rows = spark.createDataFrame([(str(k), 1.0) for k in range(1002)], "split_name string, split_share double")
    with pytest.raises(ValueError):
        splits.bounded(rows, 1000)
    assert len(splits.bounded(rows, 1002)) == 1002


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_edit_distance(a, b):
    assert overlap.edit_distance(a, b) == slow_distance(a, b)


def test_overlap_equals_all_pairs(spark):
    pick = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [[pick.choice(words) for _ in range(pick.choice([39, 40, 44, 60, 200]))] for _ in range(14)]
    rows = []
    for k in range(120):
        at = list(pick.choice(base))
        for _ in range(pick.randint(0, len(at) // 8)):
            i = pick.randrange(len(at))
            edit = pick.choice("ard")
            at[i : i + 1] = {"a": [at[i], "new"], "r": ["other"], "d": []}[edit]
        rows.append((k, pick.choice([True, False, False, None]), "b", "test", [" ".join(at).upper() + "!", None]))
    rows += [(500, True, None, None, None), (501, False, None, None, []), (None, True, None, None, ["x"]), (502, True, "b", "test", [" ".join(base[0])]), (503, False, "b", "train", [" ".join(base[0])])]
    df = spark.createDataFrame(rows, "record long, eval boolean, source string, split_name string, texts array<string>")
    texts = overlap.read_texts(df).cache()
    got = {(r["train"], r["eval"]) for r in overlap.overlap_pairs(texts, overlap.matching_classes(texts)).collect()}
    said = {r[0]: (r[1], " ".join(t for t in r[4] or [] if t).lower().replace("!", "").split()) for r in rows if r[0] is not None}
    want = {
        (a, b) for a, (ea, x) in said.items() for b, (eb, y) in said.items()
        if ea is False and eb is True and min(len(x), len(y)) >= 40 and slow_distance(x, y) <= max(len(x), len(y)) // 10
    }
    assert got == want and len(want) > 20
    assert overlap.matching_classes(texts.limit(0)).collect() == []


def test_overlap_is_counted_on_both_sides(spark):
    text = lambda k, n=50: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [
        (1, False, "a", "train", [text(1)]), (2, False, "a", "train", [text(1)]), (3, False, "b", "train", [text(1) + " new"]), (4, False, "b", "train", [text(2)]),
        (5, True, "a", "test", [text(1)]), (6, True, "c", "validation", [text(1)]), (7, True, "c", "validation", [text(3)]),
    ]
    df = spark.createDataFrame(rows, "record long, eval boolean, source string, split_name string, texts array<string>")
    texts = overlap.read_texts(df).cache()
    got = {tuple(r) for r in q_overlap.overlap_report(texts, overlap.matching_classes(texts).cache()).collect()}
    assert got == {("train", "a", 2, 2, 4), ("train", "b", 2, 1, 2), ("test", "a", 1, 1, 3), ("validation", "c", 2, 1, 3)}
