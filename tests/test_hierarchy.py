import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadloom.operators import hierarchy as H

TINY = H.Limits(bucket_bits=2, block_rows=7, solve_rows=3, path_span=4)


def brute(parents):
    """{node: (root, depth)} by walking up from every node."""
    out = {}
    for node in parents:
        chain, at = [node], parents[node]
        while at is not None and at not in chain:
            chain.append(at)
            at = parents[at]
        if at is None:
            out[node] = (chain[-1], len(chain) - 1)
        else:
            out[node] = (min(chain[chain.index(at) :]), -1)
    return out


def tree(spark, rows, limits, **how):
    df = spark.createDataFrame(rows, "node_id long, parent_id long")
    return {r["node_id"]: r for r in H.hierarchy(df, limits=limits, **how).collect()}


@pytest.mark.parametrize("limits", [H.DEFAULT, TINY])
def test_random_forests_with_loops(spark, limits):
    pick = random.Random(7)
    nodes = pick.sample(range(-50, 400), 90)
    rows = [(n, pick.choice(nodes) if pick.random() < 0.3 else pick.choice([None, *[m for m in nodes if m < n]])) for n in nodes]
    got = tree(spark, rows, limits)
    want = brute(dict(rows))
    assert {n: (r["root_id"], r["depth"]) for n, r in got.items()} == want
    df = spark.createDataFrame(rows, "node_id long, parent_id long")
    paths = {r["node_id"]: r["path"] for r in H.with_paths(H.hierarchy(df, limits=limits), limits).collect()}
    parents = dict(rows)
    for node, path in paths.items():
        assert path[-1] == node and path[0] == want[node][0]
        assert all(parents[b] == a for a, b in zip(path, path[1:]))
    below = {n: sum(n in p[:-1] for p in paths.values()) for n in paths}
    assert {n: r["n_below"] for n, r in got.items()} == below


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 11)), min_size=12, max_size=12))
def test_any_functional_graph(spark, parents):
    rows = list(enumerate(parents))
    got = tree(spark, rows, TINY)
    assert {n: (r["root_id"], r["depth"]) for n, r in got.items()} == brute(dict(rows))


def test_long_chain_and_one_hot_parent(spark):
    chain = [(0, None)] + [(k, k - 1) for k in range(1, 300)] + [(1000 + k, 5) for k in range(300)]
    got = tree(spark, chain, TINY)
    assert got[299]["depth"] == 299 and got[1299]["depth"] == 6 and got[0]["n_below"] == 599


def test_nulls_repeats_missing_parents_and_self_loops(spark):
    rows = [(1, None), (1, None), (2, 1), (2, 9), (None, 1), (3, 77), (4, 4)]
    got = tree(spark, rows, H.DEFAULT)
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[2]["parent_id"], got[2]["depth"]) == (1, 1)  # the smallest parent of repeated rows
    assert got[3]["parent_id"] is None and got[3]["depth"] == 0  # a parent that is no node is none
    assert (got[4]["root_id"], got[4]["depth"], got[4]["parent_id"]) == (4, -1, 4)


def test_empty_table_and_clashing_columns(spark):
    assert tree(spark, [], H.DEFAULT) == {}
    df = spark.createDataFrame([(1, None, 5, "x"), (2, 1, 6, "y")], "node_id long, parent_id long, n long, far string")
    assert {(r["node_id"], r["depth"]) for r in H.hierarchy(df).collect()} == {(1, 0), (2, 1)}


def test_loop_members_and_descendants(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "node_id long, parent_id long")
    found = H.hierarchy(df)
    assert {r["node_id"] for r in H.on_loop(found).collect()} == {1, 2, 3}
    pairs = {(r["ancestor_id"], r["node_id"], r["distance"]) for r in H.descendants(H.with_paths(found)).collect()}
    assert (5, 6, 1) in pairs and (3, 4, 1) in pairs


def test_reply_links(spark):
    rows = [
        (1, 10, None, "2024-01-02"), (2, 10, [">>1"], "2024-01-01"), (2, 10, [">>9", ">>1x", None, ">>1", ">>2"], "2024-01-05"),
        (3, 11, [">>1", ">>3"], "2024-01-01"), (4, 10, [">>99999999999999999999", ">>2 "], None), (None, 10, [">>1"], "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, "post_id long, thread_id long, refs array<string>, fetched_at string")
    got = {r["post_id"]: r["parent_id"] for r in H.reply_links(df).collect()}
    assert got == {1: None, 2: 1, 3: 3, 4: None}
