"""Full hierarchies from parent-child rows: loops, roots, depths, paths and descendants.

The method is leaf peeling, Euler tours and parallel list ranking:

1. *Peeling.* Blocks of rows strip leaves until only loops are left. What leaves a block is contracted to one pointer per
   node, and the contracted pointers are peeled in turn. Each loop is opened at its smallest node.
2. *Tours.* Every node is entered and left once. Windows over (parent, id bucket) order siblings, so that a parent with
   a third of all rows as children is spread over many tasks; buckets are then stitched together.
3. *List ranking.* Each block ranks its stretch of the tours and points to the first place outside. Only places that other
   blocks point to are ranked globally, by one bounded task or, beyond ``Limits.solve_rows``, by pointer doubling.
4. Entry and exit places give depth, root and the number of descendants; a scan in tour order with a stack gives paths.

No task holds more than a block, whatever the size of a tree, and rounds grow with the logarithm of the contracted lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.blocks import arrow_blocks
from threadloom.stages import Stage


@dataclass(frozen=True)
class Limits:
    """``bucket_bits``: ids that agree above these bits share a block where possible. ``block_rows``: rows a task ranks at
    once. ``solve_rows``: contracted pointers one task may solve. ``path_span``: tour places in a block of the path scan."""

    bucket_bits: int = 16
    block_rows: int = 200_000
    solve_rows: int = 1_000_000
    path_span: int = 1 << 17


DEFAULT = Limits()
_NONE = np.iinfo(np.int64).min


def _ints(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    if column.null_count:
        column = column.fill_null(_NONE)
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _or_null(values: np.ndarray, absent: np.ndarray) -> pa.Array:
    return pa.array(values, type=pa.int64(), mask=absent)


def _place(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted ``known``, -1 where it isn't there."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def _peel(up: np.ndarray) -> np.ndarray:
    """Which nodes stay after leaves are stripped again and again from the pointers ``up`` (-1: none): those on loops."""
    alive = np.ones(len(up), bool)
    degree = np.bincount(up[up >= 0], minlength=len(up))
    leaves = np.flatnonzero(degree == 0)
    while len(leaves):
        alive[leaves] = False
        above = up[leaves]
        above = above[above >= 0]
        np.subtract.at(degree, above, 1)
        above = np.unique(above)
        leaves = above[degree[above] == 0]
    return alive


def _follow(up: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of each pointer chain (ends point to themselves) and the smallest ``low`` on the way, the end included."""
    low = low.copy()
    for _ in range(max(1, math.ceil(math.log2(len(up) + 1)) + 1)):
        low = np.minimum(low, low[up])
        nxt = up[up]
        if np.array_equal(nxt, up):
            break
        up = nxt
    return up, low


def _loop_minima(up: np.ndarray, on_loop: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest ``low`` of each loop."""
    at = np.flatnonzero(on_loop)
    if not len(at):
        return np.empty(0, np.int64)
    renumber = np.full(len(up), -1)
    renumber[at] = np.arange(len(at))
    _, least = _follow(renumber[up[at]], low[at])
    return np.unique(least)


_PEELED = T.StructType([T.StructField(c, T.LongType()) for c in ("loop", "n", "far", "low")])


def _peel_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of (n, p): the smallest node of each loop in the block, and per node whose chain leaves it where it leads."""
    n, p = _ints(table, "n"), _ints(table, "p")
    order = np.argsort(n, kind="stable")
    n, p = n[order], p[order]
    up = np.where(p == _NONE, -1, _place(n, p))
    loops = _loop_minima(up, _peel(up), n)
    leaving = (up < 0) & (p != _NONE)
    own = np.arange(len(n))
    end, low = _follow(np.where(up < 0, own, up), n)
    out = np.flatnonzero(leaving[end])
    pad = len(loops) + len(out)
    first = np.arange(pad) < len(loops)
    yield pa.RecordBatch.from_arrays(
        [
            _or_null(np.concatenate([loops, np.zeros(len(out), np.int64)]), ~first),
            _or_null(np.concatenate([np.zeros(len(loops), np.int64), n[out]]), first),
            _or_null(np.concatenate([np.zeros(len(loops), np.int64), p[end[out]]]), first),
            _or_null(np.concatenate([np.zeros(len(loops), np.int64), low[out]]), first),
        ],
        names=["loop", "n", "far", "low"],
    )


def _solve_loops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        n, far, low = (_ints(table, c) for c in ("n", "far", "low"))
        order = np.argsort(n)
        n, far, low = n[order], far[order], low[order]
        up = _place(n, far)
        yield pa.RecordBatch.from_arrays([pa.array(_loop_minima(up, _peel(up), low))], names=["loop"])


def _contracted_loops(edges: DataFrame, limits: Limits) -> tuple[DataFrame | None, list[Stage]]:
    """Smallest node of each loop of the contracted pointers (n -> far, smallest node in between: low)."""
    stages: list[Stage] = []
    rounds = 0
    most = None
    while True:
        # Peel: keep what something points to and what leads on.
        heads = edges.select(F.col("far").alias("n")).distinct()
        tails = edges.select(F.col("n").alias("far"))
        kept = Stage(edges.join(heads, "n", "left_semi").join(tails, "far", "left_semi").select("n", "far", "low"), "peel")
        stages.append(kept)
        left = kept.df.count()
        most = left if most is None else most
        if left == 0:
            return None, stages
        if left <= limits.solve_rows:
            return kept.df.repartition(1).mapInArrow(_solve_loops, "loop long"), stages
        if rounds > math.log2(most) + 1:  # every pointer has gone round its loop
            on_loop = kept.df.select(F.col("far").alias("n")).distinct()
            return kept.df.join(on_loop, "n", "left_semi").select(F.col("low").alias("loop")).distinct(), stages
        onward = kept.df.select(F.col("n").alias("far"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        edges = kept.df.join(onward, "far").select("n", F.col("far2").alias("far"), F.least("low", "low2").alias("low"))
        rounds += 1


_RANKED = T.StructType(
    [T.StructField("n", T.LongType())]
    + [T.StructField(f"{c}{side}", T.LongType()) for side in (0, 1) for c in ("steps", "sum", "far", "side")]
    + [T.StructField("root", T.LongType())]
)


def _rank(succ: np.ndarray, *costs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per element the end of its stretch (``succ`` -1 ends one) and each cost summed on the way, the end's left out."""
    moves = succ >= 0
    nxt = np.where(moves, succ, np.arange(len(succ)))
    passed = [np.where(moves, cost, 0) for cost in costs]
    while True:
        onward = nxt[nxt]
        if np.array_equal(onward, nxt):
            return nxt, *passed
        passed = [x + x[nxt] for x in passed]
        nxt = onward


def _rank_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Tour elements (n, side, t, tside): each node's two places, ranked as far as the block reaches."""
    n, side, t, tside = (_ints(table, c) for c in ("n", "side", "t", "tside"))
    nodes = np.unique(n)
    m = len(nodes)
    at = np.searchsorted(nodes, n) * 2 + side
    succ = np.full(2 * m, -1, np.int64)
    succ[0::2] = np.arange(m) * 2 + 1  # a leaf is left right after it is entered
    far, far_side = np.full(2 * m, _NONE), np.zeros(2 * m, np.int64)
    inside = _place(nodes, t)
    inside = np.where(t == _NONE, -1, inside)
    succ[at] = np.where(inside >= 0, inside * 2 + tside, -1)
    outside = (inside < 0) & (t != _NONE)
    far[at[outside]], far_side[at[outside]] = t[outside], tside[outside]
    weight = np.where(np.arange(2 * m) % 2 == 0, 1, -1)
    end, steps, passed = _rank(succ, np.ones(2 * m, np.int64), weight)
    passed = passed + weight[end]
    leads_out = far[end] != _NONE
    steps = steps + leads_out
    columns = [pa.array(nodes)]
    for s in (0, 1):
        out = leads_out[s::2]
        columns += [
            pa.array(steps[s::2]),
            pa.array(passed[s::2]),
            _or_null(far[end[s::2]], ~out),
            _or_null(far_side[end[s::2]], ~out),
        ]
    known = np.where(leads_out[0::2], end[1::2], end[0::2]) // 2
    columns.append(_or_null(nodes[known], leads_out[0::2] & leads_out[1::2]))
    yield pa.RecordBatch.from_arrays(columns, names=_RANKED.names)


def _solve_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        n, side, steps, total, far, fside, root = (_ints(table, c) for c in ("n", "side", "steps", "sum", "far", "fside", "root"))
        order = np.lexsort((side, n))
        n, side, steps, total, far, fside, root = (x[order] for x in (n, side, steps, total, far, fside, root))
        nodes = np.unique(n)
        slot = np.full(2 * len(nodes), -1, np.int64)
        slot[np.searchsorted(nodes, n) * 2 + side] = np.arange(len(n))
        ends = far == _NONE
        succ = np.where(ends, -1, slot[np.where(ends, 0, _place(nodes, far) * 2 + fside)])
        end, steps_on, total_on = _rank(succ, steps, total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(n), pa.array(side), pa.array(steps_on + steps[end]), pa.array(total_on + total[end]), pa.array(root[end])],
            names=["n", "side", "steps", "sum", "root"],
        )


def _contracted_ranks(places: DataFrame, limits: Limits, stages: list[Stage]) -> DataFrame:
    """(n, side, steps, sum, root) of the contracted places (n, side, steps, sum, far, fside, root)."""
    stage = Stage(places, "places")
    stages.append(stage)
    if stage.df.count() <= limits.solve_rows:
        return stage.df.repartition(1).mapInArrow(_solve_ranks, "n long, side long, steps long, sum long, root long")
    while True:
        now = stage.df
        if now.filter("far is not null").isEmpty():
            return now.select("n", "side", "steps", "sum", "root")
        onward = now.select(
            F.col("n").alias("far"),
            F.col("side").alias("fside"),
            *(F.col(c).alias(c + "2") for c in ("steps", "sum", "far", "fside", "root")),
        )
        moved = now.filter("far is not null").join(onward, ["far", "fside"]).select(
            "n",
            "side",
            (F.col("steps") + F.col("steps2")).alias("steps"),
            (F.col("sum") + F.col("sum2")).alias("sum"),
            F.col("far2").alias("far"),
            F.col("fside2").alias("fside"),
            F.col("root2").alias("root"),
        )
        stage = Stage(now.filter("far is null").unionByName(moved), "places")
        stages.append(stage)
        if len(stages) > 2:
            stages.pop(-2).drop()


def _bucket(column: str, limits: Limits):
    return F.shiftright(F.col(column), limits.bucket_bits)


def _tour(links: DataFrame, limits: Limits) -> DataFrame:
    """Tour elements (g, n, side, t, tside) of a forest (g, n, p): where each place leads; enter places of leaves are left out."""
    none, enter, leave = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")

    def rows(df: DataFrame, n, side, t, tside) -> DataFrame:
        return df.select("g", n.alias("n"), side.alias("side"), t.alias("t"), tside.alias("tside"))

    children = links.filter("p is not null").withColumn("b", _bucket("n", limits))
    within = Window.partitionBy("p", "b").orderBy("n")
    lined = children.select(
        "g", "n", "p", "b", F.lead("n").over(within).alias("nxt"), F.first("n").over(within).alias("lo")
    )
    over = Window.partitionBy("p").orderBy("b")
    ends = lined.filter("nxt is null").select(
        "g", "n", "p", "lo", F.lead("lo").over(over).alias("nb"), F.row_number().over(over).alias("k")
    )
    n, p, nxt, lo, nb = (F.col(c) for c in ("n", "p", "nxt", "lo", "nb"))
    return (
        rows(links.filter("p is null"), n, leave, none, none)
        .unionByName(rows(lined.filter("nxt is not null"), n, leave, nxt, enter))
        .unionByName(rows(ends, n, leave, F.coalesce(nb, p), F.when(nb.isNotNull(), enter).otherwise(leave)))
        .unionByName(rows(ends.filter("k = 1"), p, enter, lo, enter))
    )


def _forest(links: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame, list[Stage]]:
    """Peel (g, n, p); the links with each loop opened at its smallest node (column c: the parent cut off there)."""
    stages: list[Stage] = []
    blocks = links.repartition("g", _bucket("n", limits)).sortWithinPartitions("g", "n").select("n", "p")
    peeled = Stage(blocks.mapInArrow(arrow_blocks(_peel_block, limits.block_rows), _PEELED), "peeled")
    stages.append(peeled)
    loops = peeled.df.filter("loop is not null").select("loop")
    over_blocks, more = _contracted_loops(peeled.df.filter("far is not null").select("n", "far", "low"), limits)
    stages += more
    if over_blocks is not None:
        loops = loops.unionByName(over_blocks)
    loops = loops.distinct().select(F.col("loop").alias("n"), F.lit(True).alias("opened"))
    cut = links.join(loops, "n", "left").select(
        "g",
        "n",
        F.when(F.col("opened").isNull(), F.col("p")).alias("p"),
        F.when(F.col("opened"), F.col("p")).alias("c"),
    )
    return cut, loops, stages


def hierarchy(
    links: DataFrame,
    node: str = "node_id",
    parent: str = "parent_id",
    scope: str | None = None,
    unique: bool = False,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """One row per node of the parent-child rows: where it stands in the tour of its tree.

    Columns: ``node_id``, ``parent_id`` (null for roots), ``root_id``, ``depth`` (steps to the root; -1 in a component with
    a loop, whose root is the smallest node of the loop), ``entry`` and ``exit`` (tour places, counted from the tour's end
    and so never above 0: u is above v where both have one root, u.entry < v.entry and u.exit > v.exit), ``n_below`` and
    ``cut_parent`` (at the root of a component with a loop, the parent by which the loop goes on).

    ``scope`` names a column whose values keep related nodes together (only speed depends on it). Rows without a node id
    are left out. Of several rows for a node one is kept, that of the smallest parent (``unique`` says there are none). A
    parent that is no node itself is no parent. Other columns are ignored, whatever their names. Ids are 64-bit integers.
    An empty table gives an empty result.
    """
    place = F.xxhash64(scope) if scope else F.lit(0).cast("long")
    rows = links.select(place.alias("g"), F.col(node).cast("long").alias("n"), F.col(parent).cast("long").alias("p"))
    rows = rows.filter("n is not null")
    stages: list[Stage] = []
    if not unique:
        rows = rows.groupBy("n").agg(F.min("p").alias("p"), F.min("g").alias("g"))
        known = Stage(rows.select("g", "n", "p"), "links")
        stages.append(known)
        there = known.df.select(F.col("n").alias("p"), F.lit(True).alias("there"))
        rows = known.df.join(there, "p", "left").select("g", "n", F.when(F.col("there"), F.col("p")).alias("p"))
    forest, _, peeled = _forest(rows, limits)
    stages += peeled
    cut = Stage(forest, "forest")
    tour = _tour(cut.df, limits)
    placed = tour.repartition("g", _bucket("n", limits)).sortWithinPartitions("g", "n", "side")
    ranked = Stage(
        placed.select("n", "side", "t", "tside").mapInArrow(arrow_blocks(_rank_block, limits.block_rows, "n"), _RANKED), "ranked"
    )
    for stage in stages:
        stage.drop()
    done = ranked.df
    sides = F.array(
        *(
            F.struct(F.lit(s).cast("long").alias("side"), *(F.col(f"{c}{s}").alias(d) for c, d in zip(("steps", "sum", "far", "side"), ("steps", "sum", "far", "fside"))))
            for s in (0, 1)
        )
    )
    each = done.select("n", "root", F.explode(sides).alias("e")).select("n", "root", "e.*")
    heads = each.filter("far is not null").select(F.col("far").alias("n"), F.col("fside").alias("side")).distinct()
    rest: list[Stage] = []
    solved = Stage(_contracted_ranks(each.join(heads, ["n", "side"], "left_semi"), limits, rest), "solved")
    for stage in rest:
        stage.drop()
    at = solved.df
    inner = done.filter("far0 is not null or far1 is not null")
    for s in (0, 1):
        there = at.select(
            F.col("n").alias(f"far{s}"), F.col("side").alias(f"side{s}"), F.col("steps").alias(f"on{s}"), F.col("sum").alias(f"onsum{s}"), F.col("root").alias(f"onroot{s}")
        )
        inner = inner.join(there, [f"far{s}", f"side{s}"], "left")
    columns = ["n", "root", "steps0", "sum0", "steps1"]
    whole = done.filter("far0 is null and far1 is null").select(*columns).unionByName(
        inner.select(
            "n",
            F.coalesce("root", "onroot0", "onroot1").alias("root"),
            (F.col("steps0") + F.coalesce("on0", F.lit(0))).alias("steps0"),
            (F.col("sum0") + F.coalesce("onsum0", F.lit(0))).alias("sum0"),
            (F.col("steps1") + F.coalesce("on1", F.lit(0))).alias("steps1"),
        )
    )
    opened = cut.df.filter("c is not null").select(F.col("n").alias("root"), F.col("c").alias("opening"))
    return (
        whole.join(cut.df.select("n", F.coalesce("p", "c").alias("up"), F.col("c").alias("cut_parent")), "n")
        .join(opened, "root", "left")
        .select(
            F.col("n").alias("node_id"),
            F.col("up").alias("parent_id"),
            F.col("root").alias("root_id"),
            F.when(F.col("opening").isNotNull(), F.lit(-1)).otherwise(-F.col("sum0")).cast("int").alias("depth"),
            (-F.col("steps0")).alias("entry"),
            (-F.col("steps1")).alias("exit"),
            F.expr("cast((steps0 - steps1 - 1) div 2 as bigint)").alias("n_below"),
            "cut_parent",
        )
    )


def _scan_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, block, entry): ancestors carried into a block first, then its own; the stack is the path."""
    root_now = block_now = None
    stack: list[tuple[int, int]] = []
    for batch in batches:
        nodes, paths = [], []
        for root, block, entry, leave, n, own in zip(*(c.to_pylist() for c in batch.columns)):
            if root != root_now or block != block_now:
                root_now, block_now, stack = root, block, []
            while stack and stack[-1][0] < entry:
                stack.pop()
            stack.append((leave, n))
            if own:
                nodes.append(n)
                paths.append([x for _, x in stack])
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=["node_id", "path"]
        )


def with_paths(tree: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """(node_id, path) for the rows of ``hierarchy``: the ids from the root to the node, both included.

    In a component with a loop the path starts at the loop's smallest node, where the loop is opened.
    """
    span = limits.path_span
    first, last = F.expr(f"floor(entry / {span})"), F.expr(f"floor(exit / {span})")
    carried = tree.select(
        F.col("root_id").alias("root"), F.explode(F.sequence(first, last)).alias("block"), "entry", "exit", F.col("node_id").alias("n"), first.alias("home")
    )
    ready = (
        carried.repartition("root", "block")
        .sortWithinPartitions("root", "block", "entry")
        .select("root", "block", "entry", "exit", "n", (F.col("block") == F.col("home")).alias("own"))
    )
    return ready.mapInArrow(_scan_paths, "node_id long, path array<long>")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance): every node below every node, from ``with_paths``."""
    return paths.select("node_id", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor_id")).filter(
        "ancestor_id <> node_id"
    ).select("ancestor_id", "node_id", (F.col("n") - 1 - F.col("at")).alias("distance"))


def on_loop(tree: DataFrame) -> DataFrame:
    """(node_id) of the nodes that are on a loop themselves, by the intervals of ``hierarchy``."""
    cuts = tree.filter("cut_parent is not null").select("root_id", F.col("cut_parent").alias("node_id"))
    ends = tree.join(cuts, ["root_id", "node_id"], "left_semi").select(
        "root_id", F.col("entry").alias("e"), F.col("exit").alias("x")
    )
    return tree.join(ends, "root_id").filter("entry <= e and exit >= x").select("node_id")


def newest_posts(posts: DataFrame, *columns: str) -> DataFrame:
    """One row per ``post_id``: that with the newest ``fetched_at`` (null is oldest; among equals the largest values)."""
    return (
        posts.filter("post_id is not null")
        .groupBy("post_id")
        .agg(F.max(F.struct("fetched_at", *columns)).alias("r"))
        .select("post_id", *(F.col(f"r.{c}").alias(c) for c in columns))
    )


def reply_links(posts: DataFrame) -> DataFrame:
    """(post_id, thread_id, parent_id) of posts: the parent is the first of ``refs`` that is exactly ``>>`` and digits and
    names a post of the same thread, be it the post itself; null where there is none. Null refs and entries name nothing."""
    exact = F.filter("refs", lambda r: r.rlike(r"^>>[0-9]+\z"))
    wanted = F.transform(exact, lambda r: F.substring(r, 3, 40).try_cast("long"))
    narrow = posts.select("post_id", "thread_id", "fetched_at", wanted.alias("refs"))
    known = Stage(newest_posts(narrow, "thread_id", "refs"), "posts").df
    named = known.select("post_id", "thread_id", F.posexplode("refs").alias("at", "ref")).filter("ref is not null")
    there = known.select(F.col("post_id").alias("ref"), "thread_id")
    hits = named.join(there, ["ref", "thread_id"]).select("post_id", "thread_id", F.struct("at", "ref").alias("hit"))
    every = known.select("post_id", "thread_id", F.lit(None).cast("struct<at:int,ref:bigint>").alias("hit"))
    return (
        hits.unionByName(every)
        .groupBy("post_id")
        .agg(F.max("thread_id").alias("thread_id"), F.min("hit").alias("hit"))
        .select("post_id", "thread_id", F.col("hit.ref").alias("parent_id"))
    )
