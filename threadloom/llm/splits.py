"""Splits that keep related records together.

Records are linked through the entities they share. Each entity links its records to the smallest of them (a star, never
all pairs), and alternating large-star and small-star rounds turn these links into one star per component. The component
is then hashed into ranges that are proportional to the split shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import stripped
from threadloom.llm.records import newest_samples
from threadloom.operators.joins import lookup
from threadloom.stages import Stage

#: Hash places are 0 .. PLACES * PLACES - 1; cuts are found in two passes of at most PLACES sums each.
PLACES = 4096


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b) of 64-bit ids: the component is its smallest node.

    Large-star links each larger neighbour of a node to the smallest node it knows, small-star links the smaller ones and
    the node itself to it; in turn they lower the ids until nothing changes, after a number of rounds in the logarithm of
    the nodes. A hot node only ever meets the minimum of its neighbours, aggregated before the shuffle; what it passes
    on is one row per edge, and adaptive joins split its rows. Edges with a null end and self links are nodes by
    themselves or nothing. An empty table gives an empty result.
    """
    ends = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a is not null and b is not null")
    now = Stage(ends.select("a", "b").distinct(), "edges")  # a >= b
    nodes_only = now.df.filter("a = b").select(F.col("a").alias("node"))
    state = None
    while True:
        # large-star: every node with its neighbours on both sides, and the smallest of them all
        e = now.df.filter("a <> b")
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: every node and its smaller neighbours to the smallest neighbour
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        after = Stage(small, "edges")
        seen = after.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state is not None:  # the first edges stay, for the lone nodes
            now.drop()
        now = after
        if tuple(seen) == state:
            break
        state = tuple(seen)
    stars = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    known = stars.unionByName(roots)
    lone = nodes_only.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(lone)


def related_groups(records: DataFrame) -> DataFrame:
    """(record, component) for rows (record bigint, entity string); records that share an entity, also through others,
    get one component, the smallest of them. A null entity links nothing, a null record is left out; repeated rows count
    once. An entity with any number of records gives one link per record."""
    rows = records.filter("record is not null").select("record", "entity")
    named = rows.filter("entity is not null")
    star = named.groupBy("entity").agg(F.min("record").alias("hub"))
    links = named.join(star, "entity").select(F.col("record").alias("a"), F.col("hub").alias("b"))
    lone = rows.filter("entity is null").select(F.col("record").alias("a"), F.col("record").alias("b"))
    links = links.unionByName(lone)
    return star_components(links).select(F.col("node").alias("record"), "component")


def bounded(df: DataFrame, rows: int) -> list:
    """Rows of a frame that is small by construction; more than ``rows`` of them is an error, not a cut."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows where the construction allows fewer")
    return got


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: int = 0, place_above: float | None = None) -> DataFrame:
    """(component, split_name) for ``groups`` (component, n records).

    Groups are hashed to a place, and the places are cut into one range per split so that every split gets its share of the
    records; the cut is found by summing records per place, coarse places first, then the places of the one coarse place that
    each cut falls into. A group far above the mean lands in a small split as often as its range is wide and then fills it.
    ``place_above`` is for that case: groups above this share of all records (fewer than 1 / place_above) go, the largest first,
    to the split that lacks most of its share, and only the rest is hashed; then a group that grows past that share may change
    its split. Every group has exactly one split, the same at every run. Splits with no share get nothing. No groups: an empty
    result.
    """
    names = sorted(k for k, v in shares.items() if k is not None and v and v > 0)
    if not names:
        raise ValueError("no split has a share")
    whole = sum(shares[k] for k in names)
    total = groups.agg(F.sum("n")).first()[0] or 0
    lacks = {k: total * shares[k] / whole for k in names}
    bound = None if place_above is None else place_above * total
    big = [] if bound is None else bounded(groups.filter(F.col("n") > bound).orderBy(F.desc("n"), "component"), int(1 / place_above) + 1)
    placed = []
    for row in big:
        to = max(names, key=lambda k: (lacks[k], k))
        lacks[to] -= row["n"]
        placed.append((row["component"], to))
    spark = groups.sparkSession
    hashed = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(PLACES * PLACES)).cast("int")
    small = (groups if bound is None else groups.filter(F.col("n") <= bound)).withColumn("place", hashed)
    coarse = dict(bounded(small.groupBy(F.expr(f"place div {PLACES}").alias("c")).agg(F.sum("n")), PLACES))
    rest = sum(coarse.values())
    wants = {k: max(0.0, v) for k, v in lacks.items()}
    scale = rest / (sum(wants.values()) or 1)
    targets, run = [], 0.0
    for k in names[:-1]:
        run += wants[k] * scale
        targets.append(run)
    # the coarse place each cut falls into, then the exact place in it
    into, sums, k = [], 0, 0
    for c in range(PLACES):
        while k < len(targets) and sums + coarse.get(c, 0) >= targets[k]:
            into.append((c, sums))
            k += 1
        sums += coarse.get(c, 0)
    into += [(PLACES - 1, sums)] * (len(targets) - len(into))
    need = sorted({c for c, _ in into})
    fine: dict[int, list[tuple[int, int]]] = {}
    if need:
        rows = small.filter(F.expr(f"place div {PLACES}").isin(need)).groupBy("place").agg(F.sum("n").alias("n"))
        for row in bounded(rows, PLACES * len(need)):
            fine.setdefault(row["place"] // PLACES, []).append((row["place"], row["n"]))
    cuts = []
    for target, (c, before) in zip(targets, into):
        cut, run = c * PLACES, before
        for place, n in sorted(fine.get(c, [])):
            if run + n / 2 > target:
                break
            cut, run = place + 1, run + n
        cuts.append(cut)
    split = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        split = F.when(F.col("place") < cut, F.lit(name)).otherwise(split)
    result = small.select("component", split.alias("split_name"))
    if placed:
        result = result.unionByName(spark.createDataFrame(placed, "component bigint, split_name string"))
    return result


def author_key(tag):
    """The tripcode of an author tag, from its first ``!`` on without outer blanks; null where the tag holds none."""
    code = stripped(F.regexp_extract(tag, r"(?s)(!.*)$", 1))
    return F.when(F.length(code) > 1, code)


def sample_entities(samples: DataFrame, posts: DataFrame) -> DataFrame:
    """(sample_no, thread_id, author) of each sample; a null thread is that of the post ``assistant_post_id``.

    Threads are unique over all boards, so the board adds nothing to the key. Only posts that are asked for are read on
    into the shuffle, their newest rows.
    """
    one = newest_samples(
        samples,
        F.col("metadata.thread_id").alias("thread_id"),
        F.col("metadata.assistant_post_id").alias("post_id"),
        author_key(F.col("metadata.author_tag")).alias("author"),
    )
    asked = one.filter("thread_id is null and post_id is not null").select("post_id").distinct()
    found = (
        posts.select("post_id", "thread_id", "fetched_at")
        .join(asked, "post_id", "left_semi")
        .groupBy("post_id")
        .agg(F.max(F.struct("fetched_at", "thread_id"))["thread_id"].alias("post_thread"))
    )
    return lookup(one, found, "post_id", "sample_no").select("sample_no", F.coalesce("thread_id", "post_thread").alias("thread_id"), "author")


def grouped_samples(samples: DataFrame, posts: DataFrame) -> DataFrame:
    """(sample_no, thread_id, author, group_no): the group is the smallest ``sample_no`` of all related samples."""
    known = Stage(sample_entities(samples, posts), "entities").df
    entity = F.explode(F.array(F.concat(F.lit("t"), F.col("thread_id").cast("string")), F.concat(F.lit("a"), "author")))
    groups = related_groups(known.select(F.col("sample_no").alias("record"), entity.alias("entity")))
    return known.join(groups.select(F.col("record").alias("sample_no"), F.col("component").alias("group_no")), "sample_no")


def groups_over_threads(grouped: DataFrame) -> DataFrame:
    """The rows of ``grouped_samples`` whose group spans more than one thread."""
    span = grouped.groupBy("group_no").agg(F.min("thread_id").alias("lo"), F.max("thread_id").alias("hi")).filter("lo < hi")
    return grouped.join(span, "group_no", "left_semi")
