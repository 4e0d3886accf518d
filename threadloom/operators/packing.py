"""Best-fit-decreasing packing on a histogram of sizes: the plan of who fills which container, whatever the number of items."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.stages import small_side

#: Items of one size that one task ranks.
RANK_ROWS = 200_000


@dataclass
class Content:
    """``bins`` containers of ``capacity`` that each hold ``items`` (size -> number)."""

    capacity: int
    bins: int
    items: dict[int, int]

    @property
    def fill(self) -> int:
        return sum(s * k for s, k in self.items.items())


class _Open:
    """Open containers of one tier by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.kinds: dict[int, list[tuple[tuple, int]]] = {}

    def add(self, room: int, items: tuple, bins: int) -> None:
        if not bins:
            return
        if room not in self.kinds:
            insort(self.rooms, room)
            self.kinds[room] = []
        self.kinds[room].append((items, bins))

    def place(self, size: int, number: int, new: bool) -> int:
        """Put items into the fullest containers that have room, then (``new``) into new ones; the number left over."""
        while number:
            k = bisect_left(self.rooms, size)
            if k == len(self.rooms):
                break
            room = self.rooms[k]
            items, bins = self.kinds[room].pop()
            if not self.kinds[room]:
                del self.kinds[room], self.rooms[k]
            each = room // size  # best fit returns to the container it has just put an item into
            whole = min(bins, number // each)
            if whole:
                self.add(room - each * size, (*items, (size, each)), whole)
                number -= whole * each
            else:
                whole = 1
                self.add(room - number * size, (*items, (size, number)), 1)
                number = 0
            self.add(room, items, bins - whole)
        if new and number:
            each = self.capacity // size
            self.add(self.capacity - each * size, ((size, each),), number // each)
            rest = number % each
            self.add(self.capacity - rest * size, ((size, rest),) if rest else (), 1 if rest else 0)
            number = 0
        return number

    def contents(self) -> list[Content]:
        made: dict[tuple, int] = {}
        for kinds in self.kinds.values():
            for items, bins in kinds:
                total: dict[int, int] = {}
                for size, k in items:
                    total[size] = total.get(size, 0) + k
                key = tuple(sorted(total.items()))
                made[key] = made.get(key, 0) + bins
        return [Content(self.capacity, n, dict(key)) for key, n in made.items()]


def plan(histogram: dict[int, int], capacities: list[int]) -> list[Content]:
    """Contents of containers for items (size -> number) of at most the largest capacity; sizes are positive."""
    tiers = sorted(set(capacities))
    left = dict(histogram)
    result: list[Content] = []
    for t in range(len(tiers) - 1, -1, -1):
        low = tiers[t - 1] if t else 0
        open_bins = _Open(tiers[t])
        for size in sorted(left, reverse=True):
            own = size > low
            left[size] = open_bins.place(size, left[size], new=own)
        left = {s: n for s, n in left.items() if n}
        result += open_bins.contents()
    return result


def ranked_by_size(items: DataFrame, size: str, keys: list[str], most: int, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``items`` with ``rank``, from 0 among those of the same size; a size of ``most`` items is ranked in salted groups."""
    salts = max(1, -(-most // rank_rows))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    before = Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(size, "_salt").agg(F.count("*").alias("_many")).select(size, "_salt", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(size, "_salt").orderBy(*keys))
    ranked = salted.withColumn("_k", within).join(offsets, [size, "_salt"])
    return ranked.withColumn("rank", F.col("_offset") + F.col("_k") - 1).drop("_salt", "_k", "_offset")


def slots(contents: list[Content], sizes: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, start, stop, capacity, base, each): items of a size whose rank is in [start, stop) fill containers from ``base`` on,
    ``each`` to a container; containers of a capacity are numbered from the fullest to the emptiest."""
    out, used = [], dict.fromkeys(sizes, 0)
    for capacity in sorted({c.capacity for c in contents}):
        tier = sorted((c for c in contents if c.capacity == capacity), key=lambda c: (-c.fill, sorted(c.items.items())))
        base = 0
        for c in tier:
            for size, each in c.items.items():
                out.append((size, used[size], used[size] + each * c.bins, capacity, base, each))
                used[size] += each * c.bins
            base += c.bins
    return out


def placed(items: DataFrame, size: str, keys: list[str], capacities: list[int], rank_rows: int = RANK_ROWS) -> DataFrame:
    """``items`` with ``capacity`` and ``bin_no``: each in one container with room for it.

    ``items`` is read three times and should be a written table. Items larger than the largest capacity are an error; items
    of no size are left out. Only the histogram of sizes, at most one row per size up to that capacity, is collected, and
    only the plan made from it is broadcast, if it is small.
    """
    rows = items.filter(F.col(size) > 0)
    counts = {r["s"]: r["n"] for r in rows.groupBy(F.least(F.col(size), F.lit(max(capacities) + 1)).alias("s")).agg(F.count("*").alias("n")).collect()}
    if max(counts, default=0) > max(capacities):
        raise ValueError("an item is larger than every container")
    plan_rows = slots(plan(counts, capacities), counts) or [(0, 0, 0, 0, 0, 1)]
    places = items.sparkSession.createDataFrame(plan_rows, "_size int, start long, stop long, capacity int, base long, each int")
    ranked = ranked_by_size(rows, size, keys, max(counts.values(), default=1), rank_rows)
    hit = (F.col(size) == F.col("_size")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    return ranked.join(small_side(places, len(plan_rows)), hit).select(*items.columns, "capacity", F.expr("base + (rank - start) div each").alias("bin_no"))
