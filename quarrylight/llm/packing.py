"""Best-fit packing of tokenised documents into sequences by bin completion.

Items differ only in length, and a length is at most the capacity, so the whole
packing problem is a histogram of at most ``capacity`` counts whatever the
corpus is.  It is solved on the driver as patterns with multiplicities:

* best-fit decreasing over groups of equal bins gives the incumbent;
* if that is above the lower bound, bin completion improves it: around the
  largest item left, the undominated fillings are enumerated, the least waste
  first, each applied as often as the counts allow and then fewer times, and a
  branch whose waste exceeds what the incumbent leaves is cut.

The documents then find their places without leaving the cluster: the rank of a
piece among those of its length is a two-level count (per slice of a range
partitioning, then inside the slice), and the pattern that holds this rank is
looked up in a table of the patterns, bounded by the histogram.

Defined results: a null text is empty and its piece is the single end id; equal
rows are packed each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import durable, release

from .bpe import chunks, json_codec

CAPACITY = 2048
#: Nodes and fillings that the search looks at; None lets it run to the end.
STEPS = 10_000


def _add(pattern: tuple, length: int, k: int) -> tuple:
    return (*pattern, (length, k))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing: (pattern, bins) with patterns as ((length, copies), ...)."""
    free: dict[int, list[list]] = {}  # room left -> groups [pattern, bins]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                room, group = capacity, [(), left]
            else:
                group = free[room].pop()
                if not free[room]:
                    del free[room]
            pattern, bins = group
            fit = room // length
            full = min(bins, left // fit)
            if full:
                free.setdefault(room - fit * length, []).append([_add(pattern, length, fit), full])
                left -= full * fit
                bins -= full
            if bins and left and left < fit:
                free.setdefault(room - left * length, []).append([_add(pattern, length, left), 1])
                left, bins = 0, bins - 1
            if bins and pattern:
                free.setdefault(room, []).append([pattern, bins])
    return [(tuple(p), n) for groups in free.values() for p, n in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the size bound and the bounds that set items over half apart, for every cut between small and not."""
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in sizes.tolist()], np.int64)
    items, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    half = np.searchsorted(sizes, capacity // 2, side="right")
    cuts = np.concatenate([[0], sizes[:half]])
    top = np.searchsorted(sizes, capacity - cuts, side="right")  # from here on nothing fits beside
    top = np.maximum(top, half)
    low = np.searchsorted(sizes, cuts, side="left")
    room = capacity * (items[top] - items[half]) - (volume[top] - volume[half])
    rest = volume[half] - volume[low]
    bounds = items[-1] - items[half] + np.maximum(0, -(-(rest - room) // capacity))
    return int(max(bounds.max(), -(-volume[-1] // capacity)))


class _Steps:
    """What is left of the search: every node and every filling that is looked at takes a step; None never ends."""

    def __init__(self, steps: int | None):
        self.left = steps

    def take(self) -> bool:
        if self.left is None:
            return True
        self.left -= 1
        return self.left >= 0


def fillings(sizes: list[int], counts: dict[int, int], room: int, waste: int, steps: _Steps):
    """Undominated fillings of ``room`` that leave at most ``waste`` of it, least waste first, one by one, while there are steps.

    ``sizes`` descend.  A filling is dominated by another if its items fit into distinct items of the other; left out
    are those in which an item could give way to a larger one or two items to one of their size or more, within the room,
    and those that another item could be added to.  One item as large as the room dominates all others.
    """
    if counts.get(room):
        yield ((room, 1),)
        return
    usable = sizes[bisect_left(sizes, -room, key=lambda v: -v) :]  # descending
    # Reachable sums as bits of an integer: reach[k] has those of usable[k:].
    mask, reach = (1 << (room + 1)) - 1, [1]
    for v in reversed(usable):
        bits, left, step = reach[-1], min(counts[v], room // v), 1
        while left:
            k = min(step, left)
            bits |= (bits << (k * v)) & mask
            left -= k
            step *= 2
        reach.append(bits)
    reach.reverse()
    sums = reach[0]
    while sums:
        target = sums.bit_length() - 1
        if target < room - waste:
            return
        sums ^= 1 << target
        for chosen in _subsets(usable, counts, reach, target):
            if not steps.take():
                return
            if not _dominated(chosen, usable, counts, room - target):
                yield chosen


def _subsets(usable: list[int], counts: dict[int, int], reach: list[int], target: int):
    """All ways to make ``target``, those with the largest items first."""
    stack = [(0, target, ())]
    while stack:
        k, left, chosen = stack.pop()
        if not left:
            yield chosen
            continue
        while k < len(usable) and (usable[k] > left or not reach[k + 1] >> left & 1):
            if usable[k] <= left and reach[k] >> left & 1:
                break
            k += 1
        if k == len(usable):
            continue
        v = usable[k]
        for c in range(min(counts[v], left // v) + 1):  # the most copies come off the stack first
            if reach[k + 1] >> (left - c * v) & 1:
                stack.append((k + 1, left - c * v, (*chosen, (v, c)) if c else chosen))


def _dominated(chosen: tuple, usable: list[int], counts: dict[int, int], spare: int) -> bool:
    used = dict(chosen)
    free = sorted(v for v in usable if counts[v] > used.get(v, 0))
    if not free:
        return False
    if spare >= free[0]:
        return True  # not maximal

    def between(low: int, high: int) -> bool:  # whether an item of that size is left
        k = bisect_left(free, low)
        return k < len(free) and free[k] <= high

    items = [v for v, _ in chosen]
    if any(between(v + 1, v + spare) for v in items):
        return True
    pairs = [a + b for i, a in enumerate(items) for b in items[i + 1 :]] + [2 * v for v, c in chosen if c > 1]
    return any(between(s, s + spare) for s in pairs)


def pack(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = STEPS) -> list[tuple[tuple, int]]:
    """Patterns with multiplicities that hold every item of the histogram.

    ``steps`` bounds the search, which keeps the best plan so far; without a bound (None) it
    runs to the end and the plan has the fewest bins that there are.
    """
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, capacity)
    if not counts:
        return best
    least, total = lower_bound(counts, capacity), sum(k * n for k, n in counts.items())
    bins, budget = sum(n for _, n in best), _Steps(steps)
    # A depth-first search with an explicit stack.  An entry is a node (path, bins, waste) and which of its branches
    # is next (number of the filling, times it is applied; None: as often as the counts allow).  A path is a linked
    # list, and the counts left are rebuilt from it where the search goes back, so memory follows the depth alone.
    stack, at, left = [(None, 0, 0, 0, None)], None, dict(counts)
    while stack and bins > least and budget.take():
        path, used, waste, number, times = stack.pop()
        spare = (bins - 1) * capacity - total - waste
        if spare < 0:
            continue  # even without further waste this takes as many bins as the incumbent
        if path is not None and path[0] is at and not number and times is None:
            _take(left, *path[1])
        elif path is not at:
            left = dict(counts)
            for step in _steps(path):
                _take(left, *step)
        at = path
        if not left:
            if used < bins:
                bins, best = used, list(_steps(path))
            continue
        sizes = sorted(left, reverse=True)
        top = sizes[0]
        usable = {**left, top: left[top] - 1}
        found = fillings([s for s in sizes if usable[s]], usable, capacity - top, spare, budget)
        filling = next(islice(found, number, None), None)
        if filling is None:
            continue
        uses = dict(filling)
        uses[top] = uses.get(top, 0) + 1
        waste_of_one = capacity - sum(k * c for k, c in uses.items())
        most = min(left[k] // c for k, c in uses.items())
        if waste_of_one:
            most = min(most, spare // waste_of_one)
        times = most if times is None else times
        stack.append((path, used, waste, number, times - 1) if times > 1 else (path, used, waste, number + 1, None))
        stack.append(((path, (tuple(uses.items()), times)), used + times, waste + times * waste_of_one, 0, None))
    return best


def _take(left: dict[int, int], pattern: tuple, times: int) -> None:
    for k, c in pattern:
        left[k] -= c * times
        if not left[k]:
            del left[k]


def _steps(path) -> list[tuple]:
    out = []
    while path is not None:
        path, step = path
        out.append(step)
    return out[::-1]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    ``path`` is a ``tokenizers`` JSON file of a byte-level BPE.  A document is its ids and ``end_id``; one longer than ``capacity`` is cut so that all pieces
    but the first have ``capacity`` ids.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(json_codec(path))  # as large as the vocabulary

    def run(batches):
        tool = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                at, number, start, length, crc = [], [], [], [], []
                for k, found in enumerate(tool.encode_all(texts[a:b]), a):
                    ids = np.append(found, end_id).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                    for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        at.append(k)
                        number.append(p)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[s:e].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with ``id``, ``piece``, ``length``) with ``sequence_id`` and ``offset``."""
    spark = items.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "id", "piece", "spread"]
    placed = durable(
        items.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(slices, *order)
        .withColumn("slice", F.spark_partition_id()),
        "pack-slices",
    )
    # At most ``capacity`` lengths, each in consecutive slices: slices + capacity rows.
    here = placed.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}

    rows, taken, base = [], dict.fromkeys(counts, 0), 0
    for pattern, times in pack(counts, capacity):
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], taken[length] + copies * times, copies, base, offset))
            taken[length] += copies * times
            offset += copies * length
        base += times
    plan = spark.createDataFrame(rows, "length long, first long, stop long, copies long, base long, shift long")
    inside = Window.partitionBy("length", "slice").orderBy(*order)
    ranked = (
        placed.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(here), ["length", "slice"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    )
    hit = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & hit)
        .withColumn("sequence_id", F.expr("base + (rank - first) div copies"))
        .withColumn("offset", F.expr("shift + (rank - first) % copies * length"))
        .select(*items.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place."""
    cut = durable(pieces(docs, path, capacity, id_col=id_col, text_col=text_col), "pack-pieces")
    out = packed(cut, capacity)
    release(cut)
    return out
