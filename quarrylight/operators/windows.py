"""Ordinal logic: interleaving, caps, budgets, recent frames, greedy selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleave(rows: DataFrame, bucket: str, order: list[str], out: str = "turn") -> DataFrame:
    """``out`` gives the place in its bucket: sorted by it, the first of every bucket precedes any second."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))


def cap_new(rows: DataFrame, url: str, query: str, order: list[str], most: int = 6) -> DataFrame:
    """At most ``most`` urls per query that no earlier query had."""
    first = Window.partitionBy(url).orderBy(query, *order)
    once = rows.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    w = Window.partitionBy(query).orderBy(*order)
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def first_per(rows: DataFrame, parts: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each part; row limits are pushed below the shuffle by the engine."""
    w = Window.partitionBy(*parts).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def budget_fold(sizes: Column, budget: int) -> Column:
    """Indices (from 0) of a greedy walk that takes whole items while they fit; a later, smaller one may still be taken."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("took"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["used"] + n <= budget
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(fits, acc["used"] + n).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["took"], F.array(acc["at"]))).otherwise(acc["took"]).alias("took"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["took"])


def budget_walk(rows: DataFrame, part: str, order: str, size: str, budget: int) -> DataFrame:
    """Per part, the places (from 0) that a greedy walk takes: whole rows while they fit; a later, smaller one may still be taken.

    Rows stand in contiguous ranges of (part, order, size).  After a row of n units that the most room ``m`` would hold, no walk
    has more room than ``max(n - 1, m - n)``, whatever was taken before, so a range passes on only the rows within that bound
    and how many rows it has of each part; the walk then goes over these alone.  Both passes hold a few numbers, besides the places.
    """
    import pyarrow as pa

    keys = [F.col(part).alias("part"), F.col(order).alias("ord"), F.col(size).cast("long").alias("n")]
    ranges = rows.select(*keys).repartitionByRange("part", "ord", "n").sortWithinPartitions("part", "ord", "n")
    kind, by = rows.schema[part].dataType.simpleString(), rows.schema[order].dataType.simpleString()

    def within(batches):
        now, last, at, room = None, None, 0, budget
        for batch in batches:
            out = []
            for p, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (p,):
                    if now:
                        out.append((*now, *last, True, at))
                    now, at, room = (p,), 0, budget
                if n is not None and n <= room:
                    out.append((p, o, n, False, at))
                    room = max(n - 1, room - n)
                last, at = (o, n), at + 1
            yield made(batch, out)
        if now:
            yield made(batch, [(*now, *last, True, at)])

    def made(batch, out):
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [*batch.schema.types[:3], pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "ord", "n", "total", "at"])

    def walk(batches):
        now, before, used, took = None, 0, 0, []
        for batch in batches:
            out = []
            for p, _, n, total, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (p,):
                    if now:
                        out.append((*now, took))
                    now, before, used, took = (p,), 0, 0, []
                if total:
                    before += at
                elif used + n <= budget:
                    used += n
                    took.append(before + at)
            yield ended(batch, out)
        if now:
            yield ended(batch, [(*now, took)])

    def ended(batch, out):
        columns = list(zip(*out, strict=True)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), pa.array(columns[1], pa.list_(pa.int64()))], ["part", "took"])

    left = ranges.mapInArrow(within, f"part {kind}, ord {by}, n long, total boolean, at long")
    left = left.repartition("part").sortWithinPartitions("part", "ord", "n", "total", "at")
    return left.mapInArrow(walk, f"part {kind}, took array<long>").withColumnRenamed("part", part)


def joined_within(parts: Column, budget: int, separator: str = "\n") -> Column:
    """Parts joined until the budget of characters is used; the last one is cut."""
    return F.substring(F.array_join(parts, separator), 1, budget)


def keep_recent(turns: DataFrame, part: str, order: str, text: str, word_limit: int, keep: int = 6) -> DataFrame:
    """``kept`` per turn: all of a short conversation, else the last ``keep``; the others go into its summary."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    every = Window.partitionBy(part)
    from_end = F.row_number().over(every.orderBy(F.desc(order)))
    total, count = F.sum(words).over(every), F.count(F.lit(1)).over(every)
    return turns.withColumn("kept", ~((total > word_limit) & (count > keep) & (from_end > keep)))


def complement(primary: DataFrame, extra: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Two primary hits, then a supplementary one; a third of the places, one at least, is kept for these."""
    kept = max(1, limit // 3)
    a = primary.select(key, order).withColumn("n", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("n") < limit)
    b = extra.join(primary.select(key), key, "left_anti").select(key, order)
    b = b.withColumn("n", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("n") < kept)
    slots = a.select(key, (F.col("n") + F.floor(F.col("n") / 2)).alias("slot")).union(b.select(key, (3 * F.col("n") + 2).alias("slot")))
    return slots.withColumn("place", F.row_number().over(Window.orderBy("slot", key)) - 1).where(F.col("place") < limit).select(key, "place")


def spread_by_origin(rows: DataFrame, score: str, origin: str, key: str, limit: int) -> DataFrame:
    """The best by ``score / (1 + earlier rows of the origin)``; inside an origin scores do not rise, so ranks give the greedy order."""
    w = Window.partitionBy(origin).orderBy(F.desc(score), key)
    eff = F.col(score) / F.row_number().over(w)
    return rows.withColumn("effective", F.round(eff, 6)).orderBy(F.desc("effective"), key).limit(limit)
