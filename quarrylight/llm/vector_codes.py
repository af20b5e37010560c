"""Vectors as short codes: each of 16 parts becomes the index of its nearest codebook entry, all in integers.

Components become ``floor(scale * x)``.  The codebooks begin as the parts of the first 64 rows and are
broadcast: 64 vectors whatever the table holds.  A task computes the distances of an Arrow batch to all
entries of a part by norm expansion, ``|x|^2 - 2 x.c + |c|^2``, with exact int64 matrix products, and
takes the first smallest.  Each round a task gives one sum and one count per entry and component, a grouped shuffle
merges them, and the new entries (again 64 vectors) go out to the tasks.  Nothing else reaches the
driver, and no row is moved until the codes are known.

The error of a label is summed before it meets its rows; labels that hold a large share of the rows (there can be 256 of
them at most) are broadcast, the others joined by shuffle.

Defined results: null vectors, and vectors with null or non-finite components, take no part; neither do
vectors whose dimension is not that of the first row (the smallest id whose vector divides into the
parts).  Rows without an id stand last in the order of ids; rows of one id stand in the order of their vectors, repeated
rows count as often as they stand there.  Null labels are one label.  Components beyond 2^62 count as 2^62, and
an error beyond 2^63 - 1 stands as 2^63 - 1.  With less than 64 rows the codebooks have as many
entries; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import durable

from .blocks import vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of larger magnitude are held there.
LARGEST = 2**62
#: A label with more than this share of the rows is joined by broadcast: 256 labels at most.
HOT_SHARE = 1 / 256


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite ``x``, as int64."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def exact(parts: int, dim: int, *arrays: np.ndarray) -> bool:
    """Whether squared distances of such values stay within int64."""
    most = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    return 4 * (dim // parts) * most * most < 2**63


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) per row and part; ``books`` is parts x entries x width."""
    parts, _, width = books.shape
    if not exact(parts, parts * width, x, books):
        x, books = x.astype(object), books.astype(object)  # Python's integers, for vectors with huge components
    codes = np.empty((len(x), parts), np.int64)
    errors = np.empty((len(x), parts), x.dtype)
    at = np.arange(len(x))
    for p in range(parts):
        own, book = x[:, p * width : (p + 1) * width], books[p]
        distance = (own * own).sum(axis=1)[:, None] - 2 * (own @ book.T) + (book * book).sum(axis=1)[None, :]
        codes[:, p] = np.argmin(distance, axis=1)
        errors[:, p] = distance[at, codes[:, p]]
    return codes, errors


def summed(x: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the rows per part and entry; the sums are exact."""
    parts, width = codes.shape[1], x.shape[1] // codes.shape[1]
    big = int(np.abs(x).max(initial=0)) * len(x) >= 2**62
    sums = np.zeros((parts, entries, width), object if big else np.int64)
    counts = np.zeros((parts, entries), np.int64)
    for p in range(parts):
        order = np.argsort(codes[:, p], kind="stable")
        entry, first = np.unique(codes[order, p], return_index=True)
        own = x[order, p * width : (p + 1) * width]
        sums[p, entry] = np.add.reduceat(own.astype(object) if big else own, first, axis=0)
        counts[p, entry] = np.diff(np.append(first, len(order)))
    return sums, counts


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``v`` (doubles) and the caller's other columns for rows whose vector is whole and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    value = F.col(vec_col).cast("array<double>")
    return rows.where(F.col(vec_col).isNotNull() & ~F.exists(value, bad)).withColumn(vec_col, value).withColumn(id_col, F.col(id_col).cast("long"))


def first_books(rows: DataFrame, parts: int, entries: int, scale: int, id_col: str, vec_col: str) -> np.ndarray | None:
    """The parts of the first ``entries`` usable rows by id, or None without any."""
    fit = rows.where((F.size(vec_col) > 0) & (F.size(vec_col) % parts == 0))
    order = [F.col(id_col).asc_nulls_last(), F.col(vec_col)]
    top = fit.orderBy(*order).select(F.size(vec_col).alias("n")).first()
    if top is None:
        return None
    found = fit.where(F.size(vec_col) == top["n"]).orderBy(*order).limit(entries).select(vec_col).collect()
    x = integers(np.array([r[0] for r in found], np.float64), scale)
    return np.ascontiguousarray(x.reshape(len(found), parts, -1).transpose(1, 0, 2))


def refined(rows: DataFrame, books: np.ndarray, scale: int, id_col: str, vec_col: str) -> np.ndarray:
    """Codebooks after one round: every entry the floor of the mean of its parts; entries without parts stay."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            column = batch.column(0)
            for dim, _, x in vectors(column, pa.array(np.zeros(len(column), np.int64)), True):
                if dim == parts * width:
                    x = integers(x, scale)
                    s, n = summed(x, assign(x, shared.value)[0], entries)
                    sums, counts = sums + s, counts + n
        p, e, at = (a.ravel() for a in np.indices(sums.shape))
        used = np.repeat(counts.ravel() > 0, width)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(a[used], pa.int32()) for a in (p, e, at)),
                pa.array([Decimal(v) for v in sums.ravel()[used].tolist()], pa.decimal128(38, 0)),
                pa.array(np.repeat(counts.ravel(), width)[used], pa.int64()),
            ],
            ["part", "entry", "at", "total", "n"],
        )

    sums = (
        rows.select(vec_col)
        .mapInArrow(run, "part int, entry int, at int, total decimal(38,0), n long")
        .groupBy("part", "entry", "at")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    new = books.copy()
    for r in sums.collect():  # one row per component of the codebooks
        new[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return new


def coded(rows: DataFrame, books: np.ndarray, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id``, ``label``, ``code`` (array of one index per part) and ``error`` per usable row."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    most = 2**63 - 1

    def run(batches):
        for batch in batches:
            place = pa.array(np.arange(batch.num_rows))
            for dim, at, x in vectors(batch.column(1), place, True):
                if dim != parts * width:
                    continue
                codes, errors = assign(integers(x, scale), shared.value)
                total = errors.astype(object).sum(axis=1) if errors.dtype == object or not _sum_fits(errors) else errors.sum(axis=1)
                offsets = np.arange(0, codes.size + 1, parts, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        batch.column(2).take(pa.array(at)),
                        pa.ListArray.from_arrays(offsets, pa.array(codes.ravel(), pa.int32())),
                        pa.array([min(v, most) for v in total.tolist()], pa.int64()),
                    ],
                    ["id", "label", "code", "error"],
                )

    kept = rows.select(F.col(id_col).alias("id"), vec_col, F.col(label_col).alias("label"))
    return kept.mapInArrow(run, f"id long, label {kept.schema['label'].dataType.simpleString()}, code array<int>, error long")


def _sum_fits(errors: np.ndarray) -> bool:
    return int(errors.max(initial=0)) * errors.shape[1] < 2**63


def with_label_error(found: DataFrame) -> DataFrame:
    """``found`` (``id``, ``label``, ``code``, ``error``) with ``label_error``, the sum over rows of an equal label."""
    found = durable(found, "vector-codes")
    totals = durable(found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e"), F.count(F.lit(1)).alias("n")), "label-errors")
    rows = found.count()
    total = F.when(F.col("e") > 2**63 - 1, F.lit(2**63 - 1)).otherwise(F.col("e")).cast("long")
    totals = totals.select(F.col("label").alias("of"), total.alias("label_error"), (F.col("n") > rows * HOT_SHARE).alias("hot"))
    hot, others = totals.where("hot").drop("hot"), totals.where(~F.col("hot")).drop("hot")
    same = F.col("label").eqNullSafe(F.col("of"))
    at_once = found.join(F.broadcast(hot), same, "inner").drop("of")
    cold = found.join(F.broadcast(hot), same, "left_anti")
    return at_once.unionByName(cold.join(others.hint("merge"), same, "inner").drop("of"))


def compressed(
    rows: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Codes, errors and label errors of all usable rows, and the codebooks (parts x entries x width) they refer to."""
    rows = _usable(rows.select(id_col, vec_col, label_col), id_col, vec_col)
    books = first_books(rows, parts, entries, scale, id_col, vec_col)
    if books is None:
        books = np.zeros((parts, 0, 1), np.int64)
        empty = rows.where(F.lit(False)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.array().cast("array<int>").alias("code"))
        return empty.withColumn("error", F.lit(0).cast("long")).withColumn("label_error", F.lit(0).cast("long")), books
    for _ in range(rounds):
        books = refined(rows, books, scale, id_col, vec_col)
    return with_label_error(coded(rows, books, scale, id_col, vec_col, label_col)), books


def decoded(found: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``id`` and ``vector``: the entries that a code stands for, as components of the original scale."""
    values = (books / scale).tolist()
    table = F.lit([[list(map(float, e)) for e in part] for part in values])
    at = F.transform("code", lambda c, p: F.element_at(F.element_at(table, p + 1), c + 1))
    return found.select("id", F.flatten(at).alias("vector"))
