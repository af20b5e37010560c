"""Searches of a stated query set against all rows, in blocks.

Queries are dealt to blocks of bounded size by a hash of their id and packed into
one row each; all rows are packed where they stand into blocks of vectors.  A
task gets one query block and a share of the vector blocks and returns the best
``k`` of its share per query; these are merged with heaps per query.  A task's
memory is bounded by the two block sizes, and nothing is broadcast.

Of rows with equal vectors only the first ``k`` by id can be among the ``k`` best
(equal scores fall to the smaller id), besides the query's own rows, of which an
id may have any number.  What no query needs goes, at most ``2 k`` rows of a vector
stay, so a vector that very many rows share costs no more.

Rows without an id, and vectors that are null, empty or hold null or non-finite
components, take no part; vectors of another dimension than the query's cannot
be scored and are no candidates of it.  Rows with the query's id are its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import durable

#: Queries of a block, vectors of a task's share, vectors of one packed row.
QUERY_BLOCK, SHARE, ROW = 8192, 65536, 4096
MERGE_ROWS = 100_000


def vectors(column: pa.Array, ids: pa.Array, zeros: bool):
    """(dimension, ids, matrix) for each dimension among the usable vectors; ``zeros``: keep zero vectors."""
    if isinstance(column, pa.ChunkedArray):
        column, ids = column.combine_chunks(), ids.combine_chunks()
    good = ~(np.asarray(column.is_null()) | np.asarray(ids.is_null()))
    column, ids = column.filter(pa.array(good)), ids.filter(pa.array(good))
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    starts, keys = np.cumsum(sizes) - sizes, np.asarray(ids, np.int64)
    for d in np.unique(sizes):
        if not d:
            continue
        rows = np.flatnonzero(sizes == d)
        x = values[(starts[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
        ok = np.isfinite(x).all(axis=1)
        if not zeros:
            ok &= (x != 0).any(axis=1)
        if ok.any():
            yield int(d), keys[rows][ok], np.ascontiguousarray(x[ok])


def _packer(zeros: bool, kind: str):
    def run(batches):
        for batch in batches:
            for d, ids, x in vectors(batch.column(1), batch.column(0), zeros):
                for a in range(0, len(ids), ROW):
                    i, v = ids[a : a + ROW], np.ascontiguousarray(x[a : a + ROW], kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                        ["dim", "ids", "data"],
                    )

    return run


def _joined(pdf: pd.DataFrame, kind: str):
    """{dimension: (ids, matrix)} of packed rows."""
    out = {}
    for d, part in pdf.groupby("dim"):
        ids = np.concatenate([np.frombuffer(b, np.int64) for b in part["ids"]])
        x = np.concatenate([np.frombuffer(b, kind) for b in part["data"]]).reshape(len(ids), int(d))
        out[int(d)] = (ids, x)
    return out


def _distinct_first(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By ascending id; of equal vectors those alone that are among the first ``k`` once the rows of one other id are left out."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    rows = x.view([("", f"V{x.shape[1] * x.itemsize}")]).ravel()
    _, group, n = np.unique(rows, return_inverse=True, return_counts=True)
    if (n <= k).all():
        return ids, x
    by = np.argsort(group, kind="stable")
    place = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)
    g, i = group[by], ids[by]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])])  # runs of one vector and id
    length = np.diff(np.r_[first, len(by)])
    top = g[first] * (len(by) + 1)
    longest = np.maximum.accumulate(top + length)  # of the runs of a vector up to this one
    before = np.r_[0, np.maximum(longest[:-1] - top[1:], 0)]
    keep = np.sort(by[place - np.repeat(before, length) < k])
    return ids[keep], x[keep]


def nearest(
    rows: DataFrame,
    k: int,
    every: int,
    best: Callable,
    zeros: bool,
    score_type: str,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Per row whose id is divisible by ``every``: its ``k`` best by ``best``.

    ``best(query ids, queries, ids, matrix, k)`` yields (query index, ids, scores) for its share,
    ids ascending; it must return all that can be among the ``k`` best of the share.
    Columns: query_id, rank (from 1), vec_id, score.
    """
    value = rows.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if value == "float" else "<f8"
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    n = base.select(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    q_blocks, shares = max(1, math.ceil(n[1] / QUERY_BLOCK)), max(8, math.ceil(n[0] / SHARE))
    packed = "dim int, ids binary, data binary"
    own = (
        base.where(F.col("id") % every == 0)
        .repartition(q_blocks, F.pmod(F.xxhash64("id"), F.lit(q_blocks)))
        .sortWithinPartitions("id", F.xxhash64("v"))
        .mapInArrow(_packer(zeros, kind), packed)
        .withColumn("block", F.monotonically_increasing_id())
    )
    # Written: partial results meet by block and place, so no recomputed task may pack its rows another way.
    own = (
        durable(own, "query-blocks")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        .withColumn("q", F.pmod(F.col("block"), F.lit(q_blocks)).cast("int"))
    )
    all_rows = (
        base.mapInArrow(_packer(zeros, kind), packed)
        .withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        every_dim = {d: _distinct_first(i, x, k) for d, (i, x) in _joined(right, kind).items()} if len(left) else {}
        for block, dim, ids, data in zip(left["block"], left["dim"], left["ids"], left["data"], strict=True):
            if int(dim) not in every_dim:
                continue
            q_ids = np.frombuffer(ids, np.int64)
            q = np.frombuffer(data, kind).reshape(len(q_ids), int(dim))
            for i, found, scores in best(q_ids, q, *every_dim[int(dim)], k):
                out.append((block, i, q_ids[i], found, scores))
        size = [len(x[3]) for x in out]
        spread = lambda c, t: np.repeat(np.array([x[c] for x in out], t), size)
        cat = lambda c, t: np.concatenate([x[c] for x in out]).astype(t) if out else np.array([], t)
        return pd.DataFrame(
            {"block": spread(0, np.int64), "nth": spread(1, np.int32), "query_id": spread(2, np.int64), "vec_id": cat(3, np.int64), "score": cat(4, np.float64 if score_type == "double" else np.int64)}
        )

    schema = f"block long, nth int, query_id long, vec_id long, score {score_type}"
    partial = own.groupBy("q", "share").cogroup(all_rows.groupBy("q", "share")).applyInPandas(search, schema)
    buckets = max(8, math.ceil(n[1] * shares * k / MERGE_ROWS))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {}
        for b, i, q, v, s in zip(pdf["block"], pdf["nth"], pdf["query_id"], pdf["vec_id"], pdf["score"], strict=True):
            rows.setdefault((b, i, q), []).append((-s, v))
        out = [(q, r, v, -s) for (_, _, q), found in rows.items() for r, (s, v) in enumerate(heapq.nsmallest(k, found), 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    return (
        partial.withColumn("bucket", F.pmod(F.xxhash64("block", "nth"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(merge, f"query_id long, rank int, vec_id long, score {score_type}")
    )
