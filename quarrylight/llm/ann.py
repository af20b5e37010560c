"""Nearest neighbours by a block matrix join over int8 tiles.

A vector is rounded to int8 with its own scale.  The product of two rounded
vectors is off by at most ``|x| * |q - q'| + |q'| * |x - x'|`` (Cauchy-Schwarz on
the two rounding errors), so a tile of int8 products gives an interval for each
score.  Pairs whose upper end is under the k-th best lower end cannot be among the
``k`` nearest; the others are recomputed in double precision on the original
vectors and merged with a heap.  The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from .blocks import nearest

BLOCK, BATCH = 4096, 256


def quantised(x: np.ndarray):
    """int8 values (held as floats in which their products are exact), scale, norm of the rounded vector, of the error and of the vector."""
    wide = x.astype(np.float64)
    scale = np.abs(wide).max(axis=1) / 127
    codes = np.rint(wide / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    kind = np.float32 if 127 * 127 * x.shape[1] < 2**24 else np.float64
    return codes.astype(kind), scale, norm(back), norm(wide - back), norm(wide)


def in_order_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of ``q`` with the rows of ``x`` in double precision, summed component by component."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += q[j] * x[:, j]
    return total


def tile_search(q_ids, q, ids, x, k):
    """The search of one query block in one share, for :func:`quarrylight.llm.blocks.nearest`."""
    codes, scale, rounded, error, size = quantised(x)
    q_codes, q_scale, q_rounded, q_error, q_size = quantised(q)
    wide, q_wide = x.astype(np.float64), q.astype(np.float64)
    for b in range(0, len(q_ids), BATCH):
        own = q_ids[b : b + BATCH]
        part = slice(b, b + len(own))
        heaps: list[list] = [[] for _ in own]  # (score, -id): the smallest is the one to go
        bar = np.full(len(own), -np.inf)
        for a in range(0, len(ids), BLOCK):
            names, cols = ids[a : a + BLOCK], slice(a, a + BLOCK)
            about = (q_codes[part] @ codes[cols].T) * q_scale[part][:, None] * scale[cols]
            slack = q_error[part][:, None] * size[cols] + q_rounded[part][:, None] * error[cols]
            slack += 1e-6 * q_size[part][:, None] * size[cols]  # rounding of these sums themselves
            others = names[None, :] != own[:, None]
            if len(names) > k:
                low = np.where(others, about - slack, -np.inf)  # a query's own rows, however many, are no candidates
                bar = np.maximum(bar, -np.partition(-low, k - 1, axis=1)[:, k - 1])
            alive = (about + slack >= bar[:, None]) & others
            for i in np.flatnonzero(alive.any(axis=1)):
                left = np.flatnonzero(alive[i])
                heap = heaps[i]
                for s, v in zip(in_order_products(q_wide[b + i], wide[cols][left]).tolist(), names[left].tolist(), strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    elif (s, -v) > heap[0]:
                        heapq.heapreplace(heap, (s, -v))
                if len(heap) == k:
                    bar[i] = max(bar[i], heap[0][0])
        for i, heap in enumerate(heaps):
            if heap:
                yield b + i, np.array([-v for _, v in heap], np.int64), np.array([s for s, _ in heap])


def nearest_neighbours(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` largest inner products per query; see :func:`quarrylight.llm.blocks.nearest`.

    Zero vectors take no part besides those named there.  Fewer candidates than ``k`` are all
    returned; an empty table gives an empty result.
    """
    return nearest(rows, k, every, tile_search, False, "double", id_col, vec_col)
