"""Exact top-k search by no-random-access aggregation over sorted lists.

Each component of the candidates is a list sorted by value.  A query reads the
lists in step, from the top where its own component is positive and from the
bottom where it is negative, and adds what it reads to the sums of the candidates
that it meets.  What a list has not shown yet of a candidate is at best the value
at which reading stands and at worst the list's far end, which bounds every
candidate's score from above and below.  A candidate whose upper bound is under
the k-th best lower bound, or under the k-th best score found in earlier blocks,
is out.  A query stops reading when all but some few times ``k`` candidates are
out, and the scores of these few are resolved; what it reads to the end is known.

A batch of queries reads together: a step adds the part of the lists between two
depths, as a product with the values that were met there and zeros elsewhere.

Defined results (besides those of :mod:`quarrylight.llm.blocks`): equal scores fall
to the smaller id; ``floor(scale * x)`` beyond 64 bits is the nearest 64-bit number,
and so is a score beyond them, while ranks follow the exact sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .blocks import nearest

BLOCK, BATCH = 4096, 256
#: Shares of the lists after which the bounds are looked at; the last is the whole list.
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.5625, 0.625, 0.6875, 0.75, 0.8125, 0.875, 0.9375, 1.0)
#: A query stops when at most so many times ``k`` candidates are left.
LEFT = 3
_LOW, _HIGH = -(2**63), 2**63 - 1


def to_ints(x: np.ndarray, scale: int) -> np.ndarray:
    wide = np.floor(scale * x.astype(np.float64))
    inside = np.abs(wide) < 2.0**63
    return np.where(inside, np.where(inside, wide, 0).astype(np.int64), np.where(wide > 0, _HIGH, _LOW))


def _exact_type(q: np.ndarray, x: np.ndarray):
    """The narrowest type in which all products and sums are exact; Python's numbers if no other is."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def _merged(held: tuple, names: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of both, ids ascending."""
    ids, scores = np.concatenate([held[0], names]), np.concatenate([held[1], scores])
    if len(ids) > k:
        # Ids ascend from block to block, so a stable sort leaves equal scores to the smaller id.
        near = np.argsort(-scores, kind="stable")[:k]
        near.sort()
        ids, scores = ids[near], scores[near]
    return ids, scores


def no_random_access(scale: int, depths=DEPTHS, block: int = BLOCK, shares: list | None = None):
    """The search of one query block in one share of the candidates, for :func:`quarrylight.llm.blocks.nearest`.

    ``shares`` (for tests) takes a pair (query id, share of the lists read) per query and block.
    """

    def best(q_ids, q, ids, x, k):
        qi, xi = to_ints(q, scale), to_ints(x, scale)
        kind = _exact_type(qi, xi)
        lists = []
        for a in range(0, len(ids), block):
            part = xi[a : a + block]
            order = np.argsort(part, axis=0, kind="stable")  # the sorted lists
            depth = np.empty(order.shape, np.int32)
            np.put_along_axis(depth, order, np.arange(len(part), dtype=np.int32)[:, None], axis=0)
            lists.append((ids[a : a + block], part.astype(kind), np.take_along_axis(part, order, axis=0).astype(kind), depth))
        for b in range(0, len(q_ids), BATCH):
            own = q_ids[b : b + BATCH]
            batch = qi[b : b + BATCH].astype(kind)
            up, down = np.maximum(batch, 0), np.minimum(batch, 0)
            held = [(np.array([], np.int64), np.array([], kind))] * len(own)
            bar = np.full(len(own), -np.inf)  # k-th best score so far
            for names, part, ordered, depth in lists:
                n, before = len(names), 0
                at = np.arange(len(own))  # queries that still read
                others = names[None, :] != own[:, None]
                alive, sums = others.copy(), np.zeros((len(own), n), kind)
                for share in depths:
                    read = min(n, int(np.ceil(share * n)))
                    top, bottom = depth >= n - read, depth < read
                    sums += up[at] @ np.where(top & (depth < n - before), part, 0).T + down[at] @ np.where(bottom & (depth >= before), part, 0).T
                    before, hidden, hidden_low = read, (~top).astype(kind).T, (~bottom).astype(kind).T
                    high, low = ordered[n - read], ordered[read - 1]  # where reading stands
                    if n > k:
                        worst = sums + (up[at] * ordered[0]) @ hidden + (down[at] * ordered[-1]) @ hidden_low
                        bar[at] = np.maximum(bar[at], _kth(np.where(others[at], worst, -np.inf), k))  # a query's own rows, however many, are no candidates
                    alive &= sums + (up[at] * high) @ hidden + (down[at] * low) @ hidden_low >= bar[at][:, None]
                    stops = (alive.sum(axis=1) <= LEFT * k) | (read == n)
                    for i in np.flatnonzero(stops):
                        if shares is not None:
                            shares.append((int(own[at[i]]), read / n))
                        left = np.flatnonzero(alive[i])
                        scores = sums[i, left] if read == n else part[left] @ batch[at[i]]
                        held[at[i]] = _merged(held[at[i]], names[left], scores, k)
                        if len(held[at[i]][0]) == k:
                            bar[at[i]] = max(bar[at[i]], held[at[i]][1].min())
                    at, alive, sums = at[~stops], alive[~stops], sums[~stops]
                    if not len(at):
                        break
            for i, (found, scores) in enumerate(held):
                if len(found):
                    yield b + i, found, np.clip(scores, _LOW, _HIGH) if kind is object else scores

    return best


def exact_top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products per query; see :func:`quarrylight.llm.blocks.nearest`.

    Components are ``floor(scale * x)``.  Fewer candidates than ``k`` are all returned; an empty
    table gives an empty result; extra columns are ignored.
    """
    return nearest(rows, k, every, no_random_access(scale), True, "long", id_col, vec_col)
