"""Exact top-k and nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest

from quarrylight.llm import ann, blocks, topk

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, q int, share string, ids string"


def awkward():
    rnd = random.Random(5)
    data = [(i, [rnd.gauss(0, 1) for _ in range(6)], 1, 1, "s", "i") for i in range(120)]
    data += [(200 + i, [1.0, 2.0, 3.0, -1.0, 0.5, 0.25], 1, 1, "s", "i") for i in range(60)]  # one vector of very many rows
    data += [
        (400, None, None, None, None, None),
        (420, [], 1, 1, "s", "i"),
        (440, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1, 1, "s", "i"),
        (460, [float("nan")] * 6, 1, 1, "s", "i"),
        (480, [float("inf")] + [0.0] * 5, 1, 1, "s", "i"),
        (500, [0.0] * 6, 1, 1, "s", "i"),
        (520, [1.0, 2.0], 1, 1, "s", "i"),
        (521, [3.0, 2.0], 1, 1, "s", "i"),
        (None, [1.0] * 6, 1, 1, "s", "i"),
        (540, [1e4, -1e4, 1e4, 0.0, 0.0, 1.0], 1, 1, "s", "i"),
    ]
    return data


@pytest.fixture(scope="module", params=["awkward", "empty", "small"])
def rows(request, spark):
    if request.param == "small":
        return spark.read.parquet(f"{SMALL}/embeddings.parquet")
    return spark.createDataFrame(awkward() if request.param == "awkward" else [], SCHEMA).repartition(3)


def usable(rows, zeros):
    out = []
    for r in rows.collect():
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zeros and not any(v)):
            continue
        out.append((r.vec_id, v))
    return out


def brute(vs, score, k=20, every=20):
    out = []
    for q, a in vs:
        if q % every == 0:
            found = sorted((-score(a, b), i) for i, b in vs if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


def test_exact_top_k(rows):
    score = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))
    got = topk.exact_top_k(rows)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(usable(rows, True), score))


def test_nearest(rows):
    def score(a, b):
        t = 0.0
        for x, y in zip(a, b, strict=True):
            t += x * y
        return t

    got = ann.nearest_neighbours(rows)
    assert sorted(map(tuple, got.collect())) == sorted(brute(usable(rows, False), score))


@pytest.mark.parametrize("seed", range(5))
def test_reading_stops_early_and_stays_exact(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(700, 16)) + 3 * rng.normal(size=(7, 16))[np.arange(700) % 7]
    ids = np.arange(700)
    shares = []
    search = topk.no_random_access(64, block=256, shares=shares)
    got = {i: sorted(zip((-s).tolist(), f.tolist(), strict=True)) for i, f, s in search(ids[::20], x[::20], ids, x, 20)}
    xi = topk.to_ints(x, 64)
    for n, q in enumerate(ids[::20]):
        s = xi @ xi[q]
        assert got[n] == sorted((-int(s[i]), int(i)) for i in ids if i != q)[:20]
    assert len(shares) == 3 * 35 and np.mean([s for _, s in shares]) < 0.8  # of each list; one that is read to the end has 1


def test_sums_beyond_64_bits_keep_their_order(spark):
    data = [(0, [1e18, 1e18]), (1, [1e18, 1e18]), (2, [9e17, 1e18]), (3, [-1e18, -1e18]), (4, [1e300, 0.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.exact_top_k(rows).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 2, 2**63 - 1), (3, 4, 2**63 - 1), (4, 3, -(2**63))]


def test_sql_of_the_searches(spark):
    import duckdb

    from quarrylight.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    for name in ("op5_exact_top_k", "op8_nearest_neighbours"):
        got = queries.queries()[name](spark, SMALL).select("query_id", "rank", "vec_id", "score").collect()
        want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got)) == sorted(want)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 3)
    monkeypatch.setattr(blocks, "SHARE", 10)
    rows = spark.createDataFrame(awkward(), SCHEMA).repartition(5)
    score = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))
    assert sorted(map(tuple, topk.exact_top_k(rows).collect())) == sorted(brute(usable(rows, True), score))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 32)).astype(np.float32)
    codes, scale, rounded, error, size = ann.quantised(x)
    about = (codes @ codes.T) * scale[:, None] * scale
    true = x.astype(float) @ x.astype(float).T
    assert (np.abs(true - about) <= error[:, None] * size + rounded[:, None] * error + 1e-6 * size[:, None] * size).all()


@pytest.mark.parametrize("shift", [0.0, 1e-3])
def test_repeated_rows_of_the_query(spark, shift):
    rng = np.random.default_rng(2)
    own = [3.0, 1.0, 2.0, -1.0, 0.5, 2.5]
    data = [(20, [x + shift * i for x in own]) for i in range(30)] + [(40, own)] * 3 + [(21 + i, own) for i in range(4)]
    data += [(100 + i, rng.normal(size=6).tolist()) for i in range(400)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(1)
    vs = [(i, v) for i, v in data]
    whole = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))
    assert sorted(map(tuple, topk.exact_top_k(rows).collect())) == sorted(brute(vs, whole))

    def score(a, b):
        t = 0.0
        for x, y in zip(a, b, strict=True):
            t += x * y
        return t

    assert sorted(map(tuple, ann.nearest_neighbours(rows).collect())) == sorted(brute(vs, score))


def test_first_of_equal_vectors():
    ids = np.array([5] * 30 + [7] * 2 + list(range(8, 60)))
    kept, _ = blocks._distinct_first(ids, np.ones((len(ids), 2)), 20)
    for q in (1, 5, 7, 8, 30):
        assert [i for i in kept if i != q][:20] == [i for i in ids if i != q][:20]
    assert len(kept) <= 40
