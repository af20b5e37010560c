"""Operators read all rows of their tables, however many a group has."""

import random
from collections import Counter

import duckdb

from quarrylight.operators import grounding, origins, windows
from quarrylight.plans import catalogue, harness


def walked(rows, budget):
    took = {}
    for p in {r[0] for r in rows}:
        used, out = 0, []
        for at, (_, _, n) in enumerate(sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2] is not None, r[2] or 0))):
            if n is not None and used + n <= budget:
                used += n
                out.append(at)
        took[p] = out
    return took


def test_budget_walk_reads_every_row(spark):
    rnd = random.Random(3)
    rows = [("late", i, 1000) for i in range(21)] + [("late", 21 + i, 900) for i in range(500)] + [("late", 600, 50), ("late", 601, 950)]
    rows += [("hot", i, rnd.choice([0, None, *range(1, 400)])) for i in range(3000)] + [("hot", 7, 5), ("hot", 7, 5)]
    rows += [(None, i, 20001 - i) for i in range(300)] + [("none", 1, 30000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc_id long, n long").repartition(7)
    for budget in (20000, 20050, 777):
        got = {r.source: r.took for r in windows.budget_walk(df, "source", "doc_id", "n", budget).collect()}
        assert got == walked(rows, budget)
    assert windows.budget_walk(df.where("false"), "source", "doc_id", "n", 9).count() == 0


def test_comparability_covers_all_suppliers(spark):
    d = "/root/testdata/sf0.01"
    names = catalogue.queries()
    of = {r.s_suppkey: r["class"] for r in names["comparability_members"](spark, d).collect()}
    classes = {(r.a, r.b): r for r in names["comparability_classes"](spark, d).collect()}
    rows = [(r.s_suppkey, r.s_nationkey) for r in spark.read.parquet(f"{d}/supplier.parquet").collect()]
    assert set(of) == {k for k, _ in rows} and max(of) > 60
    seen = Counter()
    for k, g in rows:
        for j, h in rows:
            if g == h and k < j:
                pair = tuple(sorted((of[k], of[j])))
                scope = "missing_scope" if k % 3 == 0 or j % 3 == 0 else "different_scope" if k % 2 != j % 2 else ""
                assert classes[pair].reasons == ",".join(filter(None, [scope, "different_unit" if k % 5 != j % 5 else ""]))
                seen[pair] += 1
    assert seen == Counter({k: r.pairs for k, r in classes.items() if r.pairs})


def test_ids_and_matrix_have_no_filters(spark, tmp_path):
    spark.createDataFrame([(i, "same") for i in range(300)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([("A", "F", 3, 10.0), ("A", "F", 5, 50.0)], "l_returnflag string, l_linestatus string, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    names = catalogue.queries()
    assert {r.item_id: r.dense_id for r in names["dense_claim_ids"](spark, tmp_path).collect()} == {i: f"c{i + 1}" for i in range(300)}
    assert [tuple(r) for r in names["comparison_matrix"](spark, tmp_path).collect()] == [("A", "3 / 5", "")]


def test_research_queries_cover_all_parts(spark):
    d = "/root/testdata/sf0.001"
    got = catalogue.queries()["research_queries"](spark, d)
    assert got.select("p_partkey").distinct().count() == spark.read.parquet(f"{d}/part.parquet").count()


def test_origin_groups(spark):
    words = [f"word{i} " for i in range(80)]
    near, apart, brief = words[:], words[:], words[:42]
    near[30] = "changed "
    for i in (5, 15, 25, 35, 45):
        apart[i] = "other "
    short = brief[:]
    short[41] = "end "
    rows = [(10, "".join(words), []), (11, "".join(near), []), (12, "".join(apart), []), (13, "".join(reversed(brief)), []), (14, "".join(reversed(short)), [])]
    rows += [(20, "One  Text", []), (21, "one text", ["doi:1"]), (22, "elsewhere", ["arxiv:2", "doi:1"]), (23, "", []), (24, " ", []), (25, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, works array<string>")
    got = {r.doc_id: r.origin for r in origins.origin_groups(df, "doc_id", "text", origins.F.col("works")).collect()}
    assert got == {10: 10, 11: 10, 12: 12, 13: 13, 14: 14, 20: 20, 21: 20, 22: 20, 23: 23, 24: 24, 25: 25}


def test_near_links_connect_what_is_near(spark):
    rnd = random.Random(6)
    data = []
    for _ in range(8):
        members = rnd.sample(range(500), 60)
        for _ in range(14):
            data.append((len(data), sorted(members)))
            if rnd.random() < 0.8:
                members = members[:]
                for _ in range(rnd.randint(1, 3)):
                    members[rnd.randrange(60)] = 1000 + rnd.randrange(5000)
                members = sorted(set(members))
                members += [9000 + i for i in range(60 - len(members))]
    data = [(i, s) for i, s in {tuple(s): i for i, s in data}.items()]
    data = [(i, list(s)) for s, i in data]
    links = origins.near_links(spark.createDataFrame(data, "id long, s array<long>").repartition(3))
    got = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    sets = dict(data)
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    assert got <= near

    def roots(pairs):
        root = {i: i for i in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(sorted(got)) == roots(sorted(near)) and len(near) > 50


def test_concepts_are_spread_as_by_hand(spark):
    concepts = [("alpha",), ("beta", "bet"), ("gamma",)]
    texts = ["alpha beta", "alpha", "gamma", "beta gamma", "none", "alpha beta gamma", "bets", None] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    held = {i: {n for n, terms in enumerate(concepts) if any(x in (t or "") for x in terms)} for i, t in enumerate(texts)}
    for most in (1, 4, 30):
        want, covered, left = [], set(), set(held)
        while left and len(want) < most:
            pick = min(left, key=lambda i: (-len(held[i] - covered), -len(held[i]), i))
            want.append(pick)
            covered |= held[pick]
            left.discard(pick)
        got = grounding.spread_over_concepts(rows, "k", "t", concepts, most).orderBy("place").collect()
        assert [r.k for r in got] == want


def test_cache_entries_end_to_the_microsecond(spark, tmp_path):
    rows = [(1, "2024-01-02 00:00:00.500000"), (2, "2024-01-01 00:00:00.500000"), (3, "2024-01-01 00:00:00.499999"), (4, "2024-01-01 00:00:00.200000"), (5, "2024-01-01 00:00:00.700000")]
    events = spark.createDataFrame(rows, "event_id long, t string").selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "'view' as event_type", "'{}' as props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["search_cache"](spark, tmp_path)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 5]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert harness.compare(got, con, catalogue.oracle_sql()["search_cache"]) == ""
