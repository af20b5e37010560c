"""The n-gram Jaccard join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from fixtures import folder, rows

from quarrylight.llm import ngram_join, queries, shingles

SMALL = "/root/testdata/sf0.01"


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(data, k, percent):
    sets = [shingle_set(t, k) for _, t in data]
    reps = list({s for s in sets if s})
    holders = defaultdict(list)
    for i, s in enumerate(reps):
        for g in s:
            holders[g].append(i)
    root = list(range(len(reps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(reps):
        for j, n in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= percent * (len(s) + len(reps[j]) - n):
                root[find(i)] = find(j)
    index = {s: i for i, s in enumerate(reps)}
    least = {}
    for (i, _), s in zip(data, sets, strict=True):
        if s and i is not None:
            c = find(index[s])
            least[c] = min(least.get(c, i), i)
    return Counter((i, len(s), least.get(find(index[s]), i) if s else i) for (i, _), s in zip(data, sets, strict=True))


def joined(spark, data, k, percent, **how):
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = ngram_join.classes(docs, k, percent, **how).collect()
    return Counter((r.id, r.n_shingles, r.component_id) for r in got)


@pytest.fixture(scope="module", params=["awkward", "empty", "small"])
def case(request, spark, tmp_path_factory):
    if request.param == "small":
        return SMALL, [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    data = rows() if request.param == "awkward" else []
    return folder(spark, tmp_path_factory.mktemp(request.param), data), [r[:2] for r in data]


def test_query(spark, case):
    sf_dir, data = case
    got = queries.queries()["op2_ngram_join"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data, 4, 85)


def made(seed, groups=12, size=14, most=60):
    """Groups of texts that drift apart word by word, short and long, around the threshold."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = rnd.choices(words, k=12)
    out = []
    for _ in range(groups):
        text = rnd.choices(words, k=rnd.randint(1, most))
        if rnd.random() < 0.3:
            text += common
        for _ in range(rnd.randint(1, size)):
            out.append(" ".join(text))
            if rnd.random() < 0.8:
                text = list(text)
                for _ in range(rnd.randint(1, 2)):
                    text[rnd.randrange(len(text))] = rnd.choice(words)
                if rnd.random() < 0.5:
                    text.append(rnd.choice(words))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,k,percent,boundary", [(1, 4, 85, None), (2, 5, 80, 0), (3, 1, 60, 9), (4, 2, 70, 15)])
def test_drifting_groups(spark, seed, k, percent, boundary):
    data = made(seed)
    assert joined(spark, data, k, percent, boundary=boundary) == brute(data, k, percent)


def test_long_lists_are_scanned_in_parts(spark):
    data = made(7, groups=6, size=60, most=70)
    want = brute(data, 3, 75)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = ngram_join.classes(docs, 3, 75, boundary=0, buckets=3, unit=4, part=7, together=9).collect()
    assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == want


def test_a_hot_list_leaves_its_task_no_larger_than_it_came():
    np, n = ngram_join.np, 200_000
    entries = np.zeros(n, ngram_join.ENTRY)
    entries["token"], entries["name"], entries["size"], entries["place"] = 7, np.arange(n), 40, 1
    got = ngram_join._lists(85, 512)(ngram_join.pd.DataFrame({"part": [0], "entries": [entries.tobytes()]}))
    assert got["members"].str.len().sum() == n * ngram_join.MEMBER.itemsize  # 3.2 MB
    assert len(got) == got["parts"].iloc[0] == -(-n // 512) and got["members"].str.len().max() <= 512 * ngram_join.MEMBER.itemsize


def test_long_lists_of_the_same_sets_in_several_shingles(spark):
    """The shared shingles stand at other places of each set's order, and parts of one list must not meet those of another."""
    rnd = random.Random(11)
    shared = [f"s{i}" for i in range(24)]
    data = []
    for i in range(90):
        own = [f"x{i}_{j}" for j in range(rnd.randint(0, 9))]
        at = rnd.randrange(len(shared))
        text = shared + own if rnd.random() < 0.5 else own + shared
        data.append((i, " ".join(text[:at] + [f"y{i}"] + text[at:])))
    for seed in (4, 5):
        assert joined(spark, data, 2, 70, boundary=0, unit=seed, part=30) == brute(data, 2, 70)


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary({}, {}, 85) == 0
    crowded = {7: 1000, 8: 1000}
    assert ngram_join.choose_boundary(crowded, {7: 1e9, 8: 1e9}, 85) > 8
    assert ngram_join.choose_boundary({15: 1000}, {15: 0.0}, 85) == 0


def test_bitmaps_never_reject_a_link():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.choice([3, 30, 600, 3000])
        a = shingles.np.array(sorted({rnd.getrandbits(63) for _ in range(n)}), shingles.np.uint64)
        b = shingles.np.array(sorted([*a[: int(n * 0.95)].tolist(), *(rnd.getrandbits(63) for _ in range(max(1, n // 30)))]), shingles.np.uint64)
        both = len(set(a.tolist()) & set(b.tolist()))
        if both >= ngram_join.overlap_needed(len(a), len(b), 85):
            assert ngram_join.may_link(len(a), ngram_join.parity_bitmap(a), len(b), ngram_join.parity_bitmap(b), 85)


def test_links_of_a_chain(spark):
    data = [(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i j k l m n o p q r s u"), (3, "x y"), (4, None)]
    got = {r.id: r.links for r in ngram_join.classes(spark.createDataFrame(data, "doc_id long, text string"), 4, 85).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


@pytest.mark.parametrize("together", [512, 9])
def test_links_of_long_lists_are_all_counted(spark, together):
    words = [f"w{i}" for i in range(120)]
    data = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(60)] + made(7, groups=6, size=40, most=70)
    data = [(i, t) for i, (_, t) in enumerate(data)]
    sets = {i: shingle_set(t, 3) for i, t in data}
    distinct = set(filter(None, sets.values()))
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {i: sum(linked(s, o) for o in distinct if o != s) if s else 0 for i, s in sets.items()}
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.id: r.links for r in ngram_join.classes(docs, 3, 75, together=together).collect()}
    assert got == want and max(want.values()) >= 40
