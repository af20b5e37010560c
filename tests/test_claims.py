"""Claims: pairs of one subject, contradictions and overlap with sources against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import claims as C

WORDS = ["the", "of", "and", "in", *(f"w{i}" for i in range(60))]


def _sets(rnd, n, low, high):
    weights = [400, 300, 200, 100, *([6] * 60)]
    return {i: sorted(set(rnd.choices(WORDS, weights, k=rnd.randint(low, high)))) for i in range(n)}


@pytest.mark.parametrize("cap,least", [(150, 0.5), (12, 0.3), (25, 0.15)])
def test_conflict_pairs_are_those_of_all_pairs(spark, cap, least):
    rows = _sets(random.Random(cap), 120, 1, 12)
    rows[200] = []
    rows |= {300 + i: rows[7] for i in range(3)}
    count = {w: sum(w in s for s in rows.values()) for w in WORDS}
    rare = {i: {w for w in s if count[w] <= cap} for i, s in rows.items()}
    share = min(0.7, least + 0.2)
    want = set()
    for a in rows:
        for b in rows:
            shared, smaller = len(rare[a] & rare[b]), min(len(rows[a]), len(rows[b]))
            if a < b and shared and shared / smaller >= share - 1e-9:
                want.add((a, b, shared, round(shared / smaller, 6)))
    df = spark.createDataFrame(list(rows.items()), "id long, terms array<string>").repartition(3)
    assert {tuple(r) for r in C.conflict_pairs(df, "id", "terms", cap, least).collect()} == want and want


def test_claims_of_pairs_are_made_once(spark):
    """Making terms is the costly part: it was done for the count of claims, and again for their pairs."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        made.add(1)
        return True

    df = spark.createDataFrame(list(_sets(random.Random(1), 50, 3, 6).items()), "id long, terms array<string>").where(seen.asNondeterministic()("id"))
    C.conflict_pairs(df, "id", "terms").collect()
    assert made.value == 50


def test_contradictions_read_numbers_in_claims_of_pairs_alone(spark):
    claims = spark.createDataFrame([(i, f"claim {i // 2 if i < 4 else i}") for i in range(40)], "id long, claim string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")

    @F.udf("array<string>")
    def numbers(text):
        if text not in ("claim 0", "claim 1"):
            raise ValueError(text)
        return [text]

    assert {tuple(r) for r in C.contradictions(pairs, claims, "id", "claim", numbers.asNondeterministic()).select("a", "b").collect()} == {(1, 2)}


@pytest.mark.parametrize("least,prefilter", [(0.5, 4), (0.85, 4), (0.3, 1), (1.0, 2)])
def test_best_overlap_is_that_of_all_sentences(spark, least, prefilter):
    rnd = random.Random(5)
    claims, sentences = _sets(rnd, 40, 1, 14), {}
    for k, s in _sets(rnd, 400, 1, 16).items():
        sentences[k // 20, k % 20] = rnd.choice(list(claims.values()))[:9] + ["x"] if k % 9 == 0 else s
    want = {}
    for c, mine in claims.items():
        for (doc, at), s in sorted(sentences.items()):
            shared = len(set(mine) & set(s))
            if shared >= prefilter and shared >= least * len(mine) - 1e-9 and shared > want.get((c, doc), (0, 0))[0]:
                want[c, doc] = shared, at
    left = spark.createDataFrame(list(claims.items()), "claim long, c array<string>")
    right = spark.createDataFrame([(d, a, s) for (d, a), s in sentences.items()], "doc long, at int, s array<string>").repartition(3)
    got = C.best_overlap(left, right, "claim", "c", "doc", "s", "at", least, prefilter)
    assert {(r.claim, r.doc): (r.overlap, r["at"]) for r in got.collect()} == {k: (round(n / len(claims[k[0]]), 6), at) for k, (n, at) in want.items()}
    # No shuffle of pairs of claims and sentences: what is shuffled is the best hits of a task.
    assert "hashpartitioning(claim" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", at#" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning(")[1:])


def test_terms_and_sentences_as_before(spark):
    texts = ["Mr. A met Dr.B. vs. x e.g. u.s. U.K. 3.5 a 1 b2 _c 中 国内 字\x01x", "odr. Go!  ok?\n\nNo。是！\r\f e. g. DR. a b.", ".\n. MRS. x. i.e.\ty", None, "", "a.  b!\x0bc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plain(text):
        import re

        out = (text or "").strip(" ")
        for w in X.ABBREVIATIONS:
            out = re.sub(rf"\b{re.escape(w)}", lambda m: m[0].replace(".", "\x01"), out, flags=re.I | re.A)
        parts = re.split(r"(?<=[。！？!?])\s*|(?<=\.)\s+|[\r\n\f]+", out, flags=re.A)
        return [p for p in (re.sub("\x01", ".", p).strip(" \t\n\x0b\f\r") for p in parts) if p]

    assert [r[0] for r in df.select(X.sentences(F.col("t"))).collect()] == [plain(t) for t in texts]
    every = F.array_distinct(X.tokens(F.col("t")))
    slow = F.filter(every, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))
    assert df.where(X.content_terms(F.col("t")) != slow).count() == 0


def test_the_share_of_conflicts_is_the_same_for_any_number_of_claims(spark, monkeypatch):
    """Above 100 claims only pairs with 0.7 of the smaller one's terms were found."""
    from quarrylight.plans import claim_queries as P

    texts = {0: "Alpha beta was gamma delta.", 1: "Alpha beta was omega sigma."} | {10 + i: f"Word{i} is number{i}." for i in range(160)}
    for n in (2, 200):
        rows = [(i, t) for i, t in texts.items()][:n]
        monkeypatch.setattr(P, "T", lambda s, d, name, rows=rows: s.createDataFrame(rows, "doc_id long, text string"))
        assert (0, 100_000) in {(r.a, r.b) for r in P.conflict_pairs(spark, "").collect()}
        monkeypatch.setattr(P.Q, "plain_signatures", lambda c: F.array(F.substring(c, 16, 5)))
        assert (0, 100_000) in {(r.a, r.b) for r in P.contradictions(spark, "").collect()}


def test_short_claims_have_their_best_sentences_too(spark, monkeypatch):
    """Claims of fewer than four terms and sentences with fewer than four shared ones were left out."""
    from quarrylight.plans import claim_queries as P

    tables = {
        "benchmark": ("item_id", [(1, "Alpha beta."), (2, "Alpha beta gamma delta omega sigma."), (3, "Kappa."), (4, "x")]),
        "documents": ("doc_id", [(10, "Beta zeta. Alpha beta."), (11, "Gamma. Omega delta gamma. Gamma delta omega alpha."), (12, "None. Kappa!"), (13, "beta")]),
    }
    monkeypatch.setattr(P, "T", lambda s, d, name: s.createDataFrame(tables[name][1], f"{tables[name][0]} long, text string"))
    got = {(r.claim_id, r.doc_id, r["at"], r.overlap) for r in P.best_overlap(spark, "").collect()}
    assert got == {(1000, 10, 1, 1.0), (1000, 11, 2, 0.5), (1000, 13, 0, 0.5), (2000, 11, 2, 0.666667), (3000, 12, 1, 1.0)}
