"""Scores against gold facts on hand-made packets."""

import hashlib

import pytest

from quarrylight.operators import evaluation as E

FACTS = "case_id string, fact_id string, patterns array<string>, reference string, urls array<string>"
SENTENCES = "case_id string, sentence_id long, text string, status string, citation_ids array<long>"
CASES = "case_id string, forbidden array<string>, expects_abstention boolean, abstained boolean, expected_mode string, mode string, expected_origins int, origins int"


@pytest.fixture(scope="module")
def packet(spark):
    sentences = spark.createDataFrame(
        [
            ("a", 1, "Profit ROSE by 3.5% in 2023.", "supported", [1, 1, 2]),
            ("a", 2, "Profit rose by -9% in Peru.", "supported", [2]),
            ("a", 3, "Costs fell by 8%.", "withheld", [1]),
            ("b", 4, "Profit rose by 3.5%.", "supported", [1]),
            ("c", 5, "This is guaranteed\nto rise.", "supported", [1]),
            ("d", 6, None, "supported", None),
        ],
        SENTENCES,
    )
    citations = spark.createDataFrame([("a", 1, "u1"), ("a", 2, "u2"), ("b", 1, "u1"), ("c", 1, "u1")], "case_id string, citation_id long, url string")
    facts = spark.createDataFrame(
        [
            ("a", "rose", ["profit", r"rose by [0-9]"], "3.5%", ["u1", "u9", "u1"]),
            ("a", "sign", ["profit"], "9%", ["u2"]),  # said with another sign
            ("a", "source", ["rose by 3"], "3.5%", ["u3"]),  # said, but not from there
            ("a", "both", ["2023", "peru"], "", ["u2"]),  # no one sentence has both
            ("a", "withheld", ["costs"], None, ["u1"]),
            ("a", "any", None, None, ["u2"]),
            ("a", "no source", ["profit"], None, None),
            ("b", "rose", ["profit", None], "3.5%", ["u1"]),
            ("c", "rise", ["rise"], None, ["u1"]),
        ],
        FACTS,
    )
    return facts, sentences, citations


def test_a_fact_needs_patterns_numbers_and_source_in_one_sentence(packet):
    got = {(r["case_id"], r["fact_id"]): r["covered"] for r in E.covered_facts(*packet).collect()}
    assert {k for k, v in got.items() if v} == {("a", "rose"), ("a", "any"), ("b", "rose"), ("c", "rise")}
    assert len(got) == 9


def _scores(spark, packet, cases, violations=()):
    rows = spark.createDataFrame([(*c, *[None] * (8 - len(c))) for c in cases], CASES)
    got = E.score_cases(rows, *packet, spark.createDataFrame(list(violations), "case_id string, kind string"))
    return {r["case_id"]: r.asDict() for r in got.collect()}


def test_scores(spark, packet):
    got = _scores(spark, packet, [("a", ["Nothing"]), ("b", None), ("c", ["GUARANTEED"]), ("d", [], True, True), ("e", [], True, True), ("f", [], True, False), ("g", [])])
    assert (got["a"]["covered"], got["a"]["facts"], got["a"]["coverage"], got["a"]["passed"]) == (2, 7, 0.285714, False)
    assert got["a"]["missing"] == ["both", "no source", "sign", "source", "withheld"]
    assert got["b"]["passed"] and got["b"]["forbidden"] == [] and got["b"]["coverage"] == 1
    assert got["c"]["forbidden"] == ["GUARANTEED"] and got["c"]["coverage"] == 1 and not got["c"]["passed"]
    assert not got["d"]["passed"]  # publishes a sentence
    assert got["e"]["passed"] and not got["f"]["passed"]
    assert got["g"]["coverage"] is None and got["g"]["missing"] == [] and not got["g"]["passed"]


def test_a_broken_packet_covers_nothing(spark, packet):
    got = _scores(spark, packet, [("b", []), ("e", [], True, True)], [("b", "quote_not_at_offset"), ("b", "quote_not_at_offset"), ("e", "source_changed")])
    assert (got["b"]["covered"], got["b"]["errors"], got["b"]["missing"], got["b"]["passed"]) == (0, ["quote_not_at_offset"], ["rose"], False)
    assert not got["e"]["passed"]


def test_mode_and_origins_are_checked_where_expected(spark, packet):
    got = _scores(spark, packet, [("b", [], None, None, "snapshot", None, 2, 2), ("e", [], True, True, None, "x", 2, 1)])
    assert got["b"]["errors"] == ["expected_evidence_mode_missing"] and not got["b"]["passed"]
    assert got["e"]["errors"] == ["unexpected_origin_group_count"] and not got["e"]["passed"]


def test_empty_tables(spark, packet):
    facts, sentences, citations = (t.limit(0) for t in packet)
    assert E.covered_facts(facts, *packet[1:]).count() == 0
    assert not any(r["covered"] for r in E.covered_facts(packet[0], sentences, citations).collect())


def test_dataset_errors(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    source = "source_id string, url string, text string, sha256 string, published_at string, units array<string>"
    good = [("s1", "https://x", "one two", sha("one two"), "2024", ["two"]), ("s2", "https://y", "", sha(""), "2024", None)]
    case, fact = "case_id string, source_ids array<string>", "case_id string, fact_id string, source_ids array<string>"
    cases, facts = spark.createDataFrame([("c", ["s1"])], case), spark.createDataFrame([("c", "f", ["s1"])], fact)
    assert E.dataset_errors(spark.createDataFrame(good, source), cases, facts).count() == 0
    bad = [*good, ("s2", "http://y", "z", "?", None, ["no"])]
    cases, facts = spark.createDataFrame([("c", ["s1", "s9"]), ("c", None)], case), spark.createDataFrame([("c", "f", ["s2"])], fact)
    got = {tuple(r) for r in E.dataset_errors(spark.createDataFrame(bad, source), cases, facts).collect()}
    assert got == {
        ("repeated_source", "s2"), ("source_hash", "s2"), ("source_provenance", "s2"), ("unit_not_in_source", "s2"), ("repeated_case", "c"), ("unknown_source", "c"), ("fact_source_outside_case", "f"),
    }


def test_gold_words_are_those_of_the_sql(spark, tmp_path):
    """A fact's two words were the first of its text, not the first that the SQL's list has; what decides here is which two they are."""
    from quarrylight.plans import evaluation_queries, harness
    from quarrylight.session import TABLES

    said = {5: "Alpha reported beta gamma delta.", 25: "Alpha reported omega.", 6: "Alpha reported beta gamma delta.", 26: "Delta gamma reported omega.", 7: "Café zeta is a beta2 of 1.5 secrets.", 27: "The secrets were 1.5 beta2."}
    docs = [(i, t, "en", "s", len(t)) for i, t in said.items()]
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", [(i, 1, int(i < 20)) for i in said], "doc_id long, quality int, toxic int")):
        (tmp_path / f"{name}.parquet").unlink()
        spark.createDataFrame(rows, kind).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    con = harness.duck(str(tmp_path))
    for name in ("gold_facts", "gold_cases"):
        assert harness.compare(getattr(evaluation_queries, name)(spark, str(tmp_path)), con, evaluation_queries.ORACLES[name]) == ""
    assert {r[0] for r in con.execute(f"SELECT fact_id FROM ({evaluation_queries.ORACLES['gold_facts']}) WHERE covered").fetchall()} == {7, 25, 26, 27}
