"""Slots, drafts, wording, tools, passages, records and folding, on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import gateway as G
from quarrylight.operators import graph, grounding, packets, screening
from quarrylight.operators import knowledge as K
from quarrylight.operators.retrieval import RequestContext, WebQuery, contains_json, visible
from quarrylight.sources import records as R
from quarrylight.sources import registry as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_slots(spark):
    got = one(spark, K.slots(F.lit("Acme's net profit was about 12 bn in 2024.")))
    assert (got.entity, got.attribute, got.qualifier, got.time_scope) == ("Acme", "net profit", "about", "2024")
    got = one(spark, K.slots(F.lit("nothing here")))
    assert got.entity is None and got.value is None


@pytest.mark.parametrize("text,want", [("Q3 2024 and FY2023", ["2024Q3", "FY2023"]), ("2024 Q1, then 2024", ["2024Q1"]), ("in 2022 and 2020", ["2020", "2022"]), ("12024 or 20245", []), ("", [])])
def test_periods(spark, text, want):
    assert one(spark, K.periods(F.lit(text))) == want


def test_mentions(spark):
    for text, want in [("Acme grew", True), ("Acme2 grew", False), ("the acme.", True), ("Acmes", False)]:
        assert one(spark, K.mentions(F.lit(text), F.lit("Acme"))) is want


def test_drafts(spark):
    rows = spark.createDataFrame([(1, "First fact [[c1,c2]]. Second one. Third [[c3]].")], "id int, text string")
    got = [(r.sentence, r.claim_ids) for r in K.draft_sentences(rows, "id", "text").orderBy("at").collect()]
    assert got == [("First fact.", ["c1", "c2"]), ("Second one.", []), ("Third.", ["c3"])]


def test_wording(spark):
    assert one(spark, K.wording_errors(F.lit("finding"), F.lit("A causes B"))) == ["causal_claim_is_no_hypothesis", "causal_wording_is_unconditional"]
    assert one(spark, K.wording_errors(F.lit("hypothesis"), F.lit("A may lead to B"))) == []


def test_router(spark):
    reg = G.Registry()
    reg.register(G.ToolSpec("rows", "n rows", lambda ctx, n: spark.range(n), {"n": (int, True)}, roles=("analyst",), per_session=2))
    reg.register(G.ToolSpec("drop", "asks first", lambda ctx: spark.range(1), confirm=True))
    router, ctx, budget = G.Router(reg, "s"), RequestContext("t", ("analyst",)), G.Budget(total=8)
    assert router.call(ctx, "rows", {"n": 3}, budget).count() == 3

    def code(*args, **kw):
        with pytest.raises(G.ToolError) as e:
            router.call(*args, **kw)
        return e.value.code

    assert code(RequestContext("t"), "rows", {"n": 3}, budget) == "forbidden"
    assert code(ctx, "rows", {}, budget) == "missing_argument"
    assert code(ctx, "rows", {"n": 1}, budget) == "tool_budget"
    assert code(ctx, "nothing", {}, budget) == "unknown_tool"
    assert code(ctx, "drop", {}, budget) == "confirmation_required"
    assert router.call(ctx, "drop", {}, budget, confirm=router.token(ctx, "drop", {})).count() == 1
    trail = router.audit(spark).collect()
    assert [r.outcome for r in trail] == ["ok", "forbidden", "missing_argument", "tool_budget", "unknown_tool", "confirmation_required", "ok"]
    assert trail[0].arg_keys == ["n"] and len(reg.manifest(())) == 1


def test_web_query():
    q = WebQuery.parse('solid "state battery" cell or pack -toy')
    assert q.groups == (("solid",), ("cell", "pack")) and q.phrases == ("state battery",) and q.excluded == ("toy",)


def test_json_containment(spark):
    doc = json.dumps({"a": {"b": 1, "c": [1, 2, 3]}, "d": "x", "e": True})
    for wanted, want in [({"a": {"b": 1}}, True), ({"a": {"c": [3, 1]}}, True), ({"a": {"c": [4]}}, False), ({"d": "y"}, False), ({"e": True}, True), ({"z": 1}, False)]:
        assert one(spark, contains_json(F.lit(doc), wanted)) is want


def test_row_level_security(spark):
    rows = spark.createDataFrame([(1, "t", []), (2, "t", ["a"]), (3, "t", ["b"]), (4, "u", []), (5, "t", None)], "id int, tenant_id string, allowed_roles array<string>")
    assert sorted(r.id for r in visible(rows, RequestContext("t", ("a",))).collect()) == [1, 2, 5]


def test_folding_and_tokens(spark):
    rows = spark.createDataFrame([("Ｓtraße − A",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.folded("t")).collect()] == ["strasse - a", None]
    assert one(spark, X.tokens(F.lit("Solid 固态电池 3.5 x_1"))) == ["solid", "3.5", "x_1", "固态", "态电", "电池"]
    assert one(spark, X.sentences(F.lit("A 3.5 b. Mr. C! D\nE e.g. f. G"))) == ["A 3.5 b.", "Mr. C!", "D", "E e.g. f.", "G"]


@pytest.mark.parametrize(
    "url,kind,level",
    [("https://www.energy.gov/x", "government", 1), ("https://nature.com/articles/s1", "academic", 1), ("https://iso.org", "industry_institution", 1), ("https://reuters.com/a", "authoritative_media", 2),
     ("https://oecd.org", "industry_institution", 2), ("https://unknown.io", "general_web", 3), ("https://reddit.com/r", "rejected", 4), ("https://blog.csdn.net/a", "general_web", 4), ("", "rejected", 4)],
)
def test_source_grades(spark, url, kind, level):
    k = S.source_kind(F.lit(url))
    assert one(spark, k) == kind and one(spark, S.credibility(F.lit(url), k)) == level


def test_records(spark):
    work = {"id": "https://openalex.org/W5", "doi": "https://doi.org/10.1/x", "title": "T", "locations": [{"landing_page_url": "https://a.org/x", "pdf_url": None, "is_oa": True}, {"pdf_url": "https://b.org/x.pdf", "is_oa": True}, {"pdf_url": "http://c.org", "is_oa": True}]}
    rows = spark.createDataFrame([(json.dumps(work),), (json.dumps(work | {"is_retracted": True}),), ("{}",)], "j string")
    found = R.works(rows, "j")
    assert [r.work for r in found.collect()] == ["W5"]
    assert [r.url for r in R.leads(found).orderBy("n").collect()] == ["https://b.org/x.pdf", "https://a.org/x"]
    cross = {"DOI": "10.1234/A", "title": ["Hi"], "issued": {"date-parts": [[2024, 3]]}, "abstract": "<p>abs</p>"}
    got = R.crossref(spark.createDataFrame([(json.dumps(cross),), (json.dumps(cross | {"title": ["Retraction: Hi"]}),)], "j string"), "j").collect()
    assert [(r.doi, r.published, r.abstract) for r in got] == [("10.1234/a", "2024-03", "abs")]
    assert one(spark, R.before_cutoff(F.lit("2024"), "2024-06-01")) is True and one(spark, R.before_cutoff(F.lit("2025-01"), "2024-06-01")) is False


def test_no_path_and_no_pairs(spark):
    edges = spark.createDataFrame([("a", "b", "L"), ("c", "d", "L")], "src string, dst string, label string")
    assert graph.shortest_path(edges, "a", "d", 3).count() == 0
    assert graph.components(edges.where("src = 'z'").select(F.col("src").alias("a"), F.col("dst").alias("b"))).count() == 0


def test_related_questions(spark):
    df = spark.createDataFrame([(1, "the output of solid cells"), (2, "the report of 2020"), (3, None), (4, "Made by ACME")], "i int, t string")
    found = {r.i: r.x for r in df.select("i", screening.related("what is the cell output 2020", ["what", "is", "the", "cell", "output", "2020"], F.col("t"), ["acme"]).alias("x")).collect()}
    assert found == {1: True, 2: False, 3: False, 4: True}


def test_resolve_and_connect(spark):
    nodes = spark.createDataFrame([("n:1", "Alpha Works"), ("n:2", "Beta"), ("n:3", "Gamma"), ("n:4", "alpha two")], "uri string, name string")
    edges = spark.createDataFrame([("n:1", "n:2", "owns"), ("n:2", "n:3", "sells")], "src string, dst string, label string")
    got = packets.resolve_and_connect(nodes, edges, "alpha", "gamma").collect()
    assert [(r.path, r.labels) for r in got] == [(["n:1", "n:2", "n:3"], ["owns", "sells"])]
    assert packets.resolve_and_connect(nodes, edges, "alpha", "nobody").count() == 0


def test_mixed_words_and_claim_lines(spark):
    df = spark.createDataFrame([("电池 battery 技术（see cell 技术）", True), ("ABC 技术", False), (None, None)], "t string, alone boolean")
    got = df.select(packets.mixed_words(F.col("t")).alias("m"), packets.claim_line(F.col("t"), F.col("alone")).alias("c")).collect()
    assert [r.m for r in got] == [["battery"], [], None]
    assert got[0].c.startswith("[single source] ") and got[1].c == "ABC 技术" and got[2].c is None


def test_grounding_takes_equal_claims_and_verdicts(spark):
    sentences = spark.createDataFrame(
        [(1, "It grew  by 5.", None, None), (2, "It fell by 7.", [2], None), (3, "Made up.", [], None), (4, "It grew by 5.", [1, 9], None), (5, "Said 5 differently.", [1], None), (6, "A heading", None, True), (7, "It grew by 5.", [1, 2], False)],
        "sentence_id int, text string, claim_ids array<int>, editorial boolean",
    )
    claims = spark.createDataFrame([(1, "it grew by 5.", False), (2, "It fell by 7.", None)], "claim_id int, text string, disputed boolean")
    evidence = spark.createDataFrame([(10, 1, "Before. It grew by 5. After."), (11, 2, "Other words with 8.")], "citation_id int, claim_id int, quote string")
    verdicts = spark.createDataFrame([(5,)], "sentence_id int")
    got = {r.sentence_id: (r.status, r.reason, r.citation_ids) for r in grounding.grounded(sentences, claims, evidence, verdicts).collect()}
    assert got == {
        1: ("supported", grounding.SUPPORTED, [10]),
        2: ("withheld", "numeric_value_or_unit_not_supported", None),
        3: ("withheld", "missing_claim_citation", None),
        4: ("withheld", "unknown_or_out_of_section_claim", None),
        5: ("supported", grounding.SUPPORTED, [10]),
        6: ("editorial", None, None),
        7: ("supported", grounding.SUPPORTED, [10]),
    }
    audit = grounding.audit(grounding.grounded(sentences, claims, evidence, verdicts)).first()
    assert (audit.attempted, audit.supported, audit.withheld, audit.supported_ratio) == (6, 3, 3, 0.5)
    assert grounding.audit(grounding.grounded(sentences.limit(0), claims, evidence)).first().supported_ratio == 0.0
