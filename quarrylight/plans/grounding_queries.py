"""Queries of grounding and screening operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import quantities as Q
from quarrylight.operators import grounding as G
from quarrylight.operators import passages as P
from quarrylight.operators import screening as S
from quarrylight.session import durable
from quarrylight.session import table as T

from .claim_queries import _CLAIMS, _sentences
from .text_queries import _SENT, _signature_sql

_ALIASES = ["thering", "nation and"]
_CONCEPTS = [("thering",), ("nation", "in the"), ("[0-9]",), ("secret", "token"), ("license",)]


def _drafted(s, d):
    """Every factual sentence as a draft, with claims and evidence that differ from it in numbers, signs, units, words, or are not there."""
    x = durable(_sentences(s, d).select("id", "claim"), "drafted")  # read for sentences, claims and evidence
    i = F.col("id")
    ids = F.when(i % 7 == 0, F.array().cast("array<long>")).when(i % 11 == 0, F.array(i, F.lit(-1).cast("long"))).otherwise(F.array(i))
    sentences = x.select(i.alias("sentence_id"), F.col("claim").alias("text"), ids.alias("claim_ids"), (i % 19 == 0).alias("editorial"))
    claims = x.where(i % 7 != 0).select(i.alias("claim_id"), F.concat(F.col("claim"), F.lit(" "), i).alias("text"), (i % 13 == 0).alias("disputed"))
    quote = (
        F.when(i % 5 == 0, F.regexp_replace("claim", "([0-9]+)", "-$1"))
        .when(i % 5 == 1, F.regexp_replace("claim", "([0-9]+)", "$1 percent"))
        .when(i % 5 == 2, F.concat(F.lit("It is said that "), F.col("claim")))
        .when(i % 5 == 3, F.regexp_replace("claim", "([0-9]+)", "$1.0"))
        .otherwise(F.col("claim"))
    )
    evidence = x.where(i % 17 != 0).select(i.alias("citation_id"), i.alias("claim_id"), quote.alias("quote"))
    return sentences, claims, evidence


def sentence_grounding(s, d):
    got = G.grounded(*_drafted(s, d), numbers=Q.plain_signatures)
    return got.select("sentence_id", "status", "reason", F.size(F.coalesce("citation_ids", F.array().cast("array<long>"))).alias("citations"))


def grounding_audit(s, d):
    return G.audit(G.grounded(*_drafted(s, d), numbers=Q.plain_signatures))


def bibliography(s, d):
    docs = T(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("url"))
    cited = T(s, d, "labels").where("quality = 1").join(docs, "doc_id").select("url")
    return G.bibliography(docs, cited, "url", "doc_id").select("doc_id")


def supporting_sources(s, d):
    li = T(s, d, "lineitem")
    got = G.supporting_sources(li, "l_orderkey", "l_suppkey", F.col("l_returnflag") == "R")
    return got.select("l_orderkey", F.array_join(F.col("urls").cast("array<string>"), ",").alias("urls"))


def provenance_ids(s, d):
    edges = T(s, d, "lineitem").select(F.array(F.col("l_partkey"), F.col("l_suppkey")).alias("claim_ids"))
    nodes = T(s, d, "orders").select(F.array(F.col("o_custkey")).alias("claim_ids"))
    return G.provenance(edges, nodes)


def coverage_summary(s, d):
    status = F.when(F.col("quality") == 1, "complete").when(F.col("toxic") == 1, "unsupported").otherwise("partial")
    return G.coverage_summary(T(s, d, "documents"), T(s, d, "labels").select("doc_id", status.alias("status")), "doc_id", "status")


def attributions(s, d):
    status = F.when(F.col("l_returnflag") == "R", "disputed").when(F.col("l_linestatus") == "F", "corroborated").otherwise("source_reported")
    rows = T(s, d, "lineitem").select("l_orderkey", status.alias("status"), F.concat(F.lit("Title "), F.col("l_suppkey") % 3).alias("title"))
    return G.attribution(rows, "l_orderkey", "status", "title")


def spot_sample(s, d):
    return G.spot_sample(T(s, d, "documents").select("doc_id", "text"), "text", "doc_id", 5).select("doc_id")


def concept_spread(s, d):
    return G.spread_over_concepts(T(s, d, "documents"), "doc_id", "text", _CONCEPTS, 12)


def retryable_failures(s, d):
    reason = F.concat(F.lit("http_"), 400 + F.col("event_id") % 150)
    return T(s, d, "events").select("event_id", S.retryable(F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, "timeout").otherwise(reason)).alias("again"))


def causal_questions(s, d):
    return T(s, d, "conversations").select("conv_id", "turn", S.asks_for_cause(F.concat("text", F.when(F.col("turn") % 2 == 0, " Why?").otherwise(" whyever"))).alias("causal"))


def thin_bodies(s, d):
    primary = F.col("lang") == "en"
    x = T(s, d, "documents").select("doc_id", S.long_enough(F.col("text"), primary, F.contains("text", F.lit("the")), F.col("doc_id") % 2 == 0).alias("kept"))
    return x.groupBy("kept").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))


def subject_matches(s, d):
    return T(s, d, "documents").select("doc_id", S.on_subject(F.col("source"), F.col("text"), _ALIASES, allow_lead=True).alias("matches"))


def identity_matches(s, d):
    key = lambda c, m: F.when(F.col(c) % m == 0, None).otherwise(F.col(c) % 10)
    return T(s, d, "orders").select("o_orderkey", S.same_identity(key("o_orderkey", 3), key("o_custkey", 5)).alias("same"))


def first_queries(s, d):
    q = F.array(F.lit("first"), F.col("p_brand"), F.col("p_name"), F.lit("fourth"))
    return T(s, d, "part").select("p_partkey", F.array_join(S.first_queries(F.col("p_name"), q), "|").alias("queries"))


def unsupported_numbers(s, d):
    x = T(s, d, "documents").select("doc_id", "text", F.concat(F.lit("In 1999 there were 12 of 3.50 and "), F.col("doc_id")).alias("draft"))
    return x.select("doc_id", F.array_join(S.numbers_not_in(F.col("draft"), F.col("text"), Q.plain_signatures), " ").alias("missing"))


def tex_escapes(s, d):
    return T(s, d, "pages").select("page_id", F.sha2(S.tex_escaped(F.col("url")), 256).alias("escaped"))


def gap_windows(s, d):
    return P.gap_windows(T(s, d, "documents"), "doc_id", "text", "Which thering nation market?", 2000)


QUERIES = [
    sentence_grounding, grounding_audit, bibliography, supporting_sources, provenance_ids, coverage_summary, attributions, spot_sample, concept_spread, retryable_failures,
    causal_questions, thin_bodies, subject_matches, identity_matches, first_queries, unsupported_numbers, tex_escapes, gap_windows,
]

_SAME = r"lower(trim(regexp_replace(%s, '\s+', ' ', 'g')))"
_GROUND = rf"""{_CLAIMS}, s AS (SELECT id AS sentence_id, claim AS stext, CASE WHEN id % 7 = 0 THEN [] WHEN id % 11 = 0 THEN [id, -1] ELSE [id] END AS ids, id % 19 = 0 AS editorial FROM claims),
 c AS (SELECT id AS claim_id, claim || ' ' || id AS ctext, id % 13 = 0 AS disputed FROM claims WHERE id % 7 <> 0),
 e AS (SELECT id AS citation_id, id AS claim_id, CASE id % 5 WHEN 0 THEN regexp_replace(claim, '([0-9]+)', '-\1', 'g') WHEN 1 THEN regexp_replace(claim, '([0-9]+)', '\1 percent', 'g')
  WHEN 2 THEN 'It is said that ' || claim WHEN 3 THEN regexp_replace(claim, '([0-9]+)', '\1.0', 'g') ELSE claim END AS quote FROM claims WHERE id % 17 <> 0),
 named AS (SELECT sentence_id, unnest(list_distinct(ids)) AS claim_id FROM s WHERE len(ids) > 0),
 alike AS (SELECT s.sentence_id, c.claim_id FROM s JOIN c ON {_SAME % 'stext'} = {_SAME % 'ctext'} WHERE len(ids) = 0 AND NOT editorial),
 p AS (SELECT l.sentence_id, l.claim_id, ctext, disputed, coalesce({_SAME % 'stext'} = {_SAME % 'ctext'}, false) AS same FROM (FROM named UNION ALL FROM alike) l JOIN s USING (sentence_id) LEFT JOIN c USING (claim_id)),
 per AS (SELECT sentence_id, bool_or(ctext IS NULL) AS unknown, bool_or(coalesce(disputed, false)) AS unsettled, bool_or(same) AS any_same FROM p GROUP BY sentence_id),
 q AS (SELECT p.sentence_id, citation_id, {_signature_sql("coalesce(quote, '')")} AS n, list_contains(list_transform({_SENT.replace('text', "coalesce(quote, '')")}, lambda t: {_SAME % 't'}), {_SAME % 'stext'}) AS verbatim
  FROM p JOIN per USING (sentence_id) JOIN s USING (sentence_id) LEFT JOIN e USING (claim_id) WHERE p.same OR NOT any_same),
 sup AS (SELECT sentence_id, bool_or(citation_id IS NULL) AS unanchored, flatten(list(n)) AS n, bool_or(verbatim) AS verbatim, count(DISTINCT citation_id) AS k FROM q GROUP BY sentence_id),
 g AS (SELECT s.sentence_id AS id, k, CASE WHEN editorial THEN NULL WHEN per.unknown IS NULL THEN 'missing_claim_citation' WHEN per.unknown THEN 'unknown_or_out_of_section_claim'
  WHEN unsettled THEN 'publication_policy_excludes_unsettled_premise' WHEN coalesce(unanchored, true) THEN 'claim_has_no_anchored_support'
  WHEN len(list_filter({_signature_sql('stext')}, lambda w: NOT list_contains(sup.n, w))) > 0 THEN 'numeric_value_or_unit_not_supported'
  WHEN NOT coalesce(verbatim, false) THEN 'draft_sentence_not_entailed_by_sources' ELSE 'source_support_audited' END AS reason FROM s LEFT JOIN per USING (sentence_id) LEFT JOIN sup USING (sentence_id))"""
_TEXED = "url"
for _c, _r in S.TEX.items():
    if _c in "&%$#_":
        _TEXED = f"replace({_TEXED}, '{_c}', '{_r}')"
_HAS = lambda c: f"(contains(lower({c}), 'thering') OR contains(lower({c}), 'nation and'))"

ORACLES = {
    "sentence_grounding": f"""WITH {_GROUND} SELECT id AS sentence_id, CASE WHEN reason IS NULL THEN 'editorial' WHEN reason = 'source_support_audited' THEN 'supported' ELSE 'withheld' END AS status, reason,
 CAST(CASE WHEN reason = 'source_support_audited' THEN k ELSE 0 END AS INTEGER) AS citations FROM g""",
    "grounding_audit": f"""WITH {_GROUND}, n AS (SELECT count(reason) AS a, count(*) FILTER (WHERE reason = 'source_support_audited') AS s FROM g)
 SELECT a AS attempted, s AS supported, a - s AS withheld, CASE WHEN a > 0 THEN round(s / a, 6) ELSE 0 END AS supported_ratio FROM n""",
    "bibliography": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1) GROUP BY text",
    "supporting_sources": "SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag = 'R'))), ','), '') AS urls FROM lineitem GROUP BY l_orderkey",
    "provenance_ids": "SELECT l_partkey AS claim_id FROM lineitem UNION SELECT l_suppkey FROM lineitem UNION SELECT o_custkey FROM orders",
    "coverage_summary": """SELECT CASE WHEN l.doc_id IS NULL THEN 'not_evaluated' WHEN quality = 1 THEN 'complete' WHEN toxic = 1 THEN 'unsupported' ELSE 'partial' END AS coverage, count(*) AS items
 FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
    "attributions": """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'disputed' WHEN bool_and(l_linestatus = 'F') THEN 'corroborated' ELSE 'source_reported' END AS state,
 CASE WHEN bool_or(l_returnflag = 'R') THEN 'Disputed source statement: ' WHEN bool_and(l_linestatus = 'F') THEN 'Multiple source groups report: '
 WHEN count(DISTINCT l_suppkey % 3) = 1 THEN 'According to Title ' || min(l_suppkey % 3) || ': ' ELSE 'According to the cited sources: ' END AS lead FROM lineitem GROUP BY l_orderkey""",
    "spot_sample": "SELECT doc_id FROM documents ORDER BY regexp_matches(text, '[0-9]') DESC, doc_id LIMIT 5",
    "retryable_failures": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE 400 + event_id % 150 = 429 OR 400 + event_id % 150 >= 500 END AS again FROM events""",
    "causal_questions": r"SELECT conv_id, turn, regexp_matches(text || CASE WHEN turn % 2 = 0 THEN ' Why?' ELSE ' whyever' END, '(?i)\bwhy\b|\bcaus(e|al|ation)\b|mechanism|为什么|为何|原因|机制|机理|如何影响') AS causal FROM conversations",
    "thin_bodies": r"""SELECT kept, count(*) AS documents, min(doc_id) AS first FROM (SELECT doc_id, length(text) >= 400 OR (length(text) >= 100 AND lang = 'en' AND contains(text, 'the')
 AND (doc_id % 2 = 0 OR len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) >= 18)) AS kept FROM documents) GROUP BY kept""",
    "subject_matches": f"""SELECT doc_id, {_HAS('source')} OR {_HAS('left(text, 400)')} OR len(list_filter(p, lambda s: {_HAS('s')})) >= 2 AS matches FROM (SELECT doc_id, source, text, {_SENT.replace('text', 'left(text, 20000)')} AS p FROM documents)""",
    "identity_matches": "SELECT o_orderkey, o_orderkey % 3 = 0 OR o_custkey % 5 = 0 OR o_orderkey % 10 = o_custkey % 10 AS same FROM orders",
    "first_queries": "SELECT p_partkey, p_name || '|' || p_brand AS queries FROM part",
    "unsupported_numbers": f"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct([':1999:', ':12:', ':3.5:', ':' || doc_id || ':']), lambda v: NOT list_contains(n, v))), ' ') AS missing
 FROM (SELECT doc_id, {_signature_sql('text')} AS n FROM documents)""",
    "tex_escapes": f"SELECT page_id, sha256({_TEXED}) AS escaped FROM pages",
}
